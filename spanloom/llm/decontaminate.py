"""Benchmark decontamination by greedy string tiling.

Texts are compared as words (letters and digits of any script, A-Z lower-cased; ASCII and other punctuation and spaces split
words, and each ideograph or kana is a word).
Seeds are runs of `k` words that document and test item share, found by a Karp-Rabin hash that rolls over the document
and proved word by word; seeds that follow each other on one diagonal are a run. Of the runs of one document and item the
longest is taken, its words are marked on both sides, and the rest is searched again, so passages in any order add up. The covered share of the item's words
is its coverage; the document is contaminated by items covered to `threshold` or more.

The test items are searched in blocks of at most `block_bytes` of text, each sent to the executors, so benchmarks of
any size run in bounded memory; every block reads all documents once. An item's seeds never leave its block.

Defined results: null and empty documents match nothing; null or empty items are not searched for; an item under k
words is met only by documents of just these words; repeated items, ids and rows each give their own result; empty tables give no rows; other columns
of the documents are carried along by `clean` and ignored by `leaks`.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import fresh, ids_and_text

K = 5
THRESHOLD = 0.6
BLOCK_BYTES = 16 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def _word_bytes() -> bytes:
    keep = lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
    return bytes(c + 32 if 65 <= c <= 90 else c if keep(c) else 32 for c in range(256))


WORD_BYTES = _word_bytes()


#: In UTF-8: U+00A0 to U+00BF, general punctuation and CJK punctuation; ideographs and kana.
MARKS = re.compile(rb"\xc2[\xa0-\xbf]|\xe2[\x80\x81][\x80-\xbf]|\xe3\x80[\x80-\xbf]")
SIGNS = re.compile(rb"[\xe4-\xe9][\x80-\xbf]{2}|\xe3[\x81-\x83\x90-\xbf][\x80-\xbf]")


def word_codes(text: bytes) -> np.ndarray:
    """A 64-bit code for each word of the whole text."""
    if not text.isascii():
        text = SIGNS.sub(rb" \g<0> ", MARKS.sub(b" ", text))
    w = text.translate(WORD_BYTES).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of k words: a polynomial in BASE modulo 2^64."""
    out = np.zeros(max(0, len(codes) - k + 1), dtype=np.uint64)
    for j in range(k):
        out = out * BASE + codes[j : j + len(out)]
    return out


#: Seeds that are listed at once: bounds memory where a text repeats a passage of an item over and over.
SEEDS_AT_ONCE = 1 << 20


class Items:
    """A block of test items with an index of their seeds: sorted hashes with the item and place of each."""

    def __init__(self, items: list[tuple[int, bytes]], k: int = K):
        self.k, self.ids, self.codes = k, [], []
        parts: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            codes = word_codes(text)
            if len(codes):
                n = min(k, len(codes))
                parts.setdefault(n, []).append((rolling(codes, n), len(self.ids)))
                self.ids.append(item_id)
                self.codes.append(codes)
        self.flat = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint64)
        self.offset = np.r_[0, np.cumsum([len(c) for c in self.codes])].astype(np.int64)
        self.index = {}
        for n, hashed in sorted(parts.items()):
            h = np.concatenate([x for x, _ in hashed])
            item = np.concatenate([np.full(len(x), at, dtype=np.int64) for x, at in hashed])
            place = np.concatenate([np.arange(len(x), dtype=np.int64) for x, _ in hashed])
            order = np.argsort(h, kind="stable")
            # A bit table rules most windows out before the exact look-up.
            bits = max(16, (8 * len(h)).bit_length())
            table = np.zeros(1 << bits, dtype=bool)
            table[h >> np.uint64(64 - bits)] = True
            self.index[n] = (h[order], item[order], place[order], table, np.uint64(64 - bits))

    def runs(self, codes: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """item -> (document position, item position, words) of all maximal runs of shared seeds, proved word by word."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for n, (seeds, items, places, table, shift) in self.index.items():
            if n < self.k and len(codes) != n:  # a few words alone are no leak
                continue
            h = rolling(codes, n)
            at = np.flatnonzero(table[h >> shift])
            low, high = np.searchsorted(seeds, h[at], "left"), np.searchsorted(seeds, h[at], "right")
            at, low, count = at[high > low], low[high > low], (high - low)[high > low]
            ends = np.cumsum(count)
            cuts = np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + SEEDS_AT_ONCE, SEEDS_AT_ONCE), "right")
            open_runs: dict[tuple[int, int], list[int]] = {}
            for a, b in zip(cuts, [*cuts[1:], len(at)]):
                if b > a:
                    self._extend(codes, n, np.repeat(at[a:b], count[a:b]), np.concatenate([np.arange(x, x + c) for x, c in zip(low[a:b], count[a:b])]), items, places, open_runs, found)
            for (item, _), (d, i, size) in open_runs.items():
                found.setdefault(item, []).append((d, i, size))
        return found

    def _extend(self, codes, n, d, seed, items, places, open_runs, found) -> None:
        item, i = items[seed], places[seed]
        same = np.ones(len(d), dtype=bool)
        for j in range(n):
            same &= codes[d + j] == self.flat[self.offset[item] + i + j]
        d, i, item = d[same], i[same], item[same]
        order = np.lexsort((d, d - i, item))
        d, i, item = d[order], i[order], item[order]
        if not len(d):
            return
        starts = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | ((d - i)[1:] != (d - i)[:-1]) | (d[1:] != d[:-1] + 1)])
        sizes = np.diff(np.r_[starts, len(d)]) + n - 1
        for a, size in zip(starts.tolist(), sizes.tolist()):
            key, one = (int(item[a]), int(d[a] - i[a])), [int(d[a]), int(i[a]), size]
            last = open_runs.get(key)
            if last and one[0] <= last[0] + last[2] - n + 1:  # the next window of the run before
                last[2] = one[0] + size - last[0]
                continue
            if last:
                found.setdefault(key[0], []).append(tuple(last))
            open_runs[key] = one


def tiles(runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document position, item position, words), longest first, no word of either side used twice.

    runs are maximal common runs. One that meets marked words is cut there, and its remains of at least `least` words wait for
    their turn; of runs of one length the earliest in the document comes first, then the earliest in the item.
    """
    waiting = [(-n, d, i) for d, i, n in runs]
    heapq.heapify(waiting)
    used_d = np.zeros(max((d + n for d, _, n in runs), default=0), dtype=bool)
    used_i = np.zeros(max((i + n for _, i, n in runs), default=0), dtype=bool)
    out = []
    while waiting:
        n, d, i = heapq.heappop(waiting)
        n = -n
        marked = used_d[d : d + n] | used_i[i : i + n]
        if not marked.any():
            out.append((d, i, n))
            used_d[d : d + n] = used_i[i : i + n] = True
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, marked, True].astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= least:
                heapq.heappush(waiting, (a - b, d + a, i + a))
    return out


def covered(items: Items, text: bytes):
    """(item's place, words covered, tiles) of every item that shares a seed with the text."""
    for at, runs in items.runs(word_codes(text)).items():
        got = tiles(runs, min(items.k, len(items.codes[at])))
        yield at, sum(n for _, _, n in got), got


_BUILT: dict = {}


def _built(shared, k: int) -> Items:
    """The index of a broadcast block, built once in a worker process."""
    block = shared.value
    if _BUILT.get("block") is not block or _BUILT["k"] != k:
        _BUILT.update(block=block, k=k, items=Items(block, k))
    return _BUILT["items"]


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Lists of (id, text) whose texts together stay near block_bytes; only one block is on the driver at a time."""
    rows = benchmark.where(F.length(F.coalesce(F.col(text_col), F.lit(""))) > 0).select(
        F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "utf-8").alias("text")
    )
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for n in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == n)
        got = part.toArrow()
        yield sorted(zip(got.column("id").to_pylist(), got.column("text").to_pylist()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


SCHEMA = "doc_id long, item_id long, coverage double, longest int, tiles int"


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, k: int = K, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, coverage, longest, tiles) for each row of docs and each item that it covers to the threshold or more."""
    source = ids_and_text(docs, id_col, text_col)
    out = None
    for block in _item_blocks(benchmark, "item_id", "text", block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def kernel(batches, shared=shared):
            items = _built(shared, k)
            for b in batches:
                rows = []
                for doc, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                    for item, words, got in covered(items, t.as_py()):
                        coverage = words / len(items.codes[item])
                        if coverage >= threshold:
                            rows.append((doc, items.ids[item], coverage, max(n for _, _, n in got), len(got)))
                cols = list(zip(*rows)) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "coverage", "longest", "tiles"])

        found = source.mapInArrow(kernel, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, k: int = K, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that cover no item to the threshold, with all their columns."""
    ids_and_text(docs, docs.columns[0], text_col)
    (flag,) = fresh(docs, "leaked")
    out = docs
    for block in _item_blocks(benchmark, "item_id", "text", block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def leaked(texts, shared=shared):
            import pandas as pd

            items = _built(shared, k)
            return pd.Series([any(n / len(items.codes[i]) >= threshold for i, n, _ in covered(items, t.encode("utf-8", "replace"))) for t in texts], dtype=bool)

        from pyspark.sql.pandas.functions import pandas_udf

        udf = pandas_udf(leaked, "boolean", functionType=200)
        out = out.withColumn(flag, udf(F.coalesce(F.col(text_col), F.lit("")))).where(~F.col(flag)).drop(flag)
    return out
