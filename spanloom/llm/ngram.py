"""LM scoring by deleted interpolation of n-gram maximum-likelihood estimates.

    P(w | u v) = a_b * c(u, v, w) / c(u, v) + b_b * c(v, w) / c(v) + g_b * c(w) / N + e_b / (V + 1)

with one set of mixture weights for each bucket b of the context's frequency: by powers of two of c(u, v), or of c(v) where
the two words were never seen together. The highest `order` is 3 or 2; without trigrams a_b is zero and buckets are those of c(v). Tokens are words of the whole text, A-Z lower-cased, and one end token; the
context of the first token is the start of the text.

Counts come from all training documents. For the weights a share of the training documents is deleted from the counts
and the likelihood of their tokens under the remaining counts is maximised by expectation-maximisation, over a
histogram of all their tokens that is fine in each probability and bounded in size.

Execution. Documents are dealt into chunks by a hash of id and text (only rows that repeat both meet for certain). A chunk
asks for the counts of its distinct n-grams in packed blocks, one for each key range; a key range adds up the blocks of all
chunks and answers each with the totals in the asker's order. So a frequent n-gram costs a chunk one entry, and no task
sees more than its chunk or its key range. Words are keyed by 64-bit hashes, longer n-grams by `key_bits` bits, 20 more
than it takes to number all tokens: about one key in a million shares its counts with another. Looked-up counts are written, compressed, to the shared folder, and the
weights and scores are computed from there.

Defined results: null text is the empty text, which is one end token; repeated rows count and score each; null ids are
kept; without training documents N and V are zero and every probability is 1; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import ids_and_text
from spanloom.scratch import discard, settle

#: Text characters of a chunk: sets a task's memory.
CHUNK_CHARS = 12_000_000
#: One training document in so many is deleted from the counts that the weights are learnt on.
DELETED_SHARE = 8
#: Powers of two of a count; a context that two words make has a bucket above these.
POWERS_OF_COUNT = 64
#: Histogram cells per power of two of a probability, and powers covered: those of one in all that a long can count.
FINE, POWERS = 8, 64
#: Highest order of the query's model: trigrams more than double what is shuffled.
ORDER = 2
END, START = np.uint64(0x51ED270B0A1F39C1), np.uint64(0x2545F4914F6CDD1D)
MIX = np.uint64(0x9E3779B97F4A7C15)


def token_codes(text: bytes) -> np.ndarray:
    w = text.lower().split()
    out = np.empty(len(w) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))
    out[-1] = END
    return out


def _joined(before: np.ndarray, codes: np.ndarray) -> np.ndarray:
    x = (before ^ (before >> np.uint64(29))) * MIX + codes
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _shifted(codes: np.ndarray) -> np.ndarray:
    out = np.empty_like(codes)
    out[0], out[1:] = START, codes[:-1]
    return out


def gram_codes(codes: np.ndarray, order: int) -> np.ndarray:
    """A hash of each token and the order - 1 before it; before the first token stands START."""
    for n in range(1, order):
        tail = codes if n == 1 else out
        out = _joined(_shifted(tail), codes)
    return codes if order == 1 else out


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers, low bytes first by plane, as many planes as the largest needs, deflated: small numbers take little."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zlib.compress(planes.tobytes(), 1)


def _from_planes(planes: np.ndarray) -> np.ndarray:
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def unpacked(blob: bytes) -> np.ndarray | None:
    if not blob:
        return None
    return _from_planes(np.frombuffer(zlib.decompress(blob[1:]), dtype=np.uint8).reshape(blob[0], -1)).astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as gaps, by byte planes: the low ones, which are as good as random, as they are, the others deflated."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    raw = (max(1, int(gaps.astype(float).mean())).bit_length() - 1) // 8
    planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    head = zlib.compress(planes[raw:].tobytes(), 1)
    return bytes([raw]) + len(head).to_bytes(4, "little") + head + planes[:raw].tobytes()


def unpacked_keys(blob: bytes) -> np.ndarray:
    raw, size = blob[0], 5 + int.from_bytes(blob[1:5], "little")
    high = np.frombuffer(zlib.decompress(blob[5:size]), dtype=np.uint8).reshape(8 - raw, -1)
    low = np.frombuffer(blob, dtype=np.uint8, offset=size).reshape(raw, -1) if raw else high[:0]
    return np.cumsum(_from_planes(np.concatenate([low, high])), dtype=np.uint64)


def _chunk_tokens(texts):
    """All codes of a chunk's texts, and each text's size."""
    each = [token_codes(t.encode("utf-8", "replace")) for t in texts]
    return each, np.array([len(c) for c in each], dtype=np.int64)


def _distinct(values: np.ndarray):
    keys, inverse = np.unique(values, return_inverse=True)
    return keys, inverse


#: role of a document: 0 held out, 1 training, 2 training but deleted for the weights
def _asked(each, sizes, roles, key_bits: int, order: int):
    """For each n-gram size up to order: distinct keys (sorted), inverse, training counts, deleted counts."""
    role = np.repeat(roles, sizes)
    for size in range(1, order + 1):
        values = np.concatenate([gram_codes(c, size) for c in each])
        keys, inverse = _distinct(values if size == 1 else values >> np.uint64(64 - key_bits))
        yield size, keys, inverse, np.bincount(inverse[role > 0], minlength=len(keys)), np.bincount(inverse[role == 2], minlength=len(keys))


def _range_of(keys: np.ndarray, ranges: int, key_bits: int) -> np.ndarray:
    """Key range of each sorted key: equal shares of the key space."""
    return np.minimum((keys >> np.uint64(key_bits - 32)).astype(np.int64) * ranges >> 32, ranges - 1)


def ask(key, pdf: pd.DataFrame, ranges: int, key_bits: int, order: int) -> pd.DataFrame:
    each, sizes = _chunk_tokens(pdf["text"])
    out = []
    for size, keys, _, train, deleted in _asked(each, sizes, pdf["role"].to_numpy(), key_bits, order):
        cut = np.searchsorted(_range_of(keys, ranges, 64 if size == 1 else key_bits), np.arange(ranges + 1))
        for r in range(ranges):
            a, b = cut[r], cut[r + 1]
            if b > a:
                out.append((r, size, key[0], packed_keys(keys[a:b]), packed(train[a:b]), packed(deleted[a:b])))
    return pd.DataFrame(out, columns=["range", "kind", "chunk", "keys", "train", "deleted"])


def answer(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals for each chunk of a key range, and on a row of chunk -1 the range's number of distinct training unigrams."""
    out = []
    for size in sorted(set(pdf["kind"])):
        rows = pdf[pdf["kind"] == size].sort_values("chunk")
        blocks = [unpacked_keys(k) for k in rows["keys"]]
        keys, inverse = _distinct(np.concatenate(blocks))
        sums = lambda column: np.rint(np.bincount(inverse, np.concatenate([unpacked(x) for x in column]), len(keys))).astype(np.int64)
        train, deleted = sums(rows["train"]), sums(rows["deleted"])
        at = 0
        for chunk, block in zip(rows["chunk"], blocks):
            own = inverse[at : at + len(block)]
            at += len(block)
            out.append((chunk, key[0], size, packed(train[own]), packed(deleted[own]), 0, 0))
        if size == 1:
            out.append((-1, key[0], 0, b"", b"", int((train > 0).sum()), int((train - deleted > 0).sum())))
    return pd.DataFrame(out, columns=["chunk", "range", "kind", "train", "deleted", "v", "v_kept"])


LOOKED_UP = "id string, role int, n_tokens long, n_known long, c1 binary, c2 binary, c3 binary, d1 binary, d2 binary, d3 binary, v long, v_kept long"


def look_up(key, docs: pd.DataFrame, answers: pd.DataFrame, key_bits: int, order: int) -> pd.DataFrame:
    """Per document the packed counts of its tokens' n-grams: all training counts, and for deleted documents those without the deleted."""
    columns = [c.split()[0] for c in LOOKED_UP.split(", ")]
    if docs.empty:  # the rows of chunk -1
        return pd.DataFrame([(None, -1, 0, 0, *[b""] * 6, int(answers["v"].sum()), int(answers["v_kept"].sum()))], columns=columns)
    each, sizes = _chunk_tokens(docs["text"])
    roles = docs["role"].to_numpy()
    ends = np.cumsum(sizes)
    got = {"id": docs["id"].to_numpy(), "role": roles, "n_tokens": sizes, "v": 0, "v_kept": 0}
    got |= {f"{c}{size}": [b""] * len(docs) for c in "cd" for size in range(order + 1, 4)}
    for size, keys, inverse, _, _ in _asked(each, sizes, roles, key_bits, order):
        rows = answers[answers["kind"] == size].sort_values("range")
        train, deleted = (np.concatenate([unpacked(x) for x in rows[name]]) for name in ("train", "deleted"))
        assert len(train) == len(keys), "answers do not fit the chunk"
        parts = [inverse[z - n : z] for n, z in zip(sizes, ends)]
        got[f"c{size}"] = [packed(train[p]) for p in parts]
        got[f"d{size}"] = [packed(train[p] - deleted[p]) if role == 2 else b"" for p, role in zip(parts, roles)]
        if size == 1:
            got["n_known"] = [int((train[p] > 0).sum()) for p in parts]
    return pd.DataFrame(got)[columns]


def contexts(counts: np.ndarray, starts: int) -> np.ndarray:
    """Counts of the contexts of a text's tokens, from those of the n-grams that end at each: of the one before, and of text starts for the first."""
    return np.r_[starts, counts[:-1]]


def power(counts: np.ndarray) -> np.ndarray:
    """0 for none, else one more than the power of two."""
    return np.where(counts > 0, np.log2(np.maximum(counts, 1)).astype(np.int64) + 1, 0)


def estimates(c1: np.ndarray, c2: np.ndarray, c3: np.ndarray | None, n: int, starts: int):
    """(bucket, [3, tokens] maximum-likelihood estimates of the orders 3, 2 and 1) of a text's tokens; no c3: that of order 3 is 0."""
    v1, v2 = contexts(c1, starts), contexts(c2, starts)
    if c3 is None:
        v2, c3 = np.zeros_like(v2), np.zeros_like(c2)
    ratio = lambda c, v: np.divide(c, v, out=np.zeros(len(v)), where=v > 0)
    bucket = np.where(v2 > 0, POWERS_OF_COUNT + power(v2), power(v1))
    return bucket, np.stack([ratio(c3, v2), ratio(c2, v1), c1 / max(n, 1)])


def _cells(p: np.ndarray) -> np.ndarray:
    """Cell of a probability: 0 for none, else by powers of two cut FINE times."""
    cell = np.ceil(-np.log2(np.maximum(p, 2.0**-POWERS)) * FINE).astype(np.int64) + 1
    return np.where(p > 0, np.minimum(cell, POWERS * FINE + 1), 0)


def learn_weights(cells: pd.DataFrame, uniform: float, rounds: int = 60) -> np.ndarray:
    """(bucket, p3, p2, p1 cells, n) of held-out tokens -> [buckets, 4] weights of the three orders and uniform, by EM in each bucket."""
    weights = np.tile([0.3, 0.3, 0.3, 0.1], (2 * POWERS_OF_COUNT + 1, 1))
    weights[: POWERS_OF_COUNT + 1] = [0.0, 0.4, 0.5, 0.1]  # the two words before were never seen together
    weights[0] = [0.0, 0.0, 0.8, 0.2]  # nor the one before: contexts that were never seen say nothing
    value = lambda c: np.where(c > 0, 2.0 ** (-np.maximum(c - 1.5, 0.0) / FINE), 0.0)
    for b, rows in cells.groupby("bucket"):
        n = rows["n"].to_numpy(float)
        p = np.stack([*(value(rows[c].to_numpy(float)) for c in ("p3", "p2", "p1")), np.full(len(rows), uniform)])
        w = weights[int(b)]
        for _ in range(rounds):
            part = w[:, None] * p
            w = (part / part.sum(0) * n).sum(1) / n.sum()
        # A floor keeps every probability positive.
        w = np.maximum(w, [0.0, 0.0, 1e-9, 1e-6])
        weights[int(b)] = w / w.sum()
    return weights


def score(docs: DataFrame, training: Column, deleted: Column, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, order: int = ORDER) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    training and deleted: booleans over the column `id`; a row is held out where training is false, and its tokens help
    to learn the weights where both are true.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    rows = ids_and_text(docs, id_col, text_col)
    n_rows, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    chunks = max(1, -(-chars // chunk_chars))
    # A token takes a character and the white space after it, at least.
    key_bits = min(64, max(40, int(chars // 2 + n_rows).bit_length() + 20))
    role = F.when(~training, 0).when(deleted, 2).otherwise(1)
    # Ids travel as text: pandas would make floats of longs beside nulls.
    dealt = rows.select(F.col("id").cast("string").alias("id"), "text", role.alias("role"), F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int").alias("chunk"))
    asked = dealt.groupBy("chunk").applyInPandas(lambda key, pdf: ask(key, pdf, chunks, key_bits, order), "range int, kind int, chunk int, keys binary, train binary, deleted binary")
    answers = asked.groupBy("range").applyInPandas(answer, "chunk int, range int, kind int, train binary, deleted binary, v long, v_kept long")
    looked = settle(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(lambda key, docs, answers: look_up(key, docs, answers, key_bits, order), LOOKED_UP), "ngram")

    sums = looked.agg(
        F.sum(F.when(F.col("role") > 0, F.col("n_tokens"))).alias("n"),
        F.sum(F.when(F.col("role") == 1, F.col("n_tokens"))).alias("n_kept"),
        F.sum("v").alias("v"),
        F.sum("v_kept").alias("v_kept"),
        F.sum((F.col("role") > 0).cast("long")).alias("starts"),
        F.sum((F.col("role") == 1).cast("long")).alias("starts_kept"),
    ).first()
    n, n_kept, v, v_kept, starts, starts_kept = (int(x or 0) for x in sums)

    def histogram(batches):
        total = np.zeros(0, dtype=np.int64)
        counts = np.zeros(0, dtype=np.int64)
        side = POWERS * FINE + 2
        for b in batches:
            parts = []
            for d in zip(*(c.to_pylist() for c in b.columns)):
                bucket, p = estimates(*map(unpacked, d), n_kept, starts_kept)
                for cell in map(_cells, p):
                    bucket = bucket * side + cell
                parts.append(bucket)
            if parts:
                keys, inverse = np.unique(np.concatenate([total, *parts]), return_inverse=True)
                counts = np.bincount(inverse, np.r_[counts, np.ones(len(inverse) - len(total), dtype=np.int64)], len(keys)).astype(np.int64)
                total = keys
        if len(total):
            cols = [total // side**3, total // side**2 % side, total // side % side, total % side, counts]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", "p3", "p2", "p1", "n"])

    held = looked.where("role = 2").select("d1", "d2", "d3").mapInArrow(histogram, "bucket long, p3 long, p2 long, p1 long, n long")
    # At most so many cells as buckets and powers allow, whatever the corpus; some ten thousand are met.
    keys = ["bucket", "p3", "p2", "p1"]
    cells = held.groupBy(*keys).agg(F.sum("n").alias("n")).toPandas().sort_values(keys)
    weights = learn_weights(cells, 1 / (v_kept + 1))

    def scored(batches):
        for b in batches:
            base, full = [], []
            for c in zip(*(x.to_pylist() for x in b.columns[4:7])):
                c1, c2, c3 = map(unpacked, c)
                base.append(float(np.log10((c1 + 1.0) / (n + v + 1.0)).sum()))
                bucket, p = estimates(c1, c2, c3, n, starts)
                w = weights[bucket]
                full.append(float(np.log10((w[:, :3].T * p).sum(0) + w[:, 3] / (v + 1)).sum()) if n else 0.0)
            out = [b.column(0), b.column(1), b.column(2), b.column(3), pa.array(base, pa.float64()), pa.array(full, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    final = looked.where("role >= 0").select(F.col("id").cast("long").alias("id"), (F.col("role") == 0).alias("held_out"), "n_tokens", "n_known", "c1", "c2", "c3")
    out = final.mapInArrow(scored, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n).cast("long"))
