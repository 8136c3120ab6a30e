"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are linked when they differ in at most `radius` bits; classes are the connected components of all links.

Two searches share the bit-sliced comparison (bitslice.near_pairs):

* exact_links: every pair within a small radius. The 64 bits are cut in radius + 2 blocks; two fingerprints within the
  radius agree on two whole blocks at least, so rows meet under the value of each pair of blocks.
* probable_links: pairs within a wide radius of longer fingerprints. Rows meet under keys of least shingle hashes (bands of
  min-wise hashes): two texts share a band with the power `ROWS` of their similarity, so texts that have nothing in
  common do not meet, however many there are, and the number of keys does not depend on the corpus.

A meeting place with more than `tile` rows is cut into tiles and every pair of tiles is compared in a task of its own,
so no group is held whole and no pair is lost. A task reports a spanning forest of the links that it found, which
has the components of all its links and at most one row for each fingerprint.

Defined results: null text is the empty text; a text without words has fingerprint zero and links like any other;
fewer words than a shingle are one shingle; repeated rows and ties each keep their row; a null id is kept and never
names a component unless nothing else can (then the component is null); an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spanloom.llm.bitslice import Forest
from spanloom.llm.bitslice import near_classes as sliced_classes
from spanloom.llm.common import fresh, ids_and_text, small
from spanloom.llm.components import components
from spanloom.scratch import discard, settle

#: Rows of one meeting place that a task compares at once.
TILE = 8192
#: Rows read before groups are compared together.
BATCH = 65536


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included; A-Z lower-cased, words split at ASCII white space."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    if len(w) < k:
        w, k = [b" ".join(w)], 1
    shingles = map(b" ".join, zip(*(w[i:] for i in range(k)))) if k > 1 else w
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64, count=len(w) - k + 1)


def majority_bits(h: np.ndarray) -> np.ndarray:
    """[n, W] uint64 -> [W] uint64 with each bit that over half the rows have."""
    n, width = h.shape
    if not n:
        return np.zeros(width, dtype=np.uint64)
    total = np.zeros(64 * width, dtype=np.int64)
    for at in range(0, n, 255):  # 255 ones fit a byte
        part = np.ascontiguousarray(h[at : at + 255]).view(np.uint8)
        total += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > n, bitorder="little").view(np.uint64)


def widened(h: np.ndarray, width: int) -> np.ndarray:
    """[n] hashes -> [n, width] independent hashes by a 64-bit finaliser with one odd constant for each column."""
    x = h + (np.uint64(0x9E3779B97F4A7C15) * np.arange(1, width + 1, dtype=np.uint64))[:, None]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x.T


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, w0) for every row: the plain 64-bit SimHash of XXH64, repeats included, as a signed long."""

    def kernel(batches):
        for b in batches:
            out = np.zeros((b.num_rows, 1), dtype=np.uint64)
            for i, t in enumerate(b.column(1).cast(pa.binary())):
                out[i] = majority_bits(shingle_hashes(t.as_py(), k).reshape(-1, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[:, 0].view(np.int64))], names=["id", "w0"])

    return ids_and_text(docs, id_col, text_col).mapInArrow(kernel, "id long, w0 long")


#: Bands of least hashes and hashes in a band: a pair of similarity 0.8 shares a band with a chance of 0.998.
BANDS, ROWS = 12, 4
#: Shingles whose hashes are mixed at once: bounds memory on long texts.
MIXED_AT_ONCE = 8192


def band_keys(h: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Distinct shingle hashes -> [bands] keys, each a hash of `rows` least hashes under permutations of its own."""
    least = np.full(bands * rows, ~np.uint64(0))
    for at in range(0, len(h), MIXED_AT_ONCE):
        np.minimum(least, widened(h[at : at + MIXED_AT_ONCE], bands * rows).min(axis=0), out=least)
    out = np.arange(bands, dtype=np.uint64)
    for c in range(rows):
        x = (out ^ least.reshape(bands, rows)[:, c]) * np.uint64(0xD6E8FEB86659FD93)
        out = x ^ (x >> np.uint64(32))
    return out


def keyed_fingerprints(docs: DataFrame, k: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, w0 .., b0 ..) for every row: SimHash words of the distinct shingles, and the keys of their bands."""

    def kernel(batches):
        for b in batches:
            words, keys = np.zeros((b.num_rows, width), dtype=np.uint64), np.zeros((b.num_rows, BANDS), dtype=np.uint64)
            for i, t in enumerate(b.column(1).cast(pa.binary())):
                h = np.unique(shingle_hashes(t.as_py(), k))
                words[i], keys[i] = majority_bits(widened(h, width)), band_keys(h)
            cols = [pa.array(np.ascontiguousarray(m[:, c]).view(np.int64)) for m in (words, keys) for c in range(m.shape[1])]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", *(f"w{c}" for c in range(width)), *(f"b{c}" for c in range(BANDS))])

    names = [*(f"w{c}" for c in range(width)), *(f"b{c}" for c in range(BANDS))]
    return ids_and_text(docs, id_col, text_col).mapInArrow(kernel, "id long, " + ", ".join(f"{n} long" for n in names))


def _named(node: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    """Links (a, b) of every row to the least node of its class: tasks that meet one group agree on its centre more often."""
    least = node.copy()
    np.minimum.at(least, root, node)
    b = least[root]
    at = np.flatnonzero(node != b)
    return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(b[at])], names=["a", "b"])


def _compare(rows: DataFrame, width: int, radius: int) -> DataFrame:
    """rows (key .., node, w0 ..), equal keys adjacent in a partition and at most TILE-bounded -> forest links (a, b)."""
    keys = len(rows.columns) - 1 - width

    def kernel(batches):
        def links(t):
            change = np.zeros(t.num_rows, dtype=bool)
            for c in range(keys):
                v = t.column(c).to_numpy()
                change[1:] |= v[1:] != v[:-1]
            node = t.column(keys).to_numpy()
            words = np.stack([t.column(keys + 1 + c).to_numpy().view(np.uint64) for c in range(width)], axis=1)
            return _named(node, sliced_classes(np.cumsum(change), words, radius))

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < BATCH:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            tail = 1  # rows of the last, maybe unfinished group
            last = [t.column(c)[n - 1].as_py() for c in range(keys)]
            diff = np.zeros(n, dtype=bool)
            for c in range(keys):
                diff |= t.column(c).to_numpy() != last[c]
            whole = np.flatnonzero(diff)
            tail = n - (whole[-1] + 1 if len(whole) else 0)
            if tail < n:
                yield links(t.slice(0, n - tail))
            held, n = t.slice(n - tail).to_batches(), tail
        if n:
            yield links(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(kernel, "a long, b long")


def _meet(keyed: DataFrame, width: int, radius: int, tile: int) -> DataFrame:
    """keyed (key, node, w0 ..): links of nodes that share a key. Places with over `tile` rows are compared by pairs of tiles."""
    words = [f"w{c}" for c in range(width)]
    sized = keyed.withColumn("n", F.count("*").over(Window.partitionBy("key")))
    light = _compare(sized.where(F.col("n") <= tile).select("key", "node", *words), width, radius)
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("node"), tiles).cast("int")
    heavy = (
        sized.where(F.col("n") > tile)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .select("key", F.least("own", "other").alias("ta"), F.greatest("own", "other").alias("tb"), "node", *words)
        .repartition("key", "ta", "tb")
        .sortWithinPartitions("key", "ta", "tb")
    )
    return light.unionByName(_compare(heavy, width, radius))


def exact_links(prints: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """prints (node, w0), distinct fingerprints -> forest (a, b) of all links within radius bits of 64."""
    parts = radius + 2
    edges = [64 * i // parts for i in range(parts + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keyed = []
    for t, (a, b) in enumerate(combinations(blocks, 2)):
        value = F.col("w0").bitwiseAND(F.lit(signed(a | b)))
        keyed.append(F.struct(F.lit(t).alias("t"), value.alias("v")))
    rows = prints.select(F.explode(F.array(*keyed)).alias("key"), "node", "w0").select(
        F.xxhash64("key.t", "key.v").alias("key"), "node", "w0"
    )
    return _meet(rows, 1, radius, tile)


def wide_radius(similarity: float, bits: int, slack: float) -> int:
    """Differing bits of two SimHashes that a pair of this similarity passes with a chance of `slack` standard deviations and more.

    A bit differs with a chance of acos(2J / (1 + J)) / pi between large sets of one size; between sets of a few shingles it
    is up to a quarter more, which is allowed for.
    """
    flip = min(0.4, 1.25 * math.acos(2 * similarity / (1 + similarity)) / math.pi)
    return math.floor(bits * flip + slack * math.sqrt(bits * flip * (1 - flip)))


def probable_links(prints: DataFrame, width: int, similarity: float, slack: float, tile: int) -> DataFrame:
    """prints (node, w0 .., b0 ..) -> forest (a, b) of links that may have the similarity: rows that share a band and lie within the wide radius."""
    keys = F.array(*[F.xxhash64(F.lit(c), f"b{c}") for c in range(BANDS)])
    rows = prints.select(F.explode(keys).alias("key"), "node", *(f"w{c}" for c in range(width)))
    return _meet(rows, width, wide_radius(similarity, 64 * width, slack), tile)


def jaccard_classes(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Root of each set's class under all pairs whose Jaccard similarity reaches `similarity`.

    A set is held against the first set of each class before it; only if it misses one of them are its overlaps with all
    sets before it counted, over postings. So a dense class costs one comparison a set.
    """
    sizes = np.array([len(s) for s in sets])
    hashes, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(ids, kind="stable")
    postings = owner[order]
    start = np.searchsorted(ids[order], np.arange(len(hashes) + 1))
    classes = Forest(len(sets))
    flag = np.zeros(len(hashes), dtype=bool)
    for i in range(1, len(sets)):
        own = ids[ends[i] - sizes[i] : ends[i]]
        flag[own] = True
        firsts = np.flatnonzero(classes.root[:i] == np.arange(i))
        near = []
        for f in firsts.tolist() if len(firsts) <= 4 else ():
            overlap = int(flag[ids[ends[f] - sizes[f] : ends[f]]].sum())
            if overlap >= similarity * (sizes[f] + sizes[i] - overlap):
                near.append(f)
        flag[own] = False
        if len(near) < len(firsts):
            counts = start[own + 1] - start[own]
            at = np.repeat(start[own] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
            overlap = np.bincount(postings[at], minlength=len(sets))[:i]
            near = np.flatnonzero(overlap >= similarity * (sizes[:i] + sizes[i] - overlap))
        if len(near):
            classes.join(np.asarray(near), np.full(len(near), i))
    return classes.root


def _proved(members: DataFrame, k: int, similarity: float, tile: int) -> DataFrame:
    """members (class, n, node, text) of candidate classes with n nodes -> forest (a, b) of their links of exact Jaccard similarity.

    Classes of more than `tile` nodes are compared by pairs of tiles, each in a task of its own.
    """
    tiles = F.ceil(F.col("n") / tile).cast("int")
    rows = (
        members.withColumn("own", F.pmod(F.xxhash64("node"), tiles).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
        .select("class", F.least("own", "other").alias("ta"), F.greatest("own", "other").alias("tb"), "node", "text")
        .repartition("class", "ta", "tb")
        .sortWithinPartitions("class", "ta", "tb")
    )

    def kernel(batches):
        def links(nodes, sets):
            root = jaccard_classes(sets, similarity) if len(nodes) > 1 else np.zeros(1, dtype=np.int64)
            return _named(np.array(nodes, dtype=np.int64), root)

        last, nodes, sets = None, [], []
        for b in batches:
            group = list(zip(*(b.column(c).to_pylist() for c in range(3))))
            for g, node, t in zip(group, b.column(3).to_pylist(), b.column(4).cast(pa.binary())):
                if g != last and nodes:
                    yield links(nodes, sets)
                    nodes, sets = [], []
                last = g
                nodes.append(node)
                h = np.unique(shingle_hashes(t.as_py(), k))
                sets.append(h if len(h) else np.zeros(1, dtype=np.uint64))
        if nodes:
            yield links(nodes, sets)

    return rows.mapInArrow(kernel, "a long, b long")


def near_classes(docs: DataFrame, radius: int = 2, k: int = 3, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """(id, fp, component): each row's 64-bit SimHash and the smallest id that it reaches over links of `radius` bits or fewer."""
    prints = settle(fingerprints(docs, k, id_col, text_col), "simhash")
    nodes = prints.groupBy("w0").agg(F.min("id").alias("least"))
    graph = components(exact_links(nodes.select(F.col("w0").alias("node"), "w0"), radius, tile))
    named = nodes.join(graph, nodes.w0 == graph.node, "left").select("w0", "least", F.coalesce("root", "w0").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component"))
    classes = named.join(names, "root").select(F.col("w0").alias("fp"), "component")
    return prints.withColumnRenamed("w0", "fp").join(classes, "fp").select("id", "fp", "component")


def drop_near_duplicates(
    docs: DataFrame,
    similarity: float = 0.8,
    k: int = 5,
    width: int = 2,
    slack: float = 4.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    tile: int = TILE,
    proof_tile: int = 512,
) -> DataFrame:
    """docs with one row of each near-duplicate class: that of the smallest id (null last), ties by a hash of the text.

    Classes join texts whose k-word shingle sets have the Jaccard similarity or more; equal texts always share a class.
    SimHash finds candidate classes, and inside them every pair is proved on its whole shingle sets. Every column of docs
    is kept. Texts are named by 64 bits; where two texts share those, a second hash keeps all but one of them out of every class,
    so none goes for another's sake.
    """
    key, other, rank, n = fresh(docs, "text_key", "other_key", "rank_id", "row_count")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumn(key, F.xxhash64(text, F.length(text))).withColumn(other, F.xxhash64(F.lit(2), text))
    # One fingerprint for each text: equal texts meet by a partial aggregation on their hash.
    prints = settle(keyed_fingerprints(keyed.select(F.col(key).alias("node"), text.alias("body")), k, width, "node", "body").dropDuplicates(["id"]), "simhash")
    candidates = components(probable_links(prints.withColumnRenamed("id", "node"), width, similarity, slack, tile))
    sized = settle(candidates.join(candidates.groupBy("root").agg(F.count("*").alias("n")), "root").select(F.col("root").alias("class"), "n", "node"), "classes")
    texts = keyed.select(F.col(key).alias("node"), text.alias("text")).join(small(sized.select("node")), "node", "left_semi").dropDuplicates(["node"])
    graph = components(_proved(sized.join(texts, "node").select("class", "n", "node", "text"), k, similarity, proof_tile))

    counted = settle(keyed.select(F.col(id_col).cast("long").alias("id"), F.col(key).alias("key"), F.col(other).alias("other")).groupBy("key", "other", "id").agg(F.count("*").alias("n")), "texts")
    # Keys that two texts share (next to none): all but the least second hash stand alone.
    shared = counted.select("key", "other").distinct().groupBy("key").agg(F.min("other").alias("first_other"), F.count("*").alias("texts")).where("texts > 1")
    members = settle(
        counted.join(graph.select(F.col("node").alias("key"), "root"), "key", "left")
        .join(small(shared.select("key", "first_other")), "key", "left")
        .withColumn("class", F.struct(F.coalesce("root", "key").alias("root"), F.when(F.col("other") != F.col("first_other"), F.col("other")).alias("alone")))
        .select("class", "key", "other", "id", "n"),
        "members",
    )
    order = F.struct(F.col("id").isNull(), "id", "key", "other")
    first = members.groupBy("class").agg(F.min_by(F.struct("key", "other", "id"), order).alias("kept"), F.sum("n").alias("rows")).where("rows > 1")
    first = settle(first.select("class", "kept"), "firsts")
    marked = members.join(small(first.select(F.col("class").alias("in_class"), "kept")), F.col("class").eqNullSafe(F.col("in_class")))
    marked = marked.withColumn("keep", F.struct("key", "other", "id").eqNullSafe(F.col("kept")))
    marked = settle(marked.where("not keep or n > 1").select(F.col("key").alias(key), F.col("other").alias(other), F.col("id").alias(rank), F.col("n").alias(n), "keep"), "marked")
    for t in (prints, sized, counted, members, first):
        discard(t)

    def rows(which, how):
        on = (keyed[key] == which[key]) & (keyed[other] == which[other]) & keyed[id_col].cast("long").eqNullSafe(which[rank])
        return keyed.join(small(which), on, how)

    out = rows(marked.select(key, other, rank), "left_anti")
    again = marked.where("keep").select(key, other, rank)
    if again.limit(1).count():  # chosen rows that repeat id and text: one of them stays
        out = out.unionByName(rows(again, "left_semi").dropDuplicates([id_col, key, other]))
    return out.select(*docs.columns)
