"""Document fingerprints: threshold-scaled sketches. Every word-shingle hash below a fixed fraction of the hash range is kept.

Sketches of one fraction merge by union and give containment and Jaccard estimates between documents of very unequal
length. The least hash of all is carried too: it decides between two texts so short that neither keeps a hash.

Defined results: null text is the empty text, whose only shingle is empty; a text under k words is one shingle;
equal texts have equal fingerprints; repeated rows and ids stay; a null id counts as the least; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: One hash in SCALE is kept.
SCALE = 4
K = 5
#: Buckets of ids for each shuffle partition when neighbours are looked up.
BUCKETS_PER_PARTITION = 4


def words(text: Column) -> Column:
    return F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")


def shingle_hashes(w: Column, k: int = K) -> Column:
    rolling = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, rolling).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))


def with_sketch(df: DataFrame, text: str, least: str, kept: str, k: int = K, scale: int = SCALE) -> DataFrame:
    """df with the least shingle hash and the sorted array of distinct hashes below 1/scale of the unsigned range."""
    limit = (1 << 63) // scale  # compared after a shift that drops the sign bit
    below = lambda h: F.shiftrightunsigned(h, 1) < F.lit(limit)
    return (
        df.withColumn(kept, words(F.col(text)))
        .withColumn(kept, shingle_hashes(F.col(kept), k))
        .withColumn(least, F.array_min(kept))
        .withColumn(kept, F.array_sort(F.array_distinct(F.filter(kept, below))))
    )


def printed(least: Column, kept: Column) -> Column:
    hexed = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.concat(hexed(least), F.lit(":"), F.array_join(F.transform(kept, hexed), ""))


def merged(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null if a keeps no hash."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(least_a: Column, a: Column, least_b: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise((least_a == least_b).cast("double"))


def _bucket(value: Column, bounds: list) -> Column:
    """Number of sorted bounds below the value, by two levels of about the root of their count."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    under = lambda xs: F.size(F.filter(xs, lambda b: b < value))
    literal = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    block = under(literal([g[-1] for g in groups]))
    inside = F.coalesce(under(F.get(F.array(*[literal(g) for g in groups]), block)), F.lit(0))
    return F.when(value.isNull(), F.lit(-1)).otherwise(block * step + inside)


#: Nulls count as the least id.
LEAST_ID = -(1 << 63)
#: A bucket has at most so many pieces by hash (a power of two).
PIECES = 1 << 20


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (id, text) with `tie`, a hash of the text, and `bucket`: ids cut at approximate quantiles, rows of one id that fills
    several quantiles cut by their hash. Order by bucket, id and tie is order by id and tie."""
    buckets = BUCKETS_PER_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    place = F.coalesce("id", F.lit(LEAST_ID))
    bounds = sorted(rows.agg(F.percentile_approx(place, cuts, F.lit(20 * buckets))).first()[0] or [])
    heavy = {b: bounds.count(b) + 1 for b in set(bounds) if bounds.count(b) > 1}
    share = F.shiftrightunsigned(F.col("tie").bitwiseXOR(F.lit(LEAST_ID)), 44)  # 20 bits, in the order of tie
    piece = F.lit(0)
    if heavy:
        times = F.create_map(*[F.lit(x).cast("long") for kv in heavy.items() for x in kv])
        piece = F.coalesce(1 + F.shiftright(share * times[place], 20), F.lit(0))
    out = rows.withColumn("tie", F.xxhash64("text"))
    return out.withColumn("bucket", _bucket(place, sorted(set(bounds))) * F.lit(PIECES).cast("long") + piece)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, scale: int = SCALE) -> DataFrame:
    """(id, text, least, kept, next): each document and its sketch, beside those of the next by descending id.

    Equal ids are ordered by a hash of the text; after the last comes the first. Rows are dealt into buckets and looked
    ahead inside each, so that no window holds the table, however often one id repeats; the first row of each bucket (as
    many rows as there are buckets, a number set by the partitions) is what the last row of the bucket before it looks at.
    Every text is sketched once and travels with its sketch.
    """
    rows = _dealt(docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")))
    one = F.struct("text", "least", "kept")
    head = F.struct(F.coalesce("id", F.lit(LEAST_ID)), "tie")
    heads = rows.groupBy("bucket").agg(F.max(head).alias("head")).withColumnRenamed("bucket", "head_bucket")
    firsts = rows.join(F.broadcast(heads), (F.col("bucket") == F.col("head_bucket")) & (head == F.col("head"))).groupBy("bucket").agg(F.min("text").alias("text"))
    # As many rows as buckets: one window over them is bounded.
    down = Window.orderBy(F.desc("bucket"))
    following = F.coalesce(F.lead(one).over(down), F.first(one).over(down))
    ring = with_sketch(firsts, "text", "least", "kept", k, scale).select(F.col("bucket").alias("ring_bucket"), following.alias("ring"))
    order = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("id"), F.desc("tie"), "text")
    ahead = with_sketch(rows, "text", "least", "kept", k, scale).withColumn("ahead", F.lead(one).over(order))
    out = ahead.join(F.broadcast(ring), F.col("bucket") == F.col("ring_bucket"), "left")
    return out.select("id", "text", "least", "kept", F.coalesce("ahead", "ring").alias("next"))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_text, sketches and likenesses): each text against itself with its second half from the next document."""
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars") - half), F.substr("next.text", F.lit(1), half))
    rows = with_sketch(rows.withColumn("edited_text", edited), "edited_text", "edited_least", "edited_kept")
    return rows.select(
        "id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_text",
        printed(F.col("least"), F.col("kept")).alias("fingerprint"),
        printed(F.col("edited_least"), F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("least"), F.col("kept"), F.col("edited_least"), F.col("edited_kept")).alias("near_edited"),
        likeness(F.col("least"), F.col("kept"), F.col("next.least"), F.col("next.kept")).alias("near_next"),
    )
