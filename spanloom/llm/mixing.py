"""Mixing sources to target weights by Poisson replication.

Each row is repeated as often as a Poisson variable says, found by inversion of the distribution at a point that a hash
of the row's id, text and the seed gives; its mean is the repetition rate that brings its source to the target share.
The repeated rows are put in a global pseudo-random order. Expected output: `rows_out` rows, shared by the weights.

Defined results: a null source is a source of its own; null and empty texts are rows like any other; rows that repeat
id and text get equal counts; sources without a given weight share what is left by the power `alpha` of their rows;
a source of weight zero gives no rows (its mean is zero); an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.spans import let
from spanloom.llm.common import SMALL_BYTES, fresh

SEED = 20260
#: The distribution is tabulated to this many standard deviations above its mean, and REACH more.
DEVIATIONS, REACH = 12.0, 40.0


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, rows_out: int | None = None, source: str = "source") -> DataFrame:
    """(mix_source, rate, cdf): for each source its mean repetitions and the cumulative Poisson probabilities of 0, 1, 2, ..."""
    counts = docs.groupBy(F.col(source).alias("mix_source")).agg(F.count("*").alias("n"))
    given = dict(weights or {})
    fixed = F.lit(None).cast("double")
    for name, w in given.items():
        fixed = F.when(F.col("mix_source") == name, F.lit(float(w))).otherwise(fixed)
    rest = max(0.0, 1.0 - sum(given.values()))
    counts = counts.withColumn("fixed", fixed).withColumn("power", F.when(F.col("fixed").isNull(), F.pow(F.col("n").cast("double"), F.lit(alpha))))
    totals = counts.agg(F.sum("n"), F.sum("power")).first()  # one row
    share = F.coalesce(F.col("fixed"), F.lit(rest) * F.col("power") / F.lit(float(totals[1] or 1.0)))
    out = float(rows_out if rows_out is not None else totals[0] or 0)
    named = counts.withColumn("rate", share * F.lit(out) / F.col("n"))
    top = F.ceil(F.col("rate") + DEVIATIONS * F.sqrt("rate") + REACH).cast("int")
    # log p(k) = k log rate - rate - log k!, then a running sum; both folds run once for each source.
    folded = F.aggregate(
        F.sequence(F.lit(0), top),
        F.struct(F.lit(0.0).alias("logfact"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("cdf")),
        lambda acc, k: _step(acc, k),
    )
    zero = F.array(F.lit(1.0))
    return named.select("mix_source", "rate", F.when(F.col("rate") > 0, folded["cdf"]).otherwise(zero).alias("cdf"))


def _step(acc: Column, k: Column) -> Column:
    logfact = acc["logfact"] + F.when(k > 0, F.log(k.cast("double"))).otherwise(F.lit(0.0))
    total = acc["total"] + F.exp(k * F.log("rate") - F.col("rate") - logfact)
    return F.struct(logfact.alias("logfact"), total.alias("total"), F.array_append(acc["cdf"], total).alias("cdf"))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts: 52 bits, at the middle of their cells."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(docs: DataFrame, weights=None, alpha: float = 0.5, rows_out: int | None = None, seed: int = SEED, source: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each row repeated, `copy` (1, 2, ...) and `repeats` added (renamed with a leading _ where taken), in global random order."""
    table = rates(docs, weights, alpha, rows_out, source)
    # A source's probabilities grow with its rate: what all of them take decides on the broadcast.
    size = table.agg(F.coalesce(F.sum(8 * F.size("cdf") + 64), F.lit(0))).first()[0]
    if size <= SMALL_BYTES:
        table = F.broadcast(table)
    copy, repeats, order = fresh(docs, "copy", "repeats", "order")
    joined = docs.join(table, F.col(source).eqNullSafe(F.col("mix_source")))
    point = uniform(F.lit(seed), F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    # let: the digest of the text is taken once for each row, not once for each entry of the table.
    counted = joined.withColumn(repeats, let(point, lambda p: F.size(F.filter("cdf", lambda c: c < p))))
    spread = counted.where(F.col(repeats) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(repeats))))
    ordered = spread.withColumn(order, F.xxhash64(F.lit(seed), F.col(id_col), F.col(copy), F.col(text_col)))
    return ordered.orderBy(order).select(*docs.columns, copy, repeats)
