"""Detect, apply, redact, report: DataFrame operators over a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.catalog import KINDS
from spanloom.functions.spans import let, spliced
from spanloom.operators.detectors import detectors_for
from spanloom.operators.resolve import DETECTIONS, resolve
from spanloom.options import RedactionOptions

DEFAULT = RedactionOptions()


def tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["length"].alias("length"), s["text"].alias("text")))


def candidates(text: Column, options: RedactionOptions = DEFAULT, registry=None) -> Column:
    """The spans of all enabled detectors, overlapping as they come."""
    found = [tagged(d(text), kind) for kind, d in detectors_for(options, registry).items()]
    none = F.array().cast(DETECTIONS)
    return F.coalesce(F.concat(none, *found).cast(DETECTIONS), none)


def detect(df: DataFrame, text: str = "text", options: RedactionOptions = DEFAULT, out: str = "detections", registry=None) -> DataFrame:
    """df with the resolved detections of a text column. Null and empty texts have none.

    Candidates are a column of their own, so that the detectors run once though the resolver reads them often.
    """
    return df.withColumn(out, candidates(F.col(text), options, registry)).withColumn(out, resolve(F.col(out)))


def applied(text: Column, detections: Column, options: RedactionOptions = DEFAULT) -> Column:
    """The text with every detection replaced by its kind's placeholder. Detections must be ordered and disjoint."""
    shape = F.create_map(*[F.lit(x) for k in KINDS for x in (k.name, options.placeholder_for(k.name))])
    end = lambda d: d["start"] + d["length"]

    def edited(found: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(end(F.get(found, i - 1)))
        wrong = F.exists(F.transform(found, lambda d, i: d["start"] < before(i)), lambda b: b) | (end(F.element_at(found, -1)) > F.length(text))
        edits = F.transform(found, lambda d, i: F.struct(before(i).alias("a"), d["start"].alias("z"), shape[d["kind"]].alias("put")))
        whole = F.concat(spliced(text, edits), F.substr(text, end(F.element_at(found, -1)) + 1))
        return F.when(wrong, F.raise_error(F.lit("detections overlap, are out of order or pass the end of the text")).cast("string")).otherwise(whole)

    return F.when(text.isNull() | (F.size(detections) == 0), text).otherwise(let(detections, edited))


def redact(df: DataFrame, text: str = "text", options: RedactionOptions = DEFAULT, out: str = "redacted_text", detections: str = "detections", registry=None) -> DataFrame:
    found = detect(df, text, options, detections, registry)
    return found.withColumn(out, applied(F.col(text), F.col(detections), options)).withColumn("total", F.size(detections))


def long_report(found: DataFrame, keys: list[str], detections: str = "detections") -> DataFrame:
    """(keys, kind, n): counts by kind, partially aggregated before the shuffle. Matched text never enters a report."""
    return found.select(*keys, F.explode(F.transform(detections, lambda d: d["kind"])).alias("kind")).groupBy(*keys, "kind").agg(F.count("*").alias("n"))


def merge_reports(reports: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return reports.groupBy(*(keys or []), "kind").agg(F.sum("n").cast("long").alias("n"))


def top_rows(report: DataFrame, group: list[str], keys: list[str], k: int) -> DataFrame:
    """The k rows of each group with the largest n, ties by the keys: a top-k report over counts, which are few."""
    order = Window.partitionBy(*group).orderBy(F.desc("n"), *keys)
    return report.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def report_map(detections: Column) -> Column:
    """MAP<kind, count> of one row, kinds sorted."""
    kinds = F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["kind"])))
    counts = F.transform(kinds, lambda k: F.size(F.filter(detections, lambda d: d["kind"] == k)))
    return F.map_from_arrays(kinds, counts)


def merge_maps(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def report_json(detections: Column) -> Column:
    """{"total": n, "counts": [{"kind": .., "count": ..}]} with kinds sorted."""
    entries = F.transform(F.map_entries(report_map(detections)), lambda e: F.struct(e["key"].alias("kind"), e["value"].alias("count")))
    return F.to_json(F.struct(F.size(detections).alias("total"), entries.alias("counts")))
