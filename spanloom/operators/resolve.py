"""Overlap resolution: longest span first, then the lower priority number, then the earlier start; kept spans never overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.catalog import KINDS
from spanloom.functions.spans import SPANS, islands, let

DETECTIONS = "array<struct<kind:string,start:int,length:int,text:string>>"
PRIORITY = {k.name: k.priority for k in KINDS}


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["start"] + b["length"]) & (b["start"] < a["start"] + a["length"])


def _greedy(chain: Column, rank) -> Column:
    """One chain of overlapping spans -> those that stay, in the order of their starts. rank: what a span is preferred by."""
    order = lambda s: F.struct((-s["length"]).alias("size"), rank(s).alias("priority"), s["start"].alias("start"), s.alias("s"))
    add = lambda acc, x: F.when(F.exists(acc, lambda y: _overlaps(x["s"], y)), acc).otherwise(F.array_append(acc, x["s"]))
    return F.array_sort(F.aggregate(F.array_sort(F.transform(chain, order)), F.slice(chain, 1, 0), add))


def _kept(spans: Column, rank) -> Column:
    """Spans (start first among their fields) of any order -> those that stay. Only spans of one chain are held against each other."""
    each = lambda c: F.when(F.size(c) > 1, _greedy(c, rank)).otherwise(c)
    return let(F.array_sort(spans), lambda s: F.flatten(F.transform(islands(s), each)))


def resolve_spans(spans: Column) -> Column:
    """Spans of one kind."""
    return let(spans, lambda s: F.when(F.size(s) > 1, _kept(s, lambda x: F.lit(0))).otherwise(s)).cast(SPANS)


def resolve(detections: Column) -> Column:
    """Detections of any kinds: ordered by start, none overlapping. Adjacent spans do not overlap.

    Work grows in proportion to the detections, and inside one chain of overlapping ones with those that it keeps.
    """
    return let(detections, lambda d: F.when(F.size(d) > 1, _resolve(d)).otherwise(d)).cast(DETECTIONS)


def _resolve(detections: Column) -> Column:
    priority = F.expr("map(" + ", ".join(f"'{k}', {n}" for k, n in PRIORITY.items()) + ")")
    by_start = F.transform(detections, lambda d: F.struct(d["start"].alias("start"), d["length"].alias("length"), d["kind"].alias("kind"), d["text"].alias("text")))
    kept = _kept(by_start, lambda s: F.coalesce(priority[s["kind"]], F.lit(999)))
    return F.transform(kept, lambda d: F.struct(d["kind"].alias("kind"), d["start"].alias("start"), d["length"].alias("length"), d["text"].alias("text")))
