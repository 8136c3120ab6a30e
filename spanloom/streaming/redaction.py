"""Streaming forms: detection is stateless, so the batch Columns serve streams; reports are windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.redact import DEFAULT, redact
from spanloom.options import RedactionOptions


def redact_stream(stream: DataFrame, text: str = "text", options: RedactionOptions = DEFAULT) -> DataFrame:
    return redact(stream, text, options)


def windowed_report(found: DataFrame, ts: str = "ts", window: str = "10 minutes", late: str = "10 minutes", detections: str = "detections") -> DataFrame:
    """(window_start, kind, n); rows later than the watermark are dropped by the engine."""
    kinds = found.withWatermark(ts, late).select(ts, F.explode(F.transform(detections, lambda d: d["kind"])).alias("kind"))
    return kinds.groupBy(F.window(ts, window), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "kind", "n")
