"""The three routes of the original service as functions over DataFrames: catalogue, summary, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import catalog
from spanloom.operators.redact import detect, redact, report_json
from spanloom.options import parse_request


def categories(spark: SparkSession) -> DataFrame:
    """(category, kinds): every category with its kinds by priority."""
    rows = [(name, [k.name for k in catalog.KINDS if k.categories & mask]) for name, mask in catalog.CATEGORIES.items()]
    return spark.createDataFrame(rows, "category string, kinds array<string>")


def _options(request: dict):
    options, errors = parse_request(**request)
    if options is None:
        raise ValueError("; ".join(f"{k}: {v}" for k, v in sorted(errors.items())))
    return options


def summary(df: DataFrame, request: dict, text: str = "text") -> DataFrame:
    """df without its text, with the report of what a redaction would remove: counts only."""
    return detect(df, text, _options(request), "_found").withColumn("report", report_json(F.col("_found"))).drop(text, "_found")


def redacted(df: DataFrame, request: dict, text: str = "text") -> DataFrame:
    """df with its text redacted, the report and the total."""
    out = redact(df, text, _options(request), "_redacted", "_found").withColumn("report", report_json(F.col("_found")))
    return out.withColumn(text, F.col("_redacted")).drop("_redacted", "_found")
