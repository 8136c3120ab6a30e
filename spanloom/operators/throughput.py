"""Throughput estimates, fixed-window throttling and limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rate before any sample, samples that count, least estimate in seconds.
DEFAULT_RATE, SAMPLES, LEAST_SECONDS = 2_000_000.0, 20, 1.0


def estimates(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """samples (.., bytes, seconds) with `estimate`: seconds that the row's bytes should take at the rate of the 20 samples before it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-SAMPLES, -1)
    seconds = F.sum("seconds").over(w)
    rate = F.when(seconds > 0, F.sum("bytes").over(w) / seconds).otherwise(DEFAULT_RATE)
    return samples.withColumn("estimate", F.greatest(F.lit(LEAST_SECONDS), F.col("bytes") / F.when(rate > 0, rate).otherwise(DEFAULT_RATE)))


def throttle(events: DataFrame, partition: list[str], ts: str, tie: list[str], permits: int = 60, seconds: int = 60) -> DataFrame:
    """events with `window_start` (epoch-aligned), `place` in it and `allowed`: the first `permits` of each partition and window."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))
    start = (F.floor(micros / F.lit(seconds * 1_000_000)) * seconds).cast("long")
    w = Window.partitionBy(*partition, "window_start").orderBy(ts, *tie)
    return events.withColumn("window_start", start).withColumn("place", F.row_number().over(w)).withColumn("allowed", F.col("place") <= permits)


@dataclass(frozen=True)
class DocumentLimits:
    max_decoded_bytes: int = 64 << 20
    max_total_decoded_bytes: int = 1 << 30
    max_text_chars: int = 5_000_000
    max_pages: int = 2_000

    def __post_init__(self):
        for name in self.__dataclass_fields__:
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")


#: HTTP status by what went wrong.
STATUS = {"unsupported": 415, "invalid": 422, "empty": 422, "too_large": 413}


def status_code(error: str | None) -> int:
    return 200 if error is None else STATUS.get(error, 400)


#: The most that one encoded byte can decode to, by filter.
EXPANSION = {"FlateDecode": 1032, "LZWDecode": 2560, "RunLengthDecode": 64}


def within_decode_limits(streams: DataFrame, limits: DocumentLimits = DocumentLimits()) -> DataFrame:
    """streams (doc_id, stream_id, filter, encoded_bytes) with `bound`, the document's running total and `status`.

    Filters of other names count as their encoded size. A stream over its cap, or one with which its document's total
    passes the budget, is too_large.
    """
    ratio = F.lit(1)
    for name, times in EXPANSION.items():
        ratio = F.when(F.col("filter") == name, times).otherwise(ratio)
    running = F.sum("bound").over(Window.partitionBy("doc_id").orderBy("stream_id").rowsBetween(Window.unboundedPreceding, 0))
    out = streams.withColumn("bound", (F.col("encoded_bytes") * ratio).cast("long")).withColumn("running_bytes", running)
    over = (F.col("bound") > limits.max_decoded_bytes) | (F.col("running_bytes") > limits.max_total_decoded_bytes)
    return out.withColumn("status", F.when(over, "too_large").otherwise("ok"))
