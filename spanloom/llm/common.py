"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch of whole texts: bounds a Python worker's memory when texts are long.
TEXT_BATCH_ROWS = 1024


def text_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch rows to TEXT_BATCH_ROWS where they are larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as `id` and the whole text as UTF-8 `text`; a null text becomes the empty text. Other columns are left out."""
    text_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def bucket_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, for helper columns beside a caller's own."""
    out = []
    for name in names:
        while name in df.columns or name in out:
            name = "_" + name
        out.append(name)
    return out


#: Up to so many rows and bytes a side of a join is broadcast; beyond, both sides are shuffled.
SMALL_ROWS, SMALL_BYTES = 1_000_000, 32 << 20


def small(df: DataFrame, *strings: str) -> DataFrame:
    """df marked for a broadcast if it is within SMALL_ROWS and SMALL_BYTES: 16 bytes for each column, and the given columns' own size."""
    size = F.lit(16 * len(df.columns))
    for c in strings:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    n, total = df.limit(SMALL_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= SMALL_ROWS and total <= SMALL_BYTES else df
