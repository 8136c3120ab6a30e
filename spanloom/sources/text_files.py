"""Text files: bytes to text by their byte-order mark, and back in the same encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longer marks first: UTF-32LE starts like UTF-16LE.
MARKS = (("FFFE0000", "UTF-32LE"), ("0000FEFF", "UTF-32BE"), ("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"))


def encoding_of(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit("UTF-8")
    for mark, name in reversed(MARKS):
        out = F.when(head.startswith(mark), name).otherwise(out)
    return out


def mark_length(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit(0)
    for mark, _ in reversed(MARKS):
        out = F.when(head.startswith(mark), len(mark) // 2).otherwise(out)
    return out


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """files with encoding, has_bom and text; the whole file is one text (a CSV is not parsed)."""
    c = F.col(content)
    body = F.substr(c, mark_length(c) + 1)
    text = F.when(encoding_of(c) == "UTF-8", body.cast("string"))
    for name in ("UTF-16LE", "UTF-16BE"):
        text = text.when(encoding_of(c) == name, F.decode(body, name))
    text = text.otherwise(F.decode(c, "UTF-32"))  # this decoder reads the mark itself
    return files.withColumn("encoding", encoding_of(c)).withColumn("has_bom", mark_length(c) > 0).withColumn("text", text)


def encoded(text: Column, encoding: Column, has_bom: Column) -> Column:
    wide = F.encode(text, "UTF-32")  # big-endian, without a mark
    turned = F.unhex(F.regexp_replace(F.hex(wide), "(..)(..)(..)(..)", "$4$3$2$1"))
    out = F.lit(None).cast("binary")
    for mark, name in MARKS:
        body = {"UTF-32LE": turned, "UTF-32BE": wide}.get(name)
        body = F.encode(text, name) if body is None else body
        out = F.when((encoding == name) & has_bom, F.concat(F.unhex(F.lit(mark)), body)).when(encoding == name, body).otherwise(out)
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, encoding, has_bom, text) of all files under path."""
    return decoded(spark.read.format("binaryFile").load(path).select("path", "content"))
