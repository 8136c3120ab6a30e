"""Lineage cuts: tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none, a temporary one on a single machine, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
    return sc.getCheckpointDir().rstrip("/")


def settle(df: DataFrame, label: str = "t") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later stages restart from files, not from its lineage."""
    path = f"{shared_folder(df.sparkSession)}/spanloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by settle() that nothing reads any more."""
    path = getattr(df, "_settled_at", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
