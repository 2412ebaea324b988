"""Tables written on the way, in the folder that a cluster's driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir (or the context's checkpoint directory). Only where
    neither is set, and only on a local master, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='packetloom-')}")


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written once as Parquet and read again: plans that use it several times start from
    the table, and a lost executor costs a re-read. It goes when the session ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/packetloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, system = _path(spark, path)
    system.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def gathered(parts: Iterable[DataFrame], tag: str) -> DataFrame:
    """The rows of parts of one schema, each written before the next is planned: the driver holds
    one plan at a time, with what it broadcasts, however many there are."""
    path = out = None
    for df in parts:
        if path is None:
            path = f"{folder(df.sparkSession)}/packetloom-{tag}-{uuid.uuid4().hex}"
            at, system = _path(df.sparkSession, path)
            system.deleteOnExit(at)
            out = df
        df.write.mode("append").parquet(path)
    if path is None:
        raise ValueError("nothing to gather")
    out = out.sparkSession.read.schema(out.schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    for df in tables:
        if path := getattr(df, "_written_at", None):
            at, system = _path(df.sparkSession, path)
            system.delete(at, True)
