"""Dissected rows from tab-separated text, and back-end reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.columns import whole
from packetloom.schema import DISSECTED, dissected_schema


def read_dissected(spark: SparkSession, path: str, fields: list[str] = DISSECTED, capture_id: str | None = None) -> DataFrame:
    """Tab-separated, unquoted, one row a frame; the schema is declared, never inferred.
    Without capture_id each file is a capture, named by its file name."""
    rows = spark.read.csv(path, sep="\t", quote="", schema=dissected_schema(fields), nullValue="")
    name = F.lit(capture_id) if capture_id else F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)
    return rows.withColumn("capture_id", name)


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """(name, title, type, protocol) of the fields that a dissector lists: tab-separated lines that
    begin with F (title, name, type, protocol follow); other lines are left out."""
    lines = spark.read.text(path).filter("value LIKE 'F\t%'").select(F.split("value", "\t").alias("x"))
    return lines.filter(F.size("x") > 4).select(F.col("x")[2].alias("name"), F.col("x")[1].alias("title"), F.col("x")[3].alias("type"), F.col("x")[4].alias("protocol")).filter("name <> ''")


def _column(name: str) -> Column:
    return F.trim(F.col(f"`{name}`"))


METADATA = {"File type": "format", "Number of packets": "packet_count", "Data size (bytes)": "data_size", "Capture duration (seconds)": "duration_s", "Start time": "start_time", "End time": "end_time"}


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A capture-metadata report (header and one row a file); a missing column is an error."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    if missing := [c for c in METADATA if c not in rows.columns]:
        raise ValueError(f"metadata report lacks column(s): {', '.join(missing)}")
    return rows.select(
        _column("File type").alias("format"), whole(_column("Number of packets")).alias("packet_count"), whole(_column("Data size (bytes)")).alias("data_size"),
        _column("Capture duration (seconds)").try_cast("double").alias("duration_s"), wall_clock(_column("Start time")).alias("start_epoch"), wall_clock(_column("End time")).alias("end_epoch"),
    )


def wall_clock(c: Column) -> Column:
    """`Y-M-D h:m:s.f` in the session's time zone (or epoch seconds) as epoch seconds."""
    return F.coalesce(c.try_cast("double"), F.unix_micros(F.try_to_timestamp(c)) / 1e6)


def human_size(c: Column) -> Column:
    """`4,745 bytes` or `1.5 MB` in bytes; units step by 1000."""
    n = F.regexp_replace(F.regexp_extract(c, r"([\d.,]+)", 1), ",", "").try_cast("double")
    unit = F.lower(F.regexp_extract(c, r"[\d.,]+\s*([kKMGT]?)", 1))
    power = F.create_map(*[x for k, v in (("", 1.0), ("k", 1e3), ("m", 1e6), ("g", 1e9), ("t", 1e12)) for x in (F.lit(k), F.lit(v))])
    return F.round(n * power[unit]).cast("bigint")


def protocol_report(lines: DataFrame) -> DataFrame:
    """(protocol, depth, frames, bytes) from hierarchy lines: two blanks a level."""
    v = F.col("value")
    hit = lines.filter(v.rlike(r"^\s*\S+\s+frames:\d+\s+bytes:\d+\s*$"))
    return hit.select(
        F.regexp_extract(v, r"^\s*(\S+)", 1).alias("protocol"), (F.length(F.regexp_extract(v, r"^(\s*)", 1)) / 2).cast("int").alias("depth"),
        F.regexp_extract(v, r"frames:(\d+)", 1).cast("bigint").alias("frames"), F.regexp_extract(v, r"bytes:(\d+)", 1).cast("bigint").alias("bytes"),
    )


_AMOUNT = r"(\d+)\s+([\d.,]+\s*(?:[kMGT]?B|bytes))"
CONVERSATION_LINE = re.compile(rf"^(\S+)\s+<->\s+(\S+)\s+{_AMOUNT}\s+{_AMOUNT}\s+{_AMOUNT}\s+([\d.,]+)\s+([\d.,]+)\s*$")


def conversation_report(lines: DataFrame, transport: str) -> DataFrame:
    """(transport, a, b, frames and bytes each way, start_s, duration_s) from endpoint-pair
    lines, whose first amount is b to a."""
    p = CONVERSATION_LINE.pattern
    part = lambda k: F.regexp_extract("value", p, k)
    return lines.filter(F.col("value").rlike(p)).select(
        F.lit(transport).alias("transport"), part(1).alias("a"), part(2).alias("b"), part(3).cast("bigint").alias("frames_b_to_a"), human_size(part(4)).alias("bytes_b_to_a"),
        part(5).cast("bigint").alias("frames_a_to_b"), human_size(part(6)).alias("bytes_a_to_b"),
        F.regexp_replace(part(9), ",", ".").cast("double").alias("start_s"), F.regexp_replace(part(10), ",", ".").cast("double").alias("duration_s"),
    )
