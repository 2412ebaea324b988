"""Nested JSON documents as relational tables, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.registry import EVENT_TYPES
from packetloom.schema import EVENTS


def read_list(spark: SparkSession, path: str, field: str, element: T.DataType | str) -> DataFrame:
    """One row for each element of the array `field` of each document; a missing or null array
    gives no rows."""
    kind = element if isinstance(element, str) else element.simpleString()
    return spark.read.schema(f"{field} array<{kind}>").json(path, multiLine=True).select(F.inline(field))


def explode_json(rows: DataFrame, col: str, element: str, keep: list[str]) -> DataFrame:
    """Elements of a JSON text column of arrays; what doesn't parse gives no rows."""
    return rows.select(*keep, F.explode(F.from_json(col, f"array<{element}>")).alias("element"))


EVENT = "struct<event_id string, conversation_id string, type string, time_ms double, direction string, detection string, frame_number bigint, attributes map<string, string>>"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events whose attributes are an open map, flattened to the typed attr_* columns."""
    rows = read_list(spark, path, "events", EVENT)
    known = sorted({a for t in EVENT_TYPES.values() for a in t.attributes})
    attr = lambda f: F.try_element_at("attributes", F.lit(f.name[5:])).try_cast(f.dataType).alias(f.name)
    assert all(f"attr_{a}" in EVENTS.names for a in known)
    return rows.select(*(attr(f) if f.name.startswith("attr_") else F.col(f.name) for f in EVENTS.fields))
