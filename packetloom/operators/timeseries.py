"""Binned, direction-split series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators import ordered

MAX_BINS = 500
METRICS = ("bytes", "packets", "window", "rtt", "tls_bytes")


def widen(duration_ms: float, bin_ms: float) -> float:
    """Double the width until at most MAX_BINS bins are left."""
    while duration_ms / bin_ms > MAX_BINS:
        bin_ms *= 2
    return bin_ms


def widened(duration: Column, bin_ms: float) -> Column:
    """widen() as an expression, for many series at once."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(60)), F.lit(float(bin_ms)), lambda w, _: F.when(duration / w > MAX_BINS, w * 2).otherwise(w))


def binned(rows: DataFrame, spans: DataFrame, keys: list[str], value: Column, how: str, bin_ms: float) -> DataFrame:
    """(keys, bin_ms, t_start_ms, forward, reverse) for every bin of every span.

    spans has one row a key with start_ms and duration_ms; its width is bin_ms, doubled until
    at most MAX_BINS are left, and its bins begin at start_ms. rows have the keys, time_ms and
    forward; what lies outside the span counts in its first or last bin. how is sum or
    median; where a bin holds no value that way, it is null. Rows are folded to bins before they meet the full list."""
    took = F.coalesce("duration_ms", F.lit(0.0))
    wide = spans.select(*keys, F.coalesce("start_ms", F.lit(0.0)).alias("__start"), widened(took, bin_ms).alias("bin_ms"), took.alias("__took"))
    wide = wide.withColumn("__n", F.greatest(F.lit(1), F.ceil(F.col("__took") / F.col("bin_ms")) + 1).cast("bigint"))
    spot = F.least(F.greatest(F.floor((F.col("time_ms") - F.col("__start")) / F.col("bin_ms")), F.lit(0)), F.col("__n") - 1).cast("bigint")
    held = rows.select(*keys, "time_ms", "forward", value.cast("double").alias("__v")).join(wide, keys).select(*keys, spot.alias("__bin"), "forward", "__v")
    if how == "median":
        held = ordered.median(held, [*keys, "__bin", "forward"], "__v", "__m").select(*keys, "__bin", "forward", F.round("__m", 3).alias("__v"))
    fold = F.sum if how == "sum" else F.max  # of one median
    held = held.groupBy(*keys, "__bin").agg(fold(F.when(F.col("forward"), F.col("__v"))).alias("forward"), fold(F.when(~F.col("forward"), F.col("__v"))).alias("reverse"))
    out = wide.select(*keys, "bin_ms", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)).alias("__bin")).join(held, [*keys, "__bin"], "left")
    return out.select(*keys, "bin_ms", (F.col("__bin") * F.col("bin_ms")).alias("t_start_ms"), "forward", "reverse")


def series_all(d: DataFrame, spans: DataFrame, keys: list[str], metric: str, bin_ms: float = 100) -> DataFrame:
    """The series of a metric for every key at once: bytes, packets and tls_bytes are summed;
    window and rtt are medians."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric '{metric}'. Allowed: {', '.join(METRICS)}")
    value, how = {
        "bytes": (F.col("len"), "sum"), "packets": (F.lit(1), "sum"), "tls_bytes": (F.col("tls_record_bytes"), "sum"),
        "window": (F.col("tcp_window"), "median"), "rtt": (F.col("ack_rtt") * 1000, "median"),
    }[metric]
    return binned(d, spans, keys, value, how, bin_ms)


def series(d: DataFrame, metric: str, start_ms: float, duration_ms: float, bin_ms: float = 100) -> tuple[DataFrame, float]:
    """series_all() for the directed rows of one conversation, and the width of its bins."""
    span = d.sparkSession.createDataFrame([(1, float(start_ms), float(duration_ms))], "one int, start_ms double, duration_ms double")
    out = series_all(d.withColumn("one", F.lit(1)), span, ["one"], metric, bin_ms)
    return out.select("t_start_ms", "forward", "reverse").orderBy("t_start_ms"), widen(duration_ms, bin_ms)
