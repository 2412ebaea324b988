"""The light index: protocol hierarchy and endpoint pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hierarchy(rows: DataFrame, path: str = "protocols", size: str = "len", sep: str = ":") -> DataFrame:
    """(path, protocol, depth, frames, bytes): each row counts for every prefix of its path."""
    parts = F.split(path, sep)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))
    each = rows.filter(F.col(path).isNotNull()).select(F.explode(prefixes).alias("path"), F.col(size).alias("size"))
    out = each.groupBy("path").agg(F.count(F.lit(1)).alias("frames"), F.sum("size").alias("bytes"))
    return out.select("path", F.element_at(F.split("path", sep), -1).alias("protocol"), (F.size(F.split("path", sep)) - 1).alias("depth"), "frames", "bytes")


def pairs(f: DataFrame) -> DataFrame:
    """Frames and bytes each way between two endpoints; the smaller endpoint is a."""
    src, dst = F.struct("ip_src", "src_port"), F.struct("ip_dst", "dst_port")
    end = lambda s, ip, port: F.concat_ws(":", s[ip], s[port].cast("string"))
    d = f.filter("transport is not null").select("capture_id", "transport", "len", "epoch", end(src, "ip_src", "src_port").alias("s"), end(dst, "ip_dst", "dst_port").alias("d"))
    d = d.withColumns({"a": F.least("s", "d"), "b": F.greatest("s", "d"), "out": F.col("s") <= F.col("d")})
    n = lambda c: F.count_if(c).cast("bigint")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("len"))), F.lit(0)).cast("bigint")
    return d.groupBy("capture_id", "transport", "a", "b").agg(
        n(F.col("out")).alias("frames_a_to_b"), total(F.col("out")).alias("bytes_a_to_b"), n(~F.col("out")).alias("frames_b_to_a"), total(~F.col("out")).alias("bytes_b_to_a"),
        F.min("epoch").alias("start_epoch"), (F.max("epoch") - F.min("epoch")).alias("duration_s"),
    )
