"""Connected components by alternating stars, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link the neighbours of each node (small: the smaller ones) to the smallest of them.
    The minimum is pre-aggregated, written, and joined back; AQE can split both sides, so a
    node with very many neighbours doesn't hold a task up."""
    ends = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    near = ends.join(least, "a")
    if small:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    done = materialize(out.filter("a > b").distinct(), "star")
    discard(least)
    return done


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to one row (node, component) for each node of an edge; component
    is its smallest node. Loops and repeated edges do no harm, nor do edges with a null end,
    which are none; without edges it is empty."""
    turned = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = materialize(turned, "edges")
    state = _state(now)
    while state[0]:
        grown = _star(now, small=False)
        after = _star(grown, small=True)
        discard(now)
        discard(grown)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
