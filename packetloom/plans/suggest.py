"""Names like given ones, for whole columns against vocabularies of any size.

A symmetric-delete index: two names within `most` edits share a form that some deletions make of
the beginning of either. So candidates meet in an equi-join, and the exact distance is computed
for them alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.ordered import first

#: Edits at most, and characters from the beginning whose deletions are indexed.
MOST, BEGINNING = 2, 8


def forms(name: Column, most: int = MOST) -> Column:
    """The beginning of a name and all that up to `most` deletions make of it."""
    one = lambda w: F.transform(F.filter(F.sequence(F.lit(0), F.length(w)), lambda i: i > 0), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    level = F.array(F.substring(name, 1, BEGINNING))
    out = level
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, one)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def index(names: DataFrame, col: str, most: int = MOST) -> DataFrame:
    """(form, name): a table worth keeping where many columns are looked up. Nulls are left out."""
    return names.select(F.col(col).alias("name")).filter("name is not null").distinct().select(F.explode(forms(F.col("name"), most)).alias("form"), "name")


def nearest(asked: DataFrame, col: str, indexed: DataFrame, most: int = MOST, k: int = 3) -> DataFrame:
    """(asked, rank, name, distance): for each different value of the column the k known names
    with the fewest edits, at most `most` (that of the index), ties by name. Values without
    one, and nulls, have no row; a known value is its own first suggestion."""
    words = asked.select(F.col(col).alias("asked")).filter("asked is not null").distinct()
    hits = words.select("asked", F.explode(forms(F.col("asked"), most)).alias("form")).join(indexed, "form").select("asked", "name").distinct()
    near = hits.withColumn("distance", F.levenshtein("asked", "name", most)).filter("distance >= 0")
    best = first(near, ["asked"], ["distance", "name"], k)
    rank = F.expr("transform(array_sort(collect_list(struct(distance, name))), (x, i) -> struct(i + 1 AS rank, x.name AS name, x.distance AS distance))")
    return best.groupBy("asked").agg(rank.alias("x")).select("asked", F.explode("x").alias("x")).select("asked", "x.rank", "x.name", "x.distance")


def misspelt(asked: DataFrame, col: str, indexed: DataFrame) -> DataFrame:
    """The different values that no known name equals."""
    return asked.select(F.col(col).alias("asked")).filter("asked is not null").distinct().join(indexed.select("name").distinct(), F.col("asked") == F.col("name"), "left_anti")
