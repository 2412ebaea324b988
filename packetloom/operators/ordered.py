"""Order over groups of any size: numbers, prefix scans, medians, nearest matches.

laid() sorts rows by range of (keys, order): a short group lies in one range, a long one in
several, and no task has more than a range. All else is two steps over it: fold each part of a
group, scan the folds (a row for each group and range), and finish inside the ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.stage import written

#: Bits that monotonically_increasing_id() leaves for the place inside a partition.
PLACE = 33
#: Parts of a group whose first rows are looked for side by side.
SALTS = 64
KINDS = ("sum", "min", "max", "first", "last")
_BEFORE = (Window.unboundedPreceding, -1)


def laid(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """df, written in the order of keys and order with __range and __at: the number of the range
    and the place inside it, from 0. Ranges are cut at quantiles of the whole key, so neither a
    long group nor a burst of equal times fills one, as long as the order tells rows apart;
    rows that it doesn't tell apart lie in one range in any order. Nulls lie as the order says
    (first, for plain names)."""
    cols = [F.col(k) for k in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    place = F.monotonically_increasing_id()
    return written(rows.select("*", F.shiftright(place, PLACE).cast("int").alias("__range"), place.bitwiseAND(F.lit((1 << PLACE) - 1)).alias("__at")), "laid")


def placed(x: DataFrame, name: str = "__pos") -> DataFrame:
    """laid rows with their place over all, from 0."""
    starts = x.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))  # a row a range
    starts = starts.select(F.col("__range").alias("__r"), F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(*_BEFORE)), F.lit(0)).alias("__start"))
    return x.join(starts, F.col("__range") == F.col("__r")).withColumn(name, F.col("__start") + F.col("__at")).drop("__r", "__start")


def _same(keys: list[str], suffix: str = "__k") -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{k}{suffix}"))
    return out


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "number") -> DataFrame:
    """df with the place of each row in its group's order, from 1. Null keys are a group."""
    x = placed(laid(df, keys, order))
    if not keys:
        return x.withColumn(name, F.col("__pos") + 1).drop("__range", "__at", "__pos")
    first = x.groupBy(*keys).agg(F.min("__pos").alias("__first")).withColumnsRenamed({k: f"{k}__k" for k in keys})
    out = x.join(first, _same(keys)).withColumn(name, F.col("__pos") - F.col("__first") + 1)
    return out.drop("__range", "__at", "__pos", "__first", *(f"{k}__k" for k in keys))


def prefix(x: DataFrame, keys: list[str], **measures: tuple[str, Column]) -> DataFrame:
    """laid rows x with, for each measure name=(kind, value), the aggregate of value over the
    earlier rows of the group (null: none). kind is sum, min, max, first or last; nulls are
    passed over. x keeps __range and __at, so scans follow each other."""
    inside = Window.partitionBy(*keys, "__range").orderBy("__at").rowsBetween(*_BEFORE)
    made = {"sum": F.sum, "min": F.min, "max": F.max, "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True)}
    whole = {
        "sum": F.sum, "min": F.min, "max": F.max,
        "first": lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("__at"))), "last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("__at"))),
    }
    join = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest, "first": F.coalesce, "last": lambda a, b: F.coalesce(b, a)}
    folds = x.groupBy(*keys, "__range").agg(*(whole[kind](value).alias(f"__f_{n}") for n, (kind, value) in measures.items()))
    over = Window.partitionBy(*keys).orderBy("__range").rowsBetween(*_BEFORE)
    folds = folds.select(*(F.col(k).alias(f"{k}__k") for k in keys), F.col("__range").alias("__r"), *(made[kind](F.col(f"__f_{n}")).over(over).alias(f"__b_{n}") for n, (kind, _) in measures.items()))
    here = x.withColumns({f"__l_{n}": made[kind](value).over(inside) for n, (kind, value) in measures.items()})
    out = here.join(folds, _same(keys) & (F.col("__range") == F.col("__r")))
    out = out.withColumns({n: join[kind](F.col(f"__b_{n}"), F.col(f"__l_{n}")) for n, (kind, _) in measures.items()})
    return out.drop("__r", *(f"{k}__k" for k in keys), *(f"__{p}_{n}" for n in measures for p in "bl"))


def first(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group. Each of SALTS parts of a group is cut to k before they
    meet, so a group of any size reaches its last task as k * SALTS rows at most."""
    part = F.pmod(F.xxhash64(*(c for c in df.columns if c not in keys)), F.lit(SALTS))
    inner, outer = Window.partitionBy(*keys, "__part").orderBy(*order), Window.partitionBy(*keys).orderBy(*order)
    cut = df.withColumn("__part", part).withColumn("__n", F.row_number().over(inner)).filter(F.col("__n") <= k).drop("__n", "__part")
    return cut.withColumn("__n", F.row_number().over(outer)).filter(F.col("__n") <= k).drop("__n")


def median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, median) of the values that aren't null, exact, the mean of the middle two where
    their number is even: values are laid in order and the middle places picked."""
    x = placed(laid(df.select(*keys, value).filter(F.col(value).isNotNull()), keys, [value]))
    groups = x.groupBy(*keys).agg(F.min("__pos").alias("a"), F.count(F.lit(1)).alias("n"))
    middle = F.array_distinct(F.array(F.expr("a + (n - 1) div 2"), F.expr("a + n div 2")))
    wanted = groups.select(F.explode(middle).alias("__want"))
    # places are unique, so this join has no hot key
    return x.join(wanted, F.col("__pos") == F.col("__want")).groupBy(*keys).agg(F.avg(value).alias(name))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, backward: bool = True, strict: bool = False) -> DataFrame:
    """left with `match`, a struct of the right row of the same keys that is nearest in `at`: at
    or before the left row's place, or with backward False at or after it; strict leaves equal
    places out. Of right rows at one place any one matches, the same in each run. Null keys
    and places match nothing; without a match it is null. Both sides meet in one sort."""
    ks = [f"__k{i}" for i in range(len(keys))]

    def side(df: DataFrame, mine: str, other: str, of: DataFrame, first: bool) -> DataFrame:
        whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(mine)
        return df.select(*(F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)), F.col(at).alias("__t"), F.lit(0 if first else 1).alias("__turn"), whole, F.lit(None).cast(of.schema).alias(other))

    known = right.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in [*keys, at]))
    both = side(left, "__left", "__right", right, strict).unionByName(side(known, "__right", "__left", left, not strict))
    t = F.col("__t").asc() if backward else F.col("__t").desc()
    x = laid(both, ks, [t, "__turn", F.xxhash64("__right")])
    out = prefix(x, ks, match=("last", F.col("__right"))).filter("__left is not null")
    return out.select("__left.*", F.when(F.col("__t").isNotNull(), F.col("match")).alias("match"))
