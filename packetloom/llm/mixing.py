"""Mixing sources to target weights by hash-threshold histograms: words are summed by source
and hash bucket, the bucket where a budget ends is found, only that bucket is refined, and
the documents are then filtered by a threshold; nothing is sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import WORD, materialize

WEIGHTS = (3.0, 1.0, 2.0)
#: A hash has BITS bits; each pass looks at STEP more of them.
BITS, STEP = 60, 12
#: Up to so many sources have their thresholds broadcast; more are joined.
BROADCAST_SOURCES = 20_000


def targets(sources: DataFrame, total_share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sources (source, source_size) with target: total_share of all sizes, shared by weight;
    a target stops at `most` times its size and the excess is shared again by weight. That
    is min(most * size, level * weight) for the one level that spends the whole budget."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    w = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(most))
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("level", (F.lit(total_share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # capping one more source raises the level as long as it belongs among the capped, then lowers it
    w = w.withColumn("level", F.max("level").over(everything))
    return w.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with passes (how often each document is taken whole) and limit: documents with a
    hash up to it are taken once more. The limit brings the source as near its target as
    whole hashes can. A null source is one; without goals there are no limits."""
    goals = goals.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = goals.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    open_, closed = goals.withColumns({"prefix": F.lit(0).cast("long"), "below": F.lit(0).cast("long")}).filter("rest > 0"), [goals.filter("rest <= 0").withColumn("limit", F.lit(-1).cast("long"))]
    for shift in range(BITS - STEP, -1, -STEP):
        open_ = materialize(open_, "open")
        n = open_.count()
        if not n:
            break
        ends = open_.select(F.col("source").alias("s"), "prefix")
        rows = sized.join(F.broadcast(ends) if n <= BROADCAST_SOURCES else ends, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + STEP) == F.col("prefix")))
        bins = rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        held = bins.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        one = held.withColumnRenamed("source", "s").join(open_, F.col("s").eqNullSafe(F.col("source"))).filter((F.col("below") + F.col("upto") >= F.col("rest")) & (F.col("below") + F.col("upto") - F.col("words") < F.col("rest")))
        one = materialize(one.withColumn("start", F.col("below") + F.col("upto") - F.col("words")), "boundary")
        nearer = F.col("start") + F.col("words") - F.col("rest") < F.col("rest") - F.col("start")
        names = goals.columns
        closed.append(one.filter("h0 = h1").select(*names, F.when(nearer, F.col("h0")).otherwise(F.col("h0") - 1).alias("limit")))
        open_ = one.filter("h0 < h1").select(*names, F.col("bucket").alias("prefix"), F.col("start").cast("long").alias("below"))
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    return materialize(out.select("source", "source_size", "target", "passes", "limit"), "thresholds")


def hash_of(doc_id):
    """A BITS-bit hash of doc_id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and h, the hash of doc_id."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hash_of(F.col("doc_id")).alias("h"))


def plan(sized: DataFrame, total_share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, passes, limit) for sizes(): what the mix does with each
    source, from histograms alone. Without rows there are none; a source without words has
    target 0 and gives nothing."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return thresholds(sized, materialize(targets(per, total_share, most, weights), "targets"))


def times(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows (with source and __h, null source included) with __times, how often the mix takes
    each, and the columns of its source's plan. Rows of a source without a plan are left out."""
    few = limits.count() <= BROADCAST_SOURCES
    named = limits.withColumnRenamed("source", "__s")
    out = rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("__s")))
    return out.withColumn("__times", F.col("passes") + (F.col("__h") <= F.col("limit")).cast("long")).drop("__s")


def mix(docs: DataFrame, total_share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken; one row for each row of docs.

    taken is a multiple of size: a document is taken whole, up to `most` times. Which ones
    depends on their doc_id only, so reruns agree; rows that repeat a doc_id in a source go
    together. Null and empty texts have size 0, a text of any length is counted by Spark; the null
    source is a source like others, last in order. Other columns are not read. An empty table
    gives an empty result. The sources themselves (a row each) are ordered in one task: some
    ten million of them are its bound."""
    sized = materialize(sizes(docs), "sizes")  # the texts are read once
    out = times(sized.withColumnRenamed("h", "__h"), plan(sized, total_share, most, weights))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("__times")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as the mix takes them: some not at all, some twice; no shuffle of
    texts. Sources without a word are kept as they are."""
    limits = plan(materialize(sizes(docs), "sizes"), **how).select("source", F.when(F.col("source_size") > 0, F.col("passes")).otherwise(1).alias("passes"), "limit")
    rows = times(docs.withColumn("__h", hash_of(F.col("doc_id"))), limits)
    return rows.filter("__times > 0").withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*[F.col(c) for c in docs.columns])


def op7(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, least(cap, max(lev) OVER () * w) AS target FROM l),
g AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS passes FROM t),
c AS (SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
b AS (SELECT c.source, max(h) AS top FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source
      WHERE target - passes * source_size > 0
        AND (upto <= target - passes * source_size
             OR (upto - words < target - passes * source_size AND upto - (target - passes * source_size) < (target - passes * source_size) - (upto - words)))
      GROUP BY c.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, g.source_size, g.target,
       CAST(size * (g.passes + CASE WHEN h <= coalesce(top, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
