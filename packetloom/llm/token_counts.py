"""Token counts: an exact histogram of encoded lengths; suffix sums over it answer totals,
quantiles and truncated totals for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.bpe import encode, vocabulary
from packetloom.llm.common import materialize

#: Lengths a block; sums run inside blocks side by side, and over one row for each block.
BLOCK = 256


def length_histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """One row for each length that occurs: n_tokens, n_docs; docs_upto, docs_over and
    tokens_upto (documents not longer, longer, and the tokens of those not longer);
    n_total, tokens_total; truncated_total (tokens left when every document is cut to
    n_tokens).

    For a limit between two lengths, take the row of the next smaller one and add
    docs_over for each token more. A quantile q is the first row with docs_upto >=
    q * n_total. Null lengths are left out; an empty table gives an empty result."""
    hist = lengths.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    hist = materialize(hist, "lengths")  # both branches below read it; texts are encoded once
    hist = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    rising = Window.orderBy("block")  # one row for each BLOCK lengths
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(F.col("block").alias("b"), F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.sum("d").over(whole).alias("n_total"), F.sum("t").over(whole).alias("tokens_total"))
    inside = Window.partitionBy("block").orderBy("n_tokens")
    out = hist.withColumns({"d": F.sum("n_docs").over(inside), "t": F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside)}).join(blocks, F.col("block") == F.col("b"))
    over = F.col("n_total") - F.col("d0") - F.col("d")
    upto = F.col("t0") + F.col("t")
    return out.select("n_tokens", "n_docs", (F.col("d0") + F.col("d")).alias("docs_upto"), over.alias("docs_over"), upto.alias("tokens_upto"), "n_total", "tokens_total", (upto + over * F.col("n_tokens")).alias("truncated_total"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(n_limit, docs_over, truncated_total) for any context limits, also below the shortest and
    beyond the longest length: documents longer than the limit, and the tokens left when every
    document is cut to it. From length_histogram() alone; an empty one gives zeros."""
    asked = hist.sparkSession.createDataFrame([(int(x),) for x in sorted(set(limits))], "n_limit long")
    below = hist.join(F.broadcast(asked), F.col("n_tokens") <= F.col("n_limit")).groupBy("n_limit").agg(F.max("docs_upto").alias("d"), F.max("tokens_upto").alias("t"))
    rows = asked.join(below, "n_limit", "left").withColumn("n", hist.select(F.coalesce(F.max("n_total"), F.lit(0))).scalar())
    over = F.col("n") - F.coalesce("d", F.lit(0))
    return rows.select("n_limit", over.alias("docs_over"), (F.coalesce("t", F.lit(0)) + over * F.greatest("n_limit", F.lit(0))).alias("truncated_total"))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least that share of documents doesn't
    exceed (share 0: the shortest); no rows for an empty histogram."""
    asked = hist.sparkSession.createDataFrame([(float(x),) for x in sorted(set(shares))], "share double")
    hit = hist.join(F.broadcast(asked), F.col("docs_upto") >= F.col("share") * F.col("n_total"))
    return hit.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op6(spark, sf_dir):
    path, pattern = vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    return length_histogram(encode(docs, path, pattern, ids=False, drop=("text",)))
