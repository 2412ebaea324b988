"""The corpus pipeline: five stages, each over all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again before the next. All but the last return the columns of documents.

Null texts count as empty everywhere. A null doc_id is never an example and never held out; in
exact dedup it is the smallest id, in near dedup the last; its rows are mixed together. Extra
columns are carried on; names that begin with two underscores are kept for the stages. Empty
tables give empty results; without labels no document is toxic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import bpe, exact_dedup, mixing, simhash, toxicity
from packetloom.llm.common import discard, materialize, without


def toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter("predicted = 0").select(*docs.columns)


def exact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs).filter("kept").select(*docs.columns)


def near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked texts one row stays, that with the smallest doc_id (nulls last); of rows that
    share it the one with the smallest hash of the text, then the first."""
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = simhash.near_components(rows.withColumn("__hash", F.xxhash64("text")), carry=["doc_id", "__hash", "__row"])
    found = materialize(found.select("component", "doc_id", "__hash", "__row"), "found")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__hash", "__row"))["__row"].alias("__first"))
    gone = found.join(first, "component").filter("__row <> __first").select(F.col("__row").alias("k"))
    return without(rows, F.col("__row"), gone).select(*docs.columns)


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of documents that the mix leaves out go, those it takes twice come twice."""
    return mixing.mixed(docs)


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and whether the ids decode to the text again."""
    path, pattern = bpe.vocabulary()
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern, decoded="decoded")
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing sources", mix), ("byte-level BPE", tokens)]

#: SQL can't express the stages (a trained classifier, XXH64 fingerprints, BPE): tests hold
#: them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote goes once the next one has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage{k}")
        discard(before)
    return docs
