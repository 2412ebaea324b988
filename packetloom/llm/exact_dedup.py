"""Exact deduplication: a two-pass Bloom filter finds the hashes that may repeat; only their
rows are shuffled, the others pass straight through.

One filter holds some 16 million hashes; more are dealt to ranges with a filter each, one after
the other, so its bits grow with the rows. What passes a filter is counted, and the rows
themselves are marked by a second, small filter of the hashes that do repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import PIECE, bitmap, capped_bits, discard, has_bit, materialize, materialize_few

#: A group with at least this share of all candidate rows is joined by broadcast: there
#: can't be more of them than its inverse.
HOT_SHARE = 1 / 256


#: Bits of one filter at most (32 MiB), and bits for each hash in it.
MOST, A_HASH = 1 << 28, 16


def _filter(hashes: DataFrame, half: int) -> DataFrame:
    """Pass 1: the Bloom filter (two positions a hash) of the positions that were set twice."""
    spots = hashes.select(F.explode(F.array(F.col("__h").bitwiseAND(F.lit(half - 1)), F.shiftrightunsigned("__h", 32).bitwiseAND(F.lit(half - 1)) + F.lit(half))).alias("pos"))
    return bitmap(spots.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "pos")


def _maybe(hashes: DataFrame, seen: DataFrame, half: int) -> DataFrame:
    """Pass 2: the hashes both of whose positions were set twice."""
    p1 = F.col("__h").bitwiseAND(F.lit(half - 1))
    p2 = F.shiftrightunsigned("__h", 32).bitwiseAND(F.lit(half - 1)) + F.lit(half)
    a = F.broadcast(seen.select(F.col("piece").alias("__k1"), F.col("bits").alias("__b1")))
    b = F.broadcast(seen.select(F.col("piece").alias("__k2"), F.col("bits").alias("__b2")))
    df = hashes.withColumns({"__p1": p1, "__p2": p2})
    df = df.join(a, F.expr(f"__p1 div {PIECE}") == F.col("__k1")).join(b, F.expr(f"__p2 div {PIECE}") == F.col("__k2"))
    return df.filter(has_bit(F.col("__b1"), F.col("__p1")) & has_bit(F.col("__b2"), F.col("__p2"))).select("__h")


def repeated(hashes: DataFrame, n: int) -> DataFrame:
    """The hashes (__h, n rows in all) that occur more than once, each once."""
    ranges = max(1, -(-n * A_HASH // MOST))
    out = None
    for k in range(ranges):
        part = hashes if ranges == 1 else hashes.filter(F.pmod(F.xxhash64("__h"), F.lit(ranges)) == k)
        half = capped_bits(-(-n // ranges), A_HASH, MOST) // 2
        seen = materialize_few(_filter(part, half), "bloom")
        some = materialize(_maybe(part, seen, half).groupBy("__h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__h"), "repeated")
        discard(seen)
        out = some if out is None else out.unionByName(some)
    return out


def exact_dedup(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the carried columns (default: all), keep_id (the id of
    the row that stays), group_size, kept and text_sha256.

    Texts are equal if they are identical; null counts as empty. Of equal texts the row with
    the largest id stays (null ids are smallest); of rows equal in id and text, exactly one
    stays. Input columns named like result columns are replaced. An empty table gives an
    empty result. A hot group is counted by partial aggregation and joined by broadcast. Texts are
    hashed by Spark, whatever their length, and carried only if asked for. Names that begin
    with two underscores are kept for the operator.

    Pass one shuffles two bit positions a row (summed in each task first), which is as much as
    the hashes would be; what the filter spares is the shuffle of rows and texts."""
    made = ("keep_id", "group_size", "kept", "text_sha256")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*carry, *([] if id_col in carry else [id_col]), F.sha2(text, 256).alias("text_sha256"), F.xxhash64(text).alias("__h"))
    if text_col not in carry:
        rows = materialize(rows, "hashes")  # the texts are read once
    hashes = rows.select("__h") if text_col not in carry else materialize(rows.select("__h"), "hashes")
    again = repeated(hashes, hashes.count())
    bits = capped_bits(again.count(), 32)
    spot = F.col("__h").bitwiseAND(F.lit(bits - 1))
    pieces = F.broadcast(materialize_few(bitmap(again.select(spot.alias("pos")).distinct(), "pos").toDF("__piece", "__bits"), "again"))
    marked = rows.withColumn("__p", spot).join(pieces, F.expr(f"__p div {PIECE}") == F.col("__piece"), "left").withColumn("__maybe", has_bit(F.col("__bits"), F.col("__p"))).drop("__p", "__piece", "__bits")
    single = marked.filter(~F.col("__maybe")).select(*carry, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = materialize(marked.filter("__maybe").drop("__maybe", "__h").withColumn("__row", F.monotonically_increasing_id()), "maybe")
    groups = materialize(maybe.groupBy("text_sha256").agg(F.max(F.struct(F.col(id_col).alias("id"), F.col("__row").alias("row"))).alias("__best"), F.count(F.lit(1)).alias("group_size")), "groups")
    least = max(1000, int(maybe.count() * HOT_SHARE))
    hot = F.broadcast(groups.filter(F.col("group_size") > least))
    cold = groups.filter(F.col("group_size") <= least)
    held = [maybe.join(hot, "text_sha256"), maybe.join(hot, "text_sha256", "left_anti").join(cold, "text_sha256")]
    out = single
    for part in held:
        out = out.unionByName(part.select(*carry, F.col("__best.id").alias("keep_id"), "group_size", (F.col("__row") == F.col("__best.row")).alias("kept"), "text_sha256"))
    return out


def op4(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_dedup(docs, carry=["doc_id"])


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
