"""Checks of one table against another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def end(ip: str, port: str):
    return F.concat_ws(":", F.col(ip), F.col(port).cast("string"))


def flow_audit(left: DataFrame, right: DataFrame, value: str = "bytes") -> DataFrame:
    """Flows of two tables (transport, a, b, value), whichever way round their endpoints are:
    (transport, a, b, left_value, right_value, status), the status being equal, differs,
    missing (only left) or extra (only right). Each side is summed by flow first, so a full
    join meets one row a flow."""

    def summed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("transport", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(value).alias(name))

    both = summed(left, "left_value").join(summed(right, "right_value"), ["transport", "a", "b"], "full_outer")
    status = F.when(F.col("right_value").isNull(), "missing").when(F.col("left_value").isNull(), "extra").when(F.col("left_value") == F.col("right_value"), "equal").otherwise("differs")
    return both.withColumn("status", status)


def name_pivot(answers: DataFrame, conversations: DataFrame) -> DataFrame:
    """Conversations that began after a name was resolved to their responder's address: answers
    (name, address, time_ms) with conversations; the earliest answer of a name and address
    counts, so the theta part (later than) meets one row for each."""
    first = answers.groupBy("name", "address").agg(F.min("time_ms").alias("answered_ms"))
    hit = first.join(conversations, (F.col("address") == F.col("responder_ip")) & (F.col("start_ms") > F.col("answered_ms")))
    return hit.select("name", "address", "conversation_id", F.round(F.col("start_ms") - F.col("answered_ms"), 3).alias("after_ms"))
