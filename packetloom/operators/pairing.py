"""Requests and the responses that answer them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.ordered import laid, numbered, prefix


def by_ordinal(requests: DataFrame, responses: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The k-th request of a key with its k-th response, or null: columns request and
    response are structs of the whole rows. A key's rows are numbered in ranges."""
    a = numbered(requests, keys, order, "rn").select(*keys, F.struct(*requests.columns).alias("request"), "rn")
    b = numbered(responses, keys, order, "rn").select(*keys, F.struct(*responses.columns).alias("response"), "rn")
    return a.join(b, [*keys, "rn"], "left")


def fifo(rows: DataFrame, keys: list[str], order: list[str], is_request: str, is_response: str) -> DataFrame:
    """First-in-first-out pairing in which a response with no open request is skipped.

    With b the balance and low its lowest value so far (0 at the start), a response is an
    orphan if and only if it makes a new low; without the orphans, the k-th response answers
    the k-th request. All three are prefix scans, so a flow of any length is paired in ranges.
    Columns request and response (null: unanswered) are structs. A null key is a flow."""
    d = rows.select(*keys, *(c for c in order if c not in keys), F.struct(*rows.columns).alias("__row"), F.when(F.expr(is_request), 1).when(F.expr(is_response), -1).alias("__step")).filter("__step is not null")
    d = prefix(laid(d, keys, order), keys, __b=("sum", F.col("__step")))
    d = d.withColumn("__b", F.coalesce("__b", F.lit(0)) + F.col("__step"))
    d = prefix(d, keys, __low=("min", F.col("__b")))
    d = d.withColumn("__kept", (F.col("__step") == 1) | (F.col("__b") >= F.least(F.lit(0), F.col("__low"))))
    d = prefix(d, keys, __q=("sum", (F.col("__step") == 1).cast("long")), __a=("sum", (F.col("__kept") & (F.col("__step") == -1)).cast("long"))).filter("__kept")
    d = d.withColumn("__k", F.coalesce(F.when(F.col("__step") == 1, F.col("__q")).otherwise(F.col("__a")), F.lit(0)))
    # both kinds meet by aggregation: one shuffle, no self-join
    pair = d.groupBy(*keys, "__k").agg(F.first(F.when(F.col("__step") == 1, F.col("__row")), ignorenulls=True).alias("request"), F.first(F.when(F.col("__step") == -1, F.col("__row")), ignorenulls=True).alias("response"))
    return pair.filter("request is not null").drop("__k")


HTTP = ("http_request", "http_response")


def transactions(ev: DataFrame) -> DataFrame:
    """HTTP transactions of each conversation; orphan responses are skipped. resp_time_ms is the
    measured time where there is one, else the difference. Order is that of emission."""
    # in one frame the request is emitted before the response
    http = ev.filter(F.col("type").isin(*HTTP)).withColumn("__emitted", F.col("type") == "http_response")
    p = fifo(http, ["capture_id", "conversation_id"], ["time_ms", "frame_number", "__emitted"], "type = 'http_request'", "type = 'http_response'")
    q, r = F.col("request"), F.col("response")
    return p.select(
        "capture_id", "conversation_id", q["attr_method"].alias("method"), q["attr_host"].alias("host"), q["attr_uri"].alias("uri"), r["attr_status_code"].alias("status_code"),
        q["time_ms"].alias("request_time_ms"), r["time_ms"].alias("response_time_ms"), F.coalesce(r["attr_resp_time_ms"], F.round(r["time_ms"] - q["time_ms"], 3)).alias("resp_time_ms"),
        q["frame_number"].alias("request_frame"), r["frame_number"].alias("response_frame"), r["attr_resp_time_ms"].alias("measured_resp_time_ms"),
    )
