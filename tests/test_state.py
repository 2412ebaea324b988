"""Stateful streams: late rows, restarts from the checkpoint, state that shrinks."""

import pytest

from packetloom.streaming import state
from tests.test_streaming import at

EVENT = "ts timestamp, conversation_id string, type string, frame_number long, time_ms double, attr_qname string, attr_dns_id long"


class Run:
    """A query fed batch by batch; each batch is a start of its own that goes on from the
    checkpoint."""

    def __init__(self, spark, tmp_path, schema, plan):
        self.spark, self.dir, self.schema, self.plan, self.held = spark, tmp_path, schema, plan, []
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")

    def feed(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(f"{self.dir}/in")
        source = self.spark.readStream.schema(self.spark.createDataFrame([], self.schema).schema).parquet(f"{self.dir}/in")
        take = lambda df, _: self.held.extend(df.collect())
        q = self.plan(source).writeStream.foreachBatch(take).option("checkpointLocation", f"{self.dir}/cp").trigger(once=True).start()
        try:
            assert q.awaitTermination(60), "it doesn't end"
            self.state = sum(x["numRowsTotal"] for x in q.recentProgress[-1]["stateOperators"])
        finally:
            q.stop()
        return self


@pytest.fixture
def run(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield lambda schema, plan: Run(spark, tmp_path, schema, plan)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def http(s, kind, n, conv="c"):
    return (at(s), conv, f"http_{kind}", n, s * 1000.0, None, None)


def test_pairs_go_on_from_the_checkpoint_and_give_up(run):
    r = run(EVENT, lambda e: state.pairs(e, "10 seconds", 60_000))
    r.feed(http(0, "response", 1), http(1, "request", 2), http(2, "request", 3), http(2, "request", 30, "d"))
    r.feed(http(3, "response", 4))
    held = r.state
    r.feed(http(300, "request", 9, "e"))  # the watermark passes c and d by
    r.feed(http(301, "response", 10, "e"))
    r.feed(http(5, "response", 11))  # too late: dropped
    r.feed(http(302, "response", 12, "e"))
    got = {(x.conversation_id, x.request_frame, x.response_frame) for x in r.held}
    assert got == {("c", 2, 4), ("c", 3, None), ("d", 30, None), ("e", 9, 10)}
    assert r.state < held


FRAME = "capture_id string, transport string, stream_id long, ahead boolean, frame_number long, syn boolean, tcp_seq_raw long, tcp_len long, lost_segment boolean"


def test_gaps_across_batches(run):
    f = lambda n, seq, size, syn=False, lost=False, stream=0: ("cap", "tcp", stream, True, n, syn, seq, size, lost)
    r = run(FRAME, state.gaps)
    r.feed(f(1, 2000, 0, syn=True), f(3, 9000, 100, lost=True, stream=1))
    r.feed(f(4, 2001, 100))
    r.feed(f(6, 2200, 100, lost=True), f(5, 2050, 20))
    r.feed(f(7, 2400, 10, lost=True), f(8, None, None, lost=True))
    assert sorted((x.frame_number, x.origin, x.gap_bytes) for x in r.held) == [(3, "capture_start", None), (6, "mid_stream", 99), (7, "mid_stream", 100), (8, "mid_stream", None)]


def dns(s, kind, n, name, number=1):
    return (at(s), "c", f"dns_{kind}", n, s * 1000.0, name, number)


def test_latest_query_of_a_name(run):
    r = run(EVENT, state.answers)
    r.feed(dns(0, "query", 1, "a"), dns(0, "query", 2, "b"), dns(1, "response", 3, "z"))
    r.feed(dns(2, "query", 4, "a"), dns(3, "response", 5, "a"))
    r.feed(dns(4, "response", 6, "b"))
    assert sorted((x.query_frame, x.response_frame) for x in r.held) == [(2, 6), (4, 5)]


def test_dns_join_of_two_streams(run):
    r = run(EVENT, state.dns_pairs)
    r.feed(dns(0, "query", 1, "a", 1), dns(1, "query", 2, "b", 2))
    r.feed(dns(5, "response", 3, "a", 1))
    r.feed(dns(200, "query", 4, "c", 3))
    r.feed(dns(400, "query", 5, "d", 4))
    r.feed(dns(401, "query", 6, "e", 5))
    got = {(x.query_frame, x.response_frame) for x in r.held}
    assert {(1, 3), (2, None)} <= got and (5, None) not in got
    assert r.state < 8
