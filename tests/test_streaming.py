"""Streams of frames, driven to their end by files."""

import datetime as dt

import pytest

from packetloom.streaming import windows

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def drain(spark, tmp_path, batches, schema, plan, mode="append"):
    """One micro-batch after the other."""
    src, name = tmp_path / "in", f"t{abs(hash(str(tmp_path)))}"
    empty = spark.createDataFrame([], schema)
    empty.write.parquet(str(src))
    frames = spark.readStream.schema(empty.schema).parquet(str(src))
    q = plan(frames).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
            q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


FRAME = "ts timestamp, capture_id string, transport string, stream_id long, len long, forward boolean"


def frame(s, size, forward=True, stream=0):
    return (at(s), "cap", "tcp", stream, size, forward)


def test_tumbling_drops_what_is_too_late(spark, tmp_path):
    batches = [[frame(0.1, 10), frame(0.9, 20, False), frame(1.5, 5)], [frame(60, 1)], [frame(0.2, 1000), frame(120, 1)], [frame(200, 1)]]
    rows = {(r.bin_start, r.bytes_forward, r.bytes_reverse) for r in drain(spark, tmp_path, batches, FRAME, windows.tumbling)}
    assert {(a, b) for _, a, b in rows} >= {(10, 20), (5, 0)} and not any(a >= 1000 for _, a, _ in rows)


def test_sessions_split_at_pauses(spark, tmp_path):
    batches = [[frame(0, 1), frame(30, 2), frame(200, 4)], [frame(1000, 8)], [frame(2000, 16)]]
    rows = drain(spark, tmp_path, batches, FRAME, windows.sessions)
    assert sorted(r.bytes_forward for r in rows) == [3, 4, 8]


@pytest.mark.parametrize("plan", [windows.sliding])
def test_sliding_overlaps(spark, tmp_path, plan):
    rows = drain(spark, tmp_path, [[frame(0, 1)], [frame(100, 1)], [frame(200, 1)]], FRAME, plan)
    assert len(rows) == 20


def test_pairs_across_batches(spark, tmp_path):
    schema = "ts timestamp, conversation_id string, type string, frame_number long, time_ms double"
    e = lambda s, kind, n: (at(s), "c", f"http_{kind}", n, s * 1000.0)
    batches = [[e(0, "response", 1), e(1, "request", 2), e(2, "request", 3)], [e(3, "response", 4)], [e(4, "response", 5), e(5, "response", 6), e(6, "request", 7)]]
    rows = drain(spark, tmp_path, batches, schema, windows.pairs)
    assert sorted((r.request_frame, r.response_frame, r.resp_time_ms) for r in rows) == [(2, 4, 2000.0), (3, 5, 2000.0)]
