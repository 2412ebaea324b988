"""Plans that must hold for any flow and any clock: no task that gets a whole flow or capture, no
product of two tables; with the same rows as ever."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom import model_queries
from packetloom.operators import extract, timeseries
from packetloom.plans import sqlgate
from tests.test_extract import ACK, A, B, T0, row


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def burst(n=400):
    """One flow with nine tenths of all frames, all within a second but for one frame with a
    clock of thirty years before; some frames lost, some with round-trip times."""
    rnd = random.Random(2)
    rows, seq = [], 1000
    for k in range(1, n + 1):
        size = rnd.randint(1, 50)
        lost = k % 40 == 0
        seq += 7 if lost else 0
        more = {"tcp__seq_raw": str(seq), "tcp__len": str(size)} | ({"tcp__analysis__lost_segment": "1"} if lost else {}) | ({"tcp__analysis__ack_rtt": f"{rnd.randint(1, 999) / 1000}"} if k % 3 == 0 else {})
        rows.append(row(k, k / 1000, 60, A, B, 5000, 80, **ACK, **more))
        seq += size
    for k in range(n + 1, n + n // 9):
        rows.append(row(k, k / 1000, 60, A, B, 6000 + k, 80, stream=str(k), **ACK, tcp__analysis__zero_window="1"))
    rows.append(row(n * 2, -946_080_000, 60, A, B, 9, 80, stream="9999", **ACK, tcp__analysis__out_of_order="1"))
    return rows


def test_events_of_a_burst_and_a_false_clock(dissect, many_ranges):
    f = extract.prepared(dissect(burst()))
    got = sorted(extract.events(f).collect(), key=lambda r: r.event_id)
    assert [r.event_id for r in got] == [f"evt:{k + 1:06d}" for k in range(len(got))]
    assert got[0].type == "tcp_out_of_order" and [r.frame_number for r in got[1:]] == sorted(r.frame_number for r in got[1:])
    lost = [r for r in got if r.type == "tcp_missing_segment"]
    assert len(lost) == 10 and all(r.attr_gap_bytes == 7 for r in lost)


def test_medians_of_a_hot_flow(dissect, many_ranges):
    import statistics

    rows = burst()
    f = extract.prepared(dissect(rows))
    want = statistics.median(float(r["tcp.analysis.ack_rtt"]) for r in rows if "tcp.analysis.ack_rtt" in r)
    c = extract.conversations(f)
    assert c.filter("conversation_id = 'conv:tcp:0'").first().rtt_median_ms == pytest.approx(want * 1000, abs=1e-3)
    assert "median(" not in plan_of(c) and "percentile" not in plan_of(c)
    d = extract.directed(f).select(extract.conversation_id().alias("k"), F.round((F.col("epoch") - F.col("t0")) * 1000, 3).alias("time_ms"), "forward", "ack_rtt")
    s = timeseries.series_all(d, extract.spans(f).withColumnRenamed("conversation_id", "k"), ["k"], "rtt", 100)
    assert "median(" not in plan_of(s) and "percentile" not in plan_of(s)
    first = [float(r["tcp.analysis.ack_rtt"]) for r in rows if r.get("tcp.analysis.ack_rtt") and float(r["frame.time_epoch"]) - T0 < 0.1005]
    assert s.filter("k = 'conv:tcp:0' and t_start_ms = 0").first().forward == pytest.approx(statistics.median(first) * 1000, abs=1e-3)


def test_the_source_is_read_once(spark, tmp_path, dissect):
    dissect(burst(40)).write.parquet(f"{tmp_path}/rows")
    f = extract.prepared(spark.read.parquet(f"{tmp_path}/rows"))
    for out in (extract.events(f), extract.conversations(f), extract.streams(f), extract.frames(f)):
        assert plan_of(out).count("packetloom-model") <= 3 and f"{tmp_path}/rows" not in plan_of(out)


@pytest.fixture(scope="module")
def views(spark):
    a = spark.createDataFrame([("x", 1, "a1"), ("x", 5, "a2"), ("y", 3, "a3"), (None, 3, "a4"), ("x", None, "a5"), ("z", 9, "a6")], "k string, t int, name string")
    b = spark.createDataFrame([("x", 1, "b1"), ("x", 4, "b2"), ("x", 6, "b3"), ("y", 4, "b4"), (None, 1, "b5")], "k string, t int, name string")
    return sqlgate.own_session(spark, {"frames": a, "events": b})


ASOF = {
    "ASOF JOIN events r ON l.k = r.k AND l.t >= r.t": {("a1", "b1"), ("a2", "b2")},
    "ASOF LEFT JOIN events r ON l.k = r.k AND l.t >= r.t": {("a1", "b1"), ("a2", "b2"), ("a3", None), ("a4", None), ("a5", None), ("a6", None)},
    "ASOF JOIN events r ON r.t < l.t AND r.k = l.k": {("a2", "b2")},
    "ASOF JOIN events AS r ON l.k = r.k AND l.t <= r.t": {("a1", "b1"), ("a2", "b3"), ("a3", "b4")},
    "ASOF LEFT JOIN (SELECT * FROM events WHERE name <> 'b3') r ON l.k = r.k AND l.t < r.t": {("a1", "b2"), ("a2", None), ("a3", "b4"), ("a4", None), ("a5", None), ("a6", None)},
    "ASOF JOIN events r USING (k, t)": {("a1", "b1"), ("a2", "b2")},
}


@pytest.mark.parametrize("join", ASOF)
def test_asof(views, join):
    out = sqlgate.plan(views, f"SELECT l.name AS a, r.name AS b FROM frames l {join} WHERE l.name <> ''", {"frames", "events"})
    assert {(x.a, x.b) for x in out.collect()} == ASOF[join]
    assert "CartesianProduct" not in plan_of(out) and "NestedLoop" not in plan_of(out)


def test_asof_stars_chains_and_ctes(views):
    tables = {"frames", "events"}
    out = sqlgate.plan(views, "SELECT * FROM frames l ASOF JOIN events r ON l.k = r.k AND l.t >= r.t", tables)
    assert out.columns == ["k", "t", "name", "k", "t", "name"] and out.count() == 2
    sql = "WITH late AS (SELECT * FROM frames WHERE t > 2), m AS (SELECT l.name, r.name AS other FROM late l JOIN events e ON e.k = l.k AND e.t = 4 ASOF JOIN events r ON l.k = r.k AND l.t >= r.t) SELECT * EXCLUDE other FROM m"
    assert [tuple(r) for r in sqlgate.plan(views, sql, tables).collect()] == [("a2",)]
    twice = "SELECT l.name, r.name AS b, s.name AS c FROM frames l ASOF JOIN events r ON l.k = r.k AND l.t >= r.t ASOF JOIN events s ON l.k = s.k AND l.t <= s.t"
    assert {tuple(r) for r in sqlgate.plan(views, twice, tables).collect()} == {("a1", "b1", "b1"), ("a2", "b2", "b3")}
    for bad in ("ON l.k = r.k", "ON l.k = r.k AND l.t >= r.t AND l.t >= r.t", "ON l.k = r.k AND l.t + 1 >= r.t", "ON l.k = l.k AND l.t >= r.t"):
        with pytest.raises(sqlgate.SqlError):
            sqlgate.plan(views, f"SELECT 1 FROM frames l ASOF JOIN events r {bad}", tables)
    with pytest.raises(sqlgate.SqlError, match="hidden"):
        sqlgate.plan(views, "SELECT 1 FROM frames l ASOF JOIN hidden r ON l.k = r.k AND l.t >= r.t", tables)


def test_union_by_name(views):
    run = lambda q: sqlgate.plan(views, q, {"frames", "events"})
    out = run("SELECT name, t FROM frames WHERE t = 9 UNION ALL BY NAME SELECT T, k FROM events WHERE name = 'b4' UNION ALL BY NAME SELECT 1 AS extra ORDER BY t NULLS FIRST LIMIT 5")
    assert out.columns == ["name", "t", "k", "extra"] and [tuple(r) for r in out.collect()] == [(None, None, None, 1), (None, 4, "y", None), ("a6", 9, None, None)]
    assert run("SELECT count(*) AS n FROM (SELECT k FROM frames UNION BY NAME SELECT k FROM events)").first().n == 4
    assert run("WITH u AS (SELECT k, 1 AS a FROM frames UNION ALL BY NAME SELECT 2 AS a, k FROM events) SELECT sum(a) AS s FROM u WHERE k IN (SELECT k FROM u)").first().s == 5 + 8
    for bad in ("SELECT k, k FROM frames UNION BY NAME SELECT k FROM events", "SELECT k FROM frames UNION BY NAME SELECT k FROM hidden"):
        with pytest.raises(sqlgate.SqlError):
            run(bad)


def test_gated_queries_leave_the_callers_views_alone(spark, tmp_path):
    spark.range(1).createOrReplaceTempView("events")
    e = spark.createDataFrame([(0, 1, "view", 1.5, '{"k": 3}')], "event_id long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds(F.lit(10)))
    e.write.parquet(f"{tmp_path}/events.parquet")
    assert model_queries.QUERIES["gate_bucket"](spark, str(tmp_path)).count() == 1
    assert spark.table("events").columns == ["id"]
    spark.catalog.dropTempView("events")
