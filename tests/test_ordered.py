"""Order over groups of any size, against plain Python; ranges are small, so groups span many."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from packetloom.operators import ordered, pairing


@pytest.fixture(scope="module")
def rows(spark):
    """One group holds nine tenths of the rows; values repeat and some are null."""
    rnd = random.Random(3)
    data = [("hot" if rnd.random() < 0.9 else rnd.choice(["a", "b", None]), i, rnd.choice([None, *range(-20, 20)]), rnd.choice("qrx")) for i in range(1500)]
    rnd.shuffle(data)
    return data


@pytest.fixture
def table(spark, rows):
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark.createDataFrame(rows, "k string, at long, v int, kind string")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_no_range_holds_a_hot_group(table):
    x = ordered.laid(table, ["k"], ["at"])
    sizes = [r["count"] for r in x.groupBy("__range").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 400


def test_numbers(table, rows):
    got = {(r.k, r.at): r.number for r in ordered.numbered(table, ["k"], ["at"]).collect()}
    assert got == {(k, r[1]): i + 1 for k, g in grouped(rows).items() for i, r in enumerate(g)}
    over_all = {r.at: r.place for r in ordered.numbered(table, [], [F.col("v").desc_nulls_first(), "at"], "place").collect()}
    want = sorted(rows, key=lambda r: (r[2] is not None, -(r[2] or 0), r[1]))
    assert over_all == {r[1]: i + 1 for i, r in enumerate(want)}


def test_prefix_scans(table, rows):
    x = ordered.prefix(ordered.laid(table, ["k"], ["at"]), ["k"], **{k: (k, F.col("v")) for k in ordered.KINDS})
    got = {r.at: r for r in x.collect()}
    for g in grouped(rows).values():
        for i, r in enumerate(g):
            seen = [v for _, _, v, _ in g[:i] if v is not None]
            want = (sum(seen), min(seen), max(seen), seen[0], seen[-1]) if seen else (None,) * 5
            assert tuple(got[r[1]][k] for k in ordered.KINDS) == want


def test_median(table, rows):
    got = {r.k: r["median"] for r in ordered.median(table, ["k"], "v").collect()}
    assert got == {k: statistics.median(r[2] for r in g if r[2] is not None) for k, g in grouped(rows).items()}


@pytest.mark.parametrize("backward", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_nearest(table, rows, backward, strict):
    left, right = table.filter("kind = 'q'").withColumn("t", F.expr("at div 3")), table.filter("kind = 'r'").selectExpr("k", "at div 3 AS t", "at AS other")
    got = {r.at: r.match for r in ordered.nearest(left, right, ["k"], "t", backward, strict).collect()}
    assert len(got) == sum(r[3] == "q" for r in rows)
    for k, at, _, kind in rows:
        if kind != "q":
            continue
        ok = (lambda t: t < at // 3 if strict else t <= at // 3) if backward else (lambda t: t > at // 3 if strict else t >= at // 3)
        fit = [r[1] // 3 for r in rows if k is not None and r[0] == k and r[3] == "r" and ok(r[1] // 3)]
        want = (max if backward else min)(fit) if fit else None
        assert (got[at].t if got[at] else None) == want


def test_fifo_of_a_hot_flow(table, rows):
    got = {(r.request.at, r.response.at if r.response else None) for r in pairing.fifo(table, ["k"], ["at"], "kind = 'q'", "kind = 'r'").collect()}
    want = set()
    for g in grouped(rows).values():
        open_, done = [], []
        for r in g:
            if r[3] == "q":
                open_.append(r[1])
            elif r[3] == "r" and open_:
                done.append((open_.pop(0), r[1]))
        want |= set(done) | {(q, None) for q in open_}
    assert got == want


def test_empty(spark):
    t = spark.createDataFrame([], "k string, at long, v int, kind string")
    assert ordered.numbered(t, ["k"], ["at"]).collect() == ordered.median(t, ["k"], "v").collect() == ordered.nearest(t, t, ["k"], "at").collect() == []
    assert pairing.fifo(t, ["k"], ["at"], "kind = 'q'", "kind = 'r'").collect() == []
