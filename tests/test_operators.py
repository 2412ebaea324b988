"""Operators against plain simulations on random rows."""

import math
import random
from collections import deque

from pyspark.sql import functions as F

from packetloom.operators import index, pairing, timeseries


def test_fifo_is_a_queue(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for key in range(300):
        queue, n = deque(), 0
        for t in range(rnd.randint(0, 14)):
            kind = rnd.choice(["q", "q", "r", "r", "x"])
            rows.append((key, t, kind, key * 100 + t))
            if kind == "q":
                queue.append(n := key * 100 + t)
                want[n] = None
            elif kind == "r" and queue:
                want[queue.popleft()] = key * 100 + t
    df = spark.createDataFrame(rows, "key long, t long, kind string, frame long")
    p = pairing.fifo(df, ["key"], ["t"], "kind = 'q'", "kind = 'r'")
    assert {r[0]: r[1] for r in p.select("request.frame", "response.frame").toDF("a", "b").collect()} == want
    ordinal = pairing.by_ordinal(df.filter("kind = 'q'"), df.filter("kind = 'r'"), ["key"], ["t"])
    assert ordinal.count() == len(want)


def test_bins(spark):
    rnd = random.Random(5)
    for duration, width in ((0, 100), (49_999, 100), (50_001, 100), (10_000_000, 10), (333.3, 5000)):
        w = width
        while duration / w > 500:
            w *= 2
        assert timeseries.widen(duration, width) == w
        assert spark.range(1).select(timeseries.widened(F.lit(float(duration)), width)).first()[0] == w
    spans = {"a": (0.0, 900.0, 100.0, 10), "b": (100.0, 120_000.0, 400.0, 301), "c": (5.0, None, 100.0, 1)}
    rows = [(rnd.choice("abc"), rnd.uniform(-50, 150_000) if rnd.random() < 0.3 else rnd.uniform(-50, 1050), rnd.random() < 0.5, rnd.choice([None, 1.0, 2.0, 5.0])) for _ in range(900)]
    df = spark.createDataFrame(rows, "key string, time_ms double, forward boolean, v double")
    table = spark.createDataFrame([(k, s, d) for k, (s, d, *_) in spans.items()], "key string, start_ms double, duration_ms double")
    for how in ("sum", "median"):
        out = timeseries.binned(df, table, ["key"], F.col("v"), how, 100.0).collect()
        got = {(r.key, r.t_start_ms): (r.bin_ms, r.forward, r.reverse) for r in out}
        want = {}
        for key, (start, _, width, n) in spans.items():
            for i in range(n):
                both = []
                for fwd in (True, False):
                    held = sorted(v for k, t, f, v in rows if k == key and f is fwd and v is not None and min(max(math.floor((t - start) / width), 0), n - 1) == i)
                    m = len(held)
                    both.append(None if not m else sum(held) if how == "sum" else round((held[(m - 1) // 2] + held[m // 2]) / 2, 3))
                want[key, i * width] = (width, *both)
        assert got == want and len(out) == len(want)


def test_hierarchy(spark):
    df = spark.createDataFrame([("eth:ip:tcp", 10), ("eth:ip:udp:dns", 20), ("eth:ip:tcp", 5), (None, 1)], "protocols string, len long")
    got = {r.path: (r.protocol, r.depth, r.frames, r.bytes) for r in index.hierarchy(df).collect()}
    assert got == {"eth": ("eth", 0, 3, 35), "eth:ip": ("ip", 1, 3, 35), "eth:ip:tcp": ("tcp", 2, 2, 15), "eth:ip:udp": ("udp", 2, 1, 20), "eth:ip:udp:dns": ("dns", 3, 1, 20)}
