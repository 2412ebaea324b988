"""The catalogue against its SQL, on the smallest tables."""

import glob
import json
import os
import tempfile

import pytest

import __spark_entry__ as entry
from packetloom import model_queries, queries
from tests import own_tables

GIVEN = "/root/testdata/sf0.001"
DATA = GIVEN if os.path.isdir(GIVEN) else own_tables.write(tempfile.mkdtemp(prefix="tables-"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module", autouse=True)
def one_model():
    """The written model of a folder serves all queries of this module."""
    real, kept = model_queries._model, {}
    model_queries._model = lambda spark, d: kept[d] if d in kept else kept.setdefault(d, real(spark, d))
    yield
    model_queries._model = real


@pytest.fixture(scope="module")
def duck():
    return connected(DATA)


def connected(folder):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}/*.parquet'" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM '{glob.glob(p)[0]}'")
    return c


#: Queries that read much of the model are held against their SQL on own tables too.
@pytest.mark.parametrize("name", ["extract_events", "extract_transactions", "http_fifo_no_orphans", "reassemble_messages", "run_scores", "gate_union_by_name", "timeseries_rtt"])
def test_query_on_own_tables(spark, tmp_path, name):
    test_query(spark, connected(own_tables.write(str(tmp_path))), name, str(tmp_path))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name, folder=DATA):
    df = queries.QUERIES[name](spark, folder)
    rows = df.collect()
    found = duck.execute(queries.SQL[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(df.columns)
    same = lambda r, get: tuple(plain(get(r, c)) for c in sorted(cols))
    want = sorted((same(r, lambda r, c: r[cols.index(c)]) for r in found.fetchall()), key=repr)
    assert sorted((same(r, lambda r, c: r[c]) for r in rows), key=repr) == want


@pytest.mark.parametrize(("name", "sign", "nulls"), [("sort_nulls_asc_whole", 1, 1), ("sort_nulls_desc_whole", -1, -1)])
def test_sorts_place_every_row(spark, name, sign, nulls):
    d = DATA.replace("sf0.001", "sf0.01")
    rows = sorted(queries.QUERIES[name](spark, d).collect(), key=lambda r: r.place)
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "value").collect()
    held = [(r.event_id, r.value if r.value is not None and r.value >= 1 else None) for r in events]
    want = sorted(held, key=lambda r: (nulls * (r[1] is None), sign * (r[1] or 0), r[0]))
    assert any(v is None for _, v in held) and [(r.event_id, r.nvalue) for r in rows] == want
    assert [r.place for r in rows] == list(range(1, len(events) + 1))


@pytest.mark.parametrize("how", ["inner", "left", "right", "full_outer", "left_semi", "left_anti"])
def test_joins_take_whole_tables(spark, how):
    d = DATA.replace("sf0.001", "sf0.01")
    orders = [r[0] for r in spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey").collect()]
    lines = [r[0] for r in spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey").collect()]
    matched, alone, stray = set(orders) & set(lines), set(orders) - set(lines), set(lines) - set(orders)
    assert alone and len(orders) == len(set(orders))
    pairs = sum(k in matched for k in lines)
    extra = [k in stray for k in lines].count(True)
    want = {"inner": pairs, "left": pairs + len(alone), "right": pairs + extra, "full_outer": pairs + len(alone) + extra, "left_semi": len(matched), "left_anti": len(alone)}
    assert queries.QUERIES[f"join_{how}_whole"](spark, d).count() == want[how]


def test_display_filter_keeps_odd_lengths(spark):
    rows = queries.QUERIES["raw_display_filter_whole"](spark, DATA).collect()
    events = spark.read.parquet(f"{DATA}/events.parquet").collect()
    k = {r.event_id + 1: json.loads(r.props)["k"] for r in events}
    tcp = [r for r in events if r.user_id % 2 == 0 and k[r.event_id + 1] != 50 and not (r.event_type == "error" and k[r.event_id + 1] % 3 == 0)]
    want = {r.event_id + 1 for r in tcp if 60 + k[r.event_id + 1] > 100 or r.event_type == "signup" and r.user_id % 3 != 0}
    assert sorted(r.frame_number for r in rows) == sorted(want)
    assert {k[r.frame_number] % 2 for r in rows} == {0, 1}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
