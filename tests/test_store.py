"""Tables kept in generations, files' ids, and names like given ones."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.plans import suggest
from packetloom.sources import fingerprints, tsv
from packetloom.store import Store


def table(spark, n):
    return spark.range(n).select("id", (F.col("id") % 2).alias("part"))


def test_a_failed_write_leaves_the_old_generation(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.read() is None and store.current() is None
    store.write("one", {"a": table(spark, 5), "b": table(spark, 3)}, ["part"])
    broken = table(spark, 9).select("id", F.expr("CASE WHEN id = 8 THEN raise_error('no') ELSE part END").alias("part"))
    with pytest.raises(Exception, match="no"):
        store.write("two", {"a": table(spark, 7), "b": broken})
    old = store.read("one")
    assert (old["a"].count(), old["b"].count()) == (5, 3) and store.read("two") is None
    new = store.write("two", {"a": table(spark, 7), "b": table(spark, 9)})
    # who read the old generation can still do so
    assert (new["a"].count(), new["b"].count(), old["a"].count(), old["b"].count()) == (7, 9, 5, 3)
    for k in range(3):
        store.write(f"more{k}", {"a": table(spark, k + 1)})
    assert store.read()["a"].count() == 3 and len([x for x in (tmp_path / "s").iterdir() if x.name.startswith("generation")]) <= 3


def test_schemas_are_checked(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.write("m", {"a": table(spark, 1)})
    want = table(spark, 1).schema
    assert store.read("m", {"a": want}) is not None
    assert store.read("m", {"a": spark.range(1).select("id", F.lit("x").alias("part")).schema}) is None
    assert store.read("m", {"b": want}) is None


def test_files_by_ranges(spark, tmp_path):
    rnd = random.Random(1)
    big = bytearray(rnd.randbytes(3_000_000))
    (tmp_path / "d").mkdir()
    (tmp_path / "big").write_bytes(big)
    (tmp_path / "d" / "same").write_bytes(big)
    (tmp_path / "small").write_bytes(b"abc")
    (tmp_path / "empty").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r for r in fingerprints.fingerprints(spark, f"file://{tmp_path}").collect()}
    assert {k: v.size for k, v in got.items()} == {"big": 3_000_000, "same": 3_000_000, "small": 3}
    assert got["big"].capture_id == got["same"].capture_id == fingerprints.fingerprint(str(tmp_path / "big"))
    assert len({r.capture_id for r in got.values()}) == 2
    assert sum(n for _, n in fingerprints.ranges(10**12)) < 1_100_000 and all(0 <= a and a + n <= 10**12 for a, n in fingerprints.ranges(10**12))


def test_field_list(spark, tmp_path):
    (tmp_path / "fields").write_text("P\tTransmission Control Protocol\tTCP\ttcp\nF\tSource Port\ttcp.srcport\tFT_UINT16\ttcp\tBASE_PT_TCP\t0x0\t\nF\tbroken\n")
    assert [tuple(r) for r in tsv.read_fields(spark, str(tmp_path / "fields")).collect()] == [("tcp.srcport", "Source Port", "FT_UINT16", "tcp")]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(row[-1] + 1, old[j + 1] + 1, old[j] + (x != y)))
    return row[-1]


def test_suggestions(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abé") for _ in range(n))
    names = {word(rnd.randint(0, 14)) for _ in range(150)}
    asked = {word(rnd.randint(0, 14)) for _ in range(40)} | set(list(names)[:10])
    frame = lambda x: spark.createDataFrame([(w,) for w in [*x, None]], "w string")
    known = suggest.index(frame(names), "w")
    got = {}
    for r in sorted(suggest.nearest(frame(asked), "w", known, k=5).collect(), key=lambda r: (r.asked, r["rank"])):
        got.setdefault(r.asked, []).append((r.distance, r.name))
    want = {a: sorted((d, n) for n in names if (d := distance(a, n)) <= 2)[:5] for a in asked}
    assert got == {a: w for a, w in want.items() if w}
    assert {r.asked for r in suggest.misspelt(frame(asked), "w", known).collect()} == asked - names
