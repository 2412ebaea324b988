"""JSON tables, settings, logs."""

import json
import zipfile

from pyspark.sql import types as T

import pytest

from packetloom.config import Config, cache_root, configure
from packetloom.schema import EVENTS
from packetloom.scoring import report
from packetloom.sources.fingerprints import fingerprint, fingerprints, ranges
from packetloom.sources import json_tables


def test_nested_events(spark, tmp_path):
    doc = {"version": 1, "events": [{"event_id": "evt:000001", "type": "dns_response", "time_ms": 1.5, "frame_number": 8, "attributes": {"qname": "a", "rcode_num": "3", "odd": "x"}}, {"event_id": "evt:000002", "type": "http_response", "attributes": {"status_code": "none"}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text("{}")
    df = json_tables.read_events(spark, str(tmp_path / "*.json"))
    assert df.columns == EVENTS.names
    a, b = df.orderBy("event_id").collect()
    assert (a.attr_qname, a.attr_rcode_num, a.attr_status_code) == ("a", 3, None) and b.attr_status_code is None
    rows = spark.createDataFrame([(1, '[{"n": 1}, {"n": 2}]'), (2, None), (3, "broken")], "id long, j string")
    assert [(r.id, r.element.n) for r in json_tables.explode_json(rows, "j", "struct<n bigint>", ["id"]).collect()] == [(1, 1), (1, 2)]


def test_logs(spark, tmp_path):
    lines = '{"tool": "a", "text": "xyz"}\nnot json\n{"tool": "b", "text": "x"}\n'
    (tmp_path / "log.jsonl").write_text(lines)
    logs = report.read_logs(spark, str(tmp_path / "log.jsonl"), "tool string, text string")
    assert {(r.tool, r.chars, r.share) for r in report.context_cost(logs).collect()} == {("a", 3, 0.75), ("b", 1, 0.25)}
    with zipfile.ZipFile(tmp_path / "log.zip", "w") as z:
        z.writestr("log.jsonl", lines)
    schema = T.StructType([T.StructField("tool", T.StringType()), T.StructField("text", T.StringType())])
    assert report.read_zipped_logs(spark, str(tmp_path / "log.zip"), schema).count() == 2
    calls = spark.createDataFrame([(["x", "y"],), (["x"],)], "fields array<string>")
    assert [tuple(r) for r in report.usage(calls, "fields").collect()] == [("x", 2), ("y", 1)]


def test_settings(tmp_path):
    assert cache_root("/a", {}) == "/a" and cache_root(None, {"PACKETLOOM_CACHE": "/b"}) == "/b" and cache_root(None, {"XDG_CACHE_HOME": "/c"}) == "/c/packetloom"
    assert configure({"cache": "/x", "sql_rows": 7}) == Config(tables="/x", sql_rows=7) and configure({}).tables is None and configure({"cache": True}, {"PACKETLOOM_CACHE": "/b"}).tables == "/b"
    for bad in ({"colour": 1}, {"sessions": 0}, {"sql_rows": "9"}, {"render_chars": True}):
        with pytest.raises(ValueError):
            configure(bad)
    big = tmp_path / "big.pcap"
    big.write_bytes(bytes(3 << 20))
    one = fingerprint(str(big))
    with big.open("r+b") as f:
        f.seek(-1, 2)
        f.write(b"x")
    assert one.startswith("cap_") and fingerprint(str(big)) != one


def test_external_dissector(spark, tmp_path):
    import pytest

    from packetloom.operators import extract
    from packetloom.sources import process

    for k in (1, 2):
        (tmp_path / f"c{k}.txt").write_text(f"1\t1700000000.0\t60\n{k}\t170000000{k}.5\t70\nshort\n")
    files = spark.createDataFrame([(str(p),) for p in sorted(tmp_path.glob("*.txt"))], "path string")
    rows = process.dissect(files, ["cat", "{path}"], ["frame.number", "frame.time_epoch", "frame.len"])
    assert {r.capture_id: r.packet_count for r in extract.capture_times(extract.facts(rows)).collect()} == {"c1": 2, "c2": 2}
    assert list(process.lines_of(["printf", "abc\\nabcdef\\n"], max_line=5)) == ["abc"]
    with pytest.raises(RuntimeError):
        list(process.lines_of(["false"]))
    with pytest.raises(TimeoutError):
        list(process.lines_of(["sleep", "30"], timeout_s=0.2))
