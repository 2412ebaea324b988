"""The query language, macros, SQL and raw queries over one small capture."""

import pytest

from packetloom.functions import render
from packetloom.plans import dsl, rawfilter, sqlgate
from packetloom.session import Session, Sessions, Tools, query_hash
from tests.test_extract import ACK, A, B, row, session


@pytest.fixture(scope="module")
def capture(dissect):
    rows = session() + [
        row(9, 0.4, 300, A, B, 1001, 80, stream="1", **ACK, http__request__method="GET", http__host="h.test", http__request__uri="/a"),
        row(10, 0.43, 900, B, A, 80, 1001, stream="1", **ACK, http__response__code="200", http__time="0.03"),
        row(11, 0.5, 60, A, B, 1000, 443, **ACK, tcp__analysis__retransmission="1", tcp__window_size="0"),
    ]
    s = Session(dissect(rows))
    for name in ("facts", "events", "conversations"):
        getattr(s, name).count()
    yield s
    s.close()


def conversations(*where, **more):
    return {"scope": "conversation", "where": [dict(zip(("field", "op", "value"), w, strict=True)) for w in where], **more}


def events_of(*where, **more):
    return conversations(*where, **more) | {"scope": "event"}


@pytest.mark.parametrize(
    ("query", "rules"),
    [
        ({"scope": "flow"}, ["scope"]), ({}, ["scope"]),
        (conversations(("transport", "like", "x")), ["operator"]),
        (conversations(("nope", "eq", 1)), ["field"]),
        (conversations(("start_ms", "gt", 1), ("start_ms", "gt", 2)), ["repeat", "repeat"]),
        (conversations(("transport", "gt", 1)), ["range"]), (conversations(("protocol_tags", "lt", 1)), ["range"]),
        (conversations(("start_ms", "in", 1)), ["list value"]), (conversations(("start_ms", "eq", [1])), ["list value"]),
        (conversations(("start_ms", "contains", "1")), ["text", "number value"]),
        (conversations(("protocol_tags", "eq", "tls")), ["list field"]),
        (conversations(("start_ms", "eq", "1")), ["number value"]), (conversations(("start_ms", "in", [1, "2"])), ["number value"]),
        (conversations(("transport", "eq", "sctp")), ["transport"]),
        (events_of(("type", "eq", "dns")), ["event type"]), (events_of(("type", "in", ["dns_query", "x"])), ["event type"]),
        (events_of(select=["attr.qname"]), ["attribute"]),
        (events_of(("type", "eq", "dns_query"), select=["attr.rcode_num"]), ["attribute"]),
        (events_of(("attr.nothing", "eq", 1)), ["field"]),
        (events_of(select=["x"]), ["field"]), (events_of(order_by=[{"field": "x", "direction": "asc"}]), ["field"]),
        (events_of(order_by=[{"field": "type", "direction": "up"}]), ["direction"]),
        (events_of(limit=201), ["limit"]), (events_of(limit=0), ["limit"]), (events_of(limit=True), ["limit"]), (events_of(offset=-1), ["offset"]), (events_of(offset=1.5), ["offset"]),
        (events_of(("nope", "like", 1), limit=0, offset=-1), ["field", "operator", "limit", "offset"]),
        (events_of(("type", "eq", "dns_response"), ("attr.rcode_num", "gte", 2), select=["attr.qname"], limit=200, offset=0), []),
        (conversations(("protocol_tags", "contains", "tls"), ("start_ms", "in", [1, None]), ("transport", "ne", "sctp"), limit=1), []),
    ],
)
def test_rules(query, rules):
    found = dsl.faults(query)
    assert sorted(f.rule for f in found) == sorted(rules)
    if rules:
        with pytest.raises(dsl.QueryError) as e:
            dsl.validate(query)
        assert e.value.faults == found and all(f.why in str(e.value) for f in found)
    else:
        dsl.validate(query)


def test_faults_name_what_is_allowed():
    (f,) = dsl.faults(conversations(("nope", "eq", 1)))
    assert f.part == "condition 1" and "'nope'" in f.why and all(n in f.why for n in dsl.fields("conversation"))
    assert "dns_response" in dsl.faults(events_of(select=["attr.rcode_num"]))[0].why


def test_most_retransmissions_first(capture):
    out = capture.query({"scope": "conversation", "where": [{"field": "retransmission_count", "op": "gt", "value": 0}], "order_by": [{"field": "retransmission_count", "direction": "desc"}]})["result"]
    assert out["total"] == out["returned"] == 1 and not out["truncated"]
    assert list(out["items"][0]) == dsl.DEFAULT_SELECT["conversation"] and out["items"][0]["retransmission_count"] == 2


def ids(capture, *where, **more):
    out = capture.query({"scope": "conversation", "where": list(where), "select": ["conversation_id"], **more})["result"]
    return [r["conversation_id"] for r in out["items"]]


def test_null_rules(capture):
    w = lambda op, v: {"field": "tcp_handshake_ms", "op": op, "value": v}
    everything = ["conv:tcp:0", "conv:tcp:1", "conv:udp:0"]
    assert ids(capture, w("gte", 0)) == ["conv:tcp:0"] and ids(capture, w("eq", 70)) == ["conv:tcp:0"]
    assert ids(capture, w("ne", 70)) == everything[1:] and ids(capture, w("in", [70])) == everything
    assert ids(capture, w("in", [1])) == everything[1:] and ids(capture, w("in", [70, None])) == ["conv:tcp:0"]
    asc = ids(capture, order_by=[{"field": "tcp_handshake_ms", "direction": "asc"}])
    desc = ids(capture, order_by=[{"field": "tcp_handshake_ms", "direction": "desc"}])
    assert asc[0] == "conv:tcp:0" and desc[-1] == "conv:tcp:0"


def test_contains_paging_and_scopes(capture):
    assert ids(capture, {"field": "protocol_tags", "op": "contains", "value": "dns"}) == ["conv:udp:0"]
    assert ids(capture, {"field": "responder_ip", "op": "contains", "value": "8.8"}) == ["conv:udp:0"]
    page = capture.query({"scope": "conversation", "limit": 1, "offset": 1})["result"]
    assert (page["returned"], page["total"], page["truncated"]) == (1, 3, True)
    e = capture.query({"scope": "event", "where": [{"field": "type", "op": "eq", "value": "dns_response"}, {"field": "attr.rcode_num", "op": "eq", "value": 3}], "select": ["attr.qname"]})["result"]
    assert e["items"] == [{"attr.qname": "youtube.com"}]
    f = capture.query({"scope": "frame", "where": [{"field": "analysis", "op": "contains", "value": "retransmission"}], "select": ["frame_number", "conversation_id"]})["result"]
    assert [tuple(r.values()) for r in f["items"]] == [(6, "conv:tcp:0"), (11, "conv:tcp:0")]
    assert capture.query({"scope": "stream"})["result"]["total"] == 0


def test_macros(capture):
    o = capture.overview()
    assert o["conversation_counts"] == {"tcp": 2, "udp": 1} and o["capture"]["packet_count"] == 11
    assert o["top_conversations_by_bytes"][0]["bytes_a_to_b"] + o["top_conversations_by_bytes"][0]["bytes_b_to_a"] == 1200
    i = capture.inspect("conv:tcp:0", 2)
    assert i["timeline"]["returned"] == 2 and i["timeline"]["truncated"] and i["aggregates"]["retransmissions"]["evidence"]["frames"] == [6, 11]
    with pytest.raises(ValueError, match="conv:tcp:0, conv:tcp:1, conv:udp:0"):
        capture.inspect("conv:tcp:9")
    ev = capture.evidence(frames=[6, 2, 2, 99])
    assert (ev["requested"], ev["returned"], ev["missing_frames"]) == (3, 2, [99]) and [f["frame_number"] for f in ev["frames"]] == [2, 6]
    first = capture.query({"scope": "event", "limit": 1})["result"]["items"][0]
    assert capture.evidence(event_ids=[first["event_id"], "evt:999999"])["frames"][0]["frame_number"] == first["frame_number"]
    t = capture.http_timeline()["transactions"]
    assert [(x["method"], x["status_code"], x["resp_time_ms"]) for x in t] == [("GET", 200, 30.0)]
    t = capture.http_timeline(limit=1, offset=1)
    assert (t["returned"], t["total"], t["truncated"], t["unmatched_requests"]) == (0, 1, False, 0)
    o = capture.open()["capture"]
    assert o["format"] is None and o["size_bytes"] is None and o["backend"]["name"] == "native"


def test_timeseries(capture):
    out = capture.timeseries("conv:tcp:0", "bytes", 100)
    assert sum(b["forward"] or 0 for b in out["bins"]) == 332 and sum(b["reverse"] or 0 for b in out["bins"]) == 150 and len(out["bins"]) == 6
    assert (out["requested_bin_ms"], out["bin_ms"], out["bins_count"], out["sampled"]) == (100, 100, 6, False)
    w = capture.timeseries("conv:tcp:0", "window", 100)["bins"]
    assert w[-1]["forward"] == 0 and w[0]["forward"] is None
    with pytest.raises(ValueError):
        capture.timeseries("conv:tcp:0", "colour")
    with pytest.raises(ValueError):
        capture.timeseries("conv:tcp:0", "bytes", 5)


def test_sql(capture):
    out = capture.sql("SELECT conversation_id, list_contains(protocol_tags, 'tls') AS tls FROM conversations ORDER BY 1 -- all;")
    assert out["columns"] == ["conversation_id", "tls"] and out["row_count"] == 3 and out["rows"][0]["tls"]
    assert capture.sql("WITH t(n) AS (SELECT count(*) FROM events) SELECT n FROM t")["rows"][0]["n"] == 8
    assert capture.sql("SELECT e.type FROM events e, frames f WHERE e.frame_number = f.frame_number AND f.frame_number = 6;")["row_count"] == 1
    assert capture.sql("SELECT * FROM frames", limit=2)["truncated"]
    assert capture.sql("SELECT * FROM frames WHERE 1 = 0")["columns"][0] == "frame_number"
    assert capture.sql("SELECT replace(type, 'tcp', 'set;drop') r FROM events LIMIT 1")["row_count"] == 1
    assert capture.sql("SELECT status_code FROM v_http_transactions")["rows"] == [{"status_code": 200}]
    assert capture.sql("SELECT count(*) n FROM frame_refs JOIN events ON owner_id = event_id")["rows"][0]["n"] == 8


@pytest.mark.parametrize(
    "bad",
    [
        "", "  -- nothing", "SELECT 1; SELECT 2", "DROP VIEW frames", "CREATE TABLE x AS SELECT 1", "INSERT INTO frames SELECT 1", "SET a = 1", "SELECT * FROM parquet.`/etc`",
        "SELECT * FROM other", "SELECT * FROM frames, secrets", "SELECT (SELECT max(x) FROM hidden)", "SELECT * FROM frames WHERE EXISTS (SELECT 1 FROM hidden)",
        "SELECT java_method('java.lang.System', 'exit', 1)", "SELECT reflect('a', 'b')", "SELECT * FROM global_temp.frames", "WITH a AS (SELECT * FROM hidden) SELECT * FROM a",
        "SELECT * FROM read_files('x')", "DESCRIBE frames", "SELECT frm",
    ],
)
def test_sql_refuses(capture, bad):
    with pytest.raises(sqlgate.SqlError):
        capture.sql(bad)


def test_raw(capture):
    out = capture.raw_query(["ip.src", "tcp.srcport"], "tcp.flags.syn == 1 && !tcp.flags.ack")
    assert [r["frame_number"] for r in out["rows"]] == ["1", "2"][: len(out["rows"])]
    f = lambda t: [int(r["frame_number"]) for r in capture.raw_query(["frame.number"], t)["rows"]]
    assert f("dns.flags.rcode == 3") == [8] and f("udp.port == 53 and dns") == [7, 8] and f("tcp.srcport ge 1001 or http.response.code") == [9, 10]
    assert f('dns.qry.name == "youtube.com"') == [7, 8] and f("not tcp") == [7, 8] and f("dns.id == 0x1234") == [7, 8] and f("(tcp.stream == 1) && frame.len > 500") == [10]
    assert capture.raw_query(["frame.number"], limit=3)["truncated"]
    for fields, flt, limit in (([], None, 1), (["frame.number"] * 17, None, 1), (["frame.len"], "a ~ b", 1), (["frame.len"], "frame.len ==", 1), (["frame.len"], None, 501), (["x;y"], None, 1), (["frame.len"], "x" * 501, 1)):
        with pytest.raises(rawfilter.RawError):
            capture.raw_query(fields, flt, limit)
    with pytest.raises(rawfilter.RawError, match="tcp.srcprt .*tcp.srcport"):
        capture.raw_query(["tcp.srcprt"])
    assert len(rawfilter.faults(["x;y", "nope"], 0, ["frame.len"])) == 3


def test_tools_and_registry(capture):
    s = Sessions(most=1)
    s.put(capture)
    tools = Tools(s)
    out = tools.call("traffic_query", capture_id="cap", scope="conversation")
    assert out["result"]["total"] == 3 and "rows 1-3 of 3" in out["text"] and out["audit"]["render_chars"] == len(out["text"])
    assert "error" in tools.call("traffic_query", capture_id="cap", scope="nope") and "error" in tools.call("traffic_open", capture_id="zzz") and "error" in tools.call("nope")
    for name, args in (("traffic_overview", {}), ("traffic_schema", {}), ("traffic_http_timeline", {}), ("traffic_sql", {"text": "SELECT 1 AS a"}), ("traffic_raw_query", {"fields": ["ip.src"]}), ("traffic_inspect", {"cid": "conv:udp:0"}), ("traffic_evidence", {"frames": [1]}), ("traffic_timeseries", {"cid": "conv:tcp:0", "metric": "rtt"})):
        text = tools.call(name, capture_id="cap", **args).get("text")
        assert text, name
        for part in {"traffic_overview": ["largest conversations", "2 TCP and 1 UDP"], "traffic_schema": ["conversation_id string: conv:", "null: handshake not seen"], "traffic_http_timeline": ["0 unanswered", "GET"], "traffic_evidence": ["1 records for 1"], "traffic_timeseries": ["rtt of conv:tcp:0", "100 ms"], "traffic_inspect": ["dns_query", "direction by"]}.get(name, []):
            assert part in text, (name, part, text)
    assert query_hash("a", {"b": 1, "a": 2}) == query_hash("a", {"a": 2, "b": 1})


def test_render():
    assert render.rows_text([]) == "(no rows)"
    assert render.rows_text([{"a": "x" * 50, "b": None}]).split("\n")[2] == "x" * 39 + "…  null"
    text, dropped = render.within_budget("h", ["r" * 10] * 10, "f", 60)
    assert dropped == 10 - text.count("r" * 10) and "more row(s)" in text


def test_materialized_tables_are_reused(capture, tmp_path):
    s = Session(capture.rows)
    s.materialize(str(tmp_path))
    again = Session(capture.rows)
    again.materialize(str(tmp_path))
    assert again.conversations.count() == 3 and again.events.count() == s.events.count() == 8
