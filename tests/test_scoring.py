"""Scoring, reports, ground truth and derived questions."""

import json

import pytest

from packetloom.scoring import answer, report, score, truth


def question(gold, kind="scalar_number", frames=(8, 11, 14), value=None, **root):
    n = truth.node(value or {"type": ["number", "string", "boolean", "null", "object"]}, 0)
    return {"question_id": "q", "type": kind, "gold": {"x": gold}, "gold_evidence": {"x": list(frames) if not isinstance(frames, dict) else frames}, "tags": {"skill": ["S"]}, "answer_schema": {"type": "object", "properties": {"x": {"type": "array", "items": n} if kind == "set" else n}, "required": ["x"], "additionalProperties": False} | root}


TRUTH = {"packet_count": 32, "frames": [{"frame": f, "conv": c, "kind": k} for f, c, k in ((8, "A", "re"), (11, "A", "re"), (14, "A", "re"), (9, "A", "re"), (22, "A", "data"), (31, "B", "noise"))]}


def given(v, frames=()):
    return {"x": {"value": v, "evidence": list(frames)}}


@pytest.mark.parametrize(
    ("gold", "got", "ok"),
    [
        ({"value": 70, "tolerance_abs": 2}, 70.1, True), ({"value": 70, "tolerance_abs": 2}, 68.0, True), ({"value": 70, "tolerance_abs": 2}, 67.9, False),
        ({"value": 100, "tolerance_rel": 0.05}, 104, True), ({"value": 100, "tolerance_rel": 0.05}, 106, False), ({"value": 100, "tolerance_rel": 0.05, "tolerance_abs": 1}, 104, True),
        ({"value": 3}, 3, True), ({"value": 3}, 4, False), ({"value": 3}, "3", False), ({"value": "Youtube.COM"}, "  youtube.com ", True), ({"value": True}, False, False), ({"value": True}, True, True),
    ],
)
def test_scalars(gold, got, ok):
    kind = "scalar_number" if isinstance(gold["value"], (int, float)) and not isinstance(gold["value"], bool) else "scalar_enum"
    assert score.correctness(question(gold, kind), given(got))["correct"] is ok


def test_sets():
    el = lambda *vs: [{"value": v, "evidence": []} for v in vs]
    assert score.sets("unordered", ["a", "b"], el("b", "a"))["pass"] and not score.sets("ordered", ["a", "b"], el("b", "a"))["pass"]
    assert score.sets("top_k_prefix", ["a", "b", "c"], el("b", "a", "c")) == {"pass": True, "partial": 1.0, "rank_errors": 2}
    assert score.sets("top_k_prefix", ["a", "b", "c"], el("a", "b", "z")) == {"pass": False, "partial": 2 / 3, "rank_errors": 1}
    t = {"proto": "tcp", "src": "a", "sport": 1, "dst": "b", "dport": 2}
    assert score.key_of(t | {"note": 1}) == "tcp|a:1>b:2" and score.key_of({"b": 1, "a": [2]}) == '{"a":[2],"b":1}'


def test_evidence():
    gold = [8, 11, 14]
    one = score.cite([8], gold, TRUTH)
    assert (one["precision"], one["recall"], one["pass"]) == (1, 1 / 3, True)
    noise = score.cite([8, 31], gold, TRUTH)
    assert noise["buckets"]["irrelevant"] == [31] and not noise["pass"] and not noise["review"]
    out = score.cite([1, 99], gold, TRUTH)
    assert out["buckets"]["invalid"] == [99] and not out["valid"]
    near = score.cite([8, 22, 9], gold, TRUTH)
    assert near["buckets"]["related"] == [22] and near["buckets"]["equivalent"] == [9] and near["review"]
    assert score.cite([], [], TRUTH)["pass"] and not score.cite([8], [], TRUTH)["pass"] and score.cite([8], [], TRUTH)["precision"] == 0
    q = question({"value": ["a", "b"]}, "set", {'"a"': [8], '"b"': [11]})
    e = score.evidence(q, TRUTH, {"x": [{"value": "a", "evidence": [8]}, {"value": "z", "evidence": []}]})
    assert [(r["element"], r["pass"], r["in_gold"]) for r in e["fields"]] == [('"a"', True, True), ('"b"', False, True), ('"z"', True, False)] and e["coverage"] == 0.5


def test_answers_and_schema():
    text = "x\n```json\n{\"a\": 1}\n```\nthen\n```JSON\n{\"a\": 2}\n```\n```json\nbroken\n```"
    assert answer.final_answer(text) == {"status": "ok", "value": {"a": 2}, "several": True}
    assert answer.final_answer("nothing")["reason"] == "no_fenced_json_block" and answer.final_answer("```json\n{\n```")["reason"] == "json_parse_failed"
    s = {"type": "object", "properties": {"a": {"$ref": "#/$defs/n"}, "l": {"type": "array", "items": {"type": "string"}, "minItems": 1, "maxItems": 2, "uniqueItems": True}, "e": {"enum": [1, None]}}, "required": ["a"], "additionalProperties": False, "$defs": {"n": {"type": "integer", "minimum": 0, "maximum": 9}}}
    assert answer.faults(s, {"a": 3, "l": ["x"], "e": None}) == [] and answer.schema_faults(s) == []
    assert len(answer.faults(s, {"l": ["x", "x", 3], "e": 2, "z": 1})) == 6
    assert answer.faults(s, {"a": -1}) and answer.faults(s, {"a": 10}) and answer.faults(s, {"a": 1.5}) and answer.faults(s, [])
    assert len(answer.schema_faults({"pattern": "x", "items": {"$ref": "#/no"}})) == 2


def test_unsupported_claims():
    q = question({"value": []}, "set", {})
    assert score.unsupported(q, {"x": {"value": []}}) == {"applicable": True, "hallucinated": False}
    assert score.unsupported(question({"value": "unknowable"}, "scalar_enum"), given("a"))["hallucinated"]
    assert not score.unsupported(question({"value": 1}), given(2))["applicable"] and not score.unsupported(question({"value": "unknowable"}), None)["hallucinated"]


def test_report(spark):
    q = question({"value": 70, "tolerance_abs": 2})
    text = lambda v: "```json\n" + json.dumps(given(v, [8])) + "\n```"
    runs = [(q, score.score_text(q, TRUTH, t), m) for t, m in ((text(70), {"tokens": 150}), (text(1), {"tokens": 300}), ("none", {}))]
    r = runs_frame = report.runs_frame(spark, runs)
    s = report.summary(r).first()
    assert s.m1_correct == pytest.approx(1 / 3) and s.tokens_per_correct == 450 and s.m3_precision == 1 and s.m4_hallucination is None and s.format_error_rate == pytest.approx(1 / 3)
    assert report.buckets(runs_frame, "skill").first().asDict() == {"skill": "S", "total": 3, "correct": 1}
    assert report.majority(r).first().correct is False
    assert report.summary(r.filter("1 = 0")).first().m1_correct is None


def frames(spark):
    base = {k.split()[0]: None for k in truth.FRAME.split(", ")}
    t = {"proto": "tcp", "src": "a", "sport": 1, "dst": "b", "dport": 2}
    rows = [
        {"frame": 1, "t_ms": 5.0, "conv": "A", "kind": "syn", "wire_len": 60, "isn": 100} | t, {"frame": 2, "t_ms": 9.0, "conv": "A", "kind": "synack", "wire_len": 60, "isn": 500, "ack": 101} | t,
        {"frame": 3, "t_ms": 13.0, "conv": "A", "kind": "ack", "wire_len": 52, "ack": 501} | t, {"frame": 4, "t_ms": 14.0, "conv": "A", "kind": "http_request", "wire_len": 100, "method": "GET", "host": "h", "uri": "/"} | t,
        {"frame": 5, "t_ms": 15.0, "conv": "A", "kind": "http_response", "wire_len": 900, "status": 200, "part": 1} | t, {"frame": 6, "t_ms": 16.0, "conv": "A", "kind": "http_response", "wire_len": 900, "status": 200, "part": 2} | t,
        {"frame": 7, "t_ms": 17.0, "conv": "A", "kind": "retransmission", "wire_len": 900, "of_frame": 5} | t, {"frame": 8, "t_ms": 20.0, "conv": "B", "kind": "dns_query", "wire_len": 70, "qname": "n", "proto": "udp", "src": "a", "sport": 9, "dst": "c", "dport": 53},
        {"frame": 9, "t_ms": 21.0, "conv": "B", "kind": "dns_response", "wire_len": 80, "qname": "n", "rcode": 0, "ttl": 60, "proto": "udp", "src": "c", "sport": 53, "dst": "a", "dport": 9},
    ]
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], truth.FRAME)


def test_truth_and_derivation(spark, tmp_path):
    f = frames(spark).cache()
    c = {r.id: r for r in truth.conversations(f).collect()}
    assert c["A"].bytes == 2972 and c["A"].frames == [1, 2, 3, 4, 5, 6, 7] and c["B"].start_ms == 15
    assert truth.handshakes(f).first().asDict() == {"conv": "A", "syn_frame": 1, "synack_frame": 2, "ack_frame": 3, "handshake_ms": 8.0}
    assert truth.dns(f).first().query_frame == 8 and truth.http(f).first().response_frames == [5, 6]
    assert truth.violations(f).count() == 0
    broken = f.withColumn("of_frame", truth.F.when(truth.F.col("frame") == 7, 8)).filter("frame <> 4")
    assert {r.rule for r in truth.violations(broken).collect()} == {"frame numbers are 1..n", "a retransmission repeats an earlier frame of its flow", "an HTTP response has a request", "a retransmission goes as its original"}
    wrong = truth.facts(f) | {"handshakes": truth.handshakes(f).withColumn("handshake_ms", truth.F.lit(1.0)), "dns": truth.dns(f).withColumn("ttl", truth.F.lit(1)), "anomalies": spark.createDataFrame([("odd", 1, "A", "")], "kind string, frame bigint, conv string, detail string")}
    assert {r.rule for r in truth.violations(f, wrong).collect()} == {"a handshake took the time between", "a DNS answer is its response's", "an anomaly is of a known kind", "an anomaly has a detail", "an anomaly is labelled so"}
    assert truth.retransmissions(f).first().asDict() == {"frame": 7, "conv": "A", "of_frame": 5, "direction": "c2s"}
    more = spark.createDataFrame([("C", "udp", "a", 9, "c", 99, 1.0, 1, [9])], truth.conversations(f).schema)
    tables = truth.facts(f) | {"convs": truth.conversations(f).unionByName(more)}
    qs = truth.derive(tables, "t")
    assert [q["question_id"] for q in qs] == ["t:dns_ttl:n", "t:handshake:A", "t:retransmissions:A", "t:top3_bytes:all", "t:zero_window:A"]
    by = {q["question_id"]: q for q in qs}
    assert by["t:handshake:A"]["gold"] == {"tcp_handshake_ms": {"value": 8.0, "tolerance_abs": 2.0}} and by["t:zero_window:A"]["gold"] == {"zero_window_seen": {"value": False}}
    assert [v["dport"] for v in by["t:top3_bytes:all"]["gold"]["top3_sessions"]["value"]] == [2, 53, 99] and by["t:retransmissions:A"]["gold_evidence"] == {"retransmission_count": [7]}
    assert "t:dns_ttl:n" not in {q["question_id"] for q in truth.derive(tables, "t", skip={"t:dns_ttl:n"})}
    gt = {"packet_count": 9, "frames": [r.asDict() for r in f.collect()]}
    assert not [x for q in qs for x in truth.question_faults(q, gt)]
    assert len(truth.question_faults({"question_id": "x", "type": "scalar_number", "answer_schema": {"properties": {"a": {}}, "pattern": 1}, "gold": {}, "gold_evidence": {}}, gt)) == 5
    m = score.meta_evaluate([(q, gt) for q in qs])
    assert m["pass"] and len(m["checks"]) == 20, [c for c in m["checks"] if not c["match"]]
    paths = truth.write_questions(qs, gt, str(tmp_path))
    assert len(paths) == 5 and truth.load_question(str(tmp_path), "t_handshake_A")["gold"] == by["t:handshake:A"]["gold"]
    for name in ("../x", "a/b", "", ".x"):
        with pytest.raises(ValueError):
            truth.load_question(str(tmp_path), name)
    qs[0]["samples"][1]["expect"]["correctness"] = True
    with pytest.raises(ValueError, match="another verdict"):
        truth.write_questions(qs, gt, str(tmp_path))
