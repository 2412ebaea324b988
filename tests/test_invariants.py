"""Each rule of a ground truth, broken once on purpose; and the report's files."""

import json

import pytest

from packetloom.scoring import report, truth

A, B, D = ("10.0.0.1", 1000), ("10.0.0.2", 80), ("9.9.9.9", 53)


def frame(n, conv, kind, src=None, dst=None, **more):
    names = [x.split()[0] for x in truth.FRAME.split(", ")]
    base = dict.fromkeys(names) | {"frame": n, "t_ms": float(n), "conv": conv, "kind": kind, "wire_len": 60}
    if src:
        base |= {"proto": "udp" if D in (src, dst) else "tcp", "src": src[0], "sport": src[1], "dst": dst[0], "dport": dst[1]}
    return base | more


FRAMES = [
    frame(1, "c1", "syn", A, B, isn=100), frame(2, "c1", "synack", B, A, isn=500, ack=101), frame(3, "c1", "ack", A, B, ack=501),
    frame(4, "c1", "http_request", A, B, method="GET", host="h", uri="/a"), frame(5, "c1", "http_response", B, A, status=200, part=1), frame(6, "c1", "http_response", B, A, status=200, part=2),
    frame(7, "c1", "retransmission", A, B, of_frame=4), frame(8, "c1", "zero_window", B, A, detail="closed"),
    frame(9, "c2", "dns_query", A, D, qname="n"), frame(10, "c2", "dns_response", D, A, qname="n", rcode=0, ttl=60),
    frame(11, "c1", "dup_ack", B, A, detail="again"), frame(12, None, "data"),
]
#: What breaks a rule: a table, a row of it, and what becomes of the row.
DROP, TWICE = "drop", "twice"
BROKEN = {
    "frame numbers are 1..n": ("frames", 0, {"frame": 99}), "time is known": ("frames", 0, {"t_ms": None}), "a frame has a kind": ("frames", 11, {"kind": None}),
    "a flow is listed once": ("convs", 0, TWICE), "a flow has endpoints": ("convs", 0, {"src": None}), "a flow has frames in order": ("convs", 0, {"frames": [2, 1]}),
    "a flow starts with its first frame": ("convs", 0, {"start_ms": 5.0}), "a listed frame has its flow's label": ("convs", 0, {"frames": [1, 2, 9]}), "a frame is in one flow": ("convs", 1, {"frames": [9, 10, 1]}),
    "a labelled frame is listed": ("convs", 0, {"frames": [1]}), "a listed frame has its flow's endpoints": ("frames", 3, {"dport": 81}),
    "a handshake is of a known flow": ("handshakes", 0, {"conv": "zz"}), "a handshake has a SYN, a SYN-ACK and an ACK in order": ("handshakes", 0, {"synack_frame": 3, "ack_frame": 2}),
    "a handshake's frames are there": ("handshakes", 0, {"ack_frame": 77}), "a handshake is of one flow": ("frames", 1, {"conv": "c2"}), "a handshake took the time between": ("handshakes", 0, {"handshake_ms": 9.0}),
    "a SYN-ACK acknowledges its SYN": ("frames", 1, {"ack": 7}), "an ACK acknowledges its SYN-ACK": ("frames", 2, {"ack": 7}),
    "a listed retransmission is labelled so": ("frames", 6, {"kind": "data"}), "a labelled retransmission is listed": ("retransmissions", 0, DROP), "a retransmission goes one way or the other": ("retransmissions", 0, {"direction": "up"}),
    "a retransmission repeats an earlier frame of its flow": ("retransmissions", 0, {"of_frame": 9}), "a retransmission goes as its original": ("retransmissions", 0, {"of_frame": 5}),
    "a DNS pair is a query and a response": ("dns", 0, {"query_frame": 1}), "a DNS pair has one name": ("dns", 0, {"qname": "m"}), "a DNS answer is its response's": ("dns", 0, {"ttl": 1}), "a DNS response has a query": ("dns", 0, DROP),
    "an HTTP transaction begins with a request": ("http", 0, {"uri": "/b"}), "an HTTP transaction has a response and a status": ("http", 0, {"status": None}),
    "an HTTP response is of its request's flow and status": ("frames", 4, {"status": 404}), "parts of an HTTP response are numbered in order": ("frames", 5, {"part": 7}), "an HTTP response has a request": ("http", 0, DROP),
    "an anomaly is of a known kind": ("anomalies", 0, {"kind": "odd"}), "an anomaly has a detail": ("anomalies", 0, {"detail": ""}), "an anomaly is labelled so": ("anomalies", 0, {"conv": "c2"}), "a labelled anomaly is listed": ("anomalies", 0, DROP),
}


@pytest.fixture(scope="module")
def whole(spark):
    tables = truth.facts(spark.createDataFrame([tuple(f.values()) for f in FRAMES], truth.FRAME))
    return {n: (t.schema, sorted((r.asDict() for r in t.collect()), key=repr) if n != "frames" else FRAMES) for n, t in tables.items()}


def broken_by(spark, rule, tables):
    sql = truth.RULES[rule]
    used = {n: spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema) for n, (schema, rows) in tables.items() if "{" + n + "}" in sql}
    return spark.sql(sql, **used).count()


def test_all_rules_hold(spark, whole):
    assert set(BROKEN) == set(truth.RULES)
    frames = spark.createDataFrame([tuple(f.values()) for f in FRAMES], truth.FRAME)
    assert truth.violations(frames).collect() == []


@pytest.mark.parametrize("rule", BROKEN)
def test_a_broken_rule_is_told(spark, whole, rule):
    name, at, change = BROKEN[rule]
    schema, rows = whole[name]
    rows = list(rows)
    if change == DROP:
        rows = rows[:at] + rows[at + 1 :]
    elif change == TWICE:
        rows.append(rows[at])
    else:
        rows[at] = rows[at] | change
    assert broken_by(spark, rule, whole | {name: (schema, rows)}) > 0


def test_report_files(spark, tmp_path):
    rows = [("q1", "correct", "s"), ("q2", "wrong", "s"), ("q3", "correct", None)]
    runs = spark.createDataFrame([(q, c, s, *[None] * 4, True, False, False, None, 1.0, 1.0, 0.5, 10.0, 2.0, 3.0) for q, c, s in rows], report.RUNS)
    report.write(runs, f"file://{tmp_path}/out", "skill", "classification")
    (one,) = [json.loads(x) for p in (tmp_path / "out" / "report.json").glob("part-*") for x in p.read_text().splitlines()]
    assert one["runs"] == 3 and one["m1_correct"] == pytest.approx(2 / 3) and one["m3_recall"] == 0.5
    slices = {(r.slice, r.name): (r.total, r.correct, r.share) for r in spark.read.json(f"file://{tmp_path}/out/slices.json").collect()}
    assert slices == {("skill", "s"): (2, 1, 0.5), ("skill", None): (1, 1, 1.0), ("classification", "correct"): (2, 2, 1.0), ("classification", "wrong"): (1, 0, 0.0)}
