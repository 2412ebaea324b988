"""Ground truth: facts built from labelled frames, invariants, and questions derived from it."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.ordered import laid, prefix
from packetloom.scoring.score import key_of
from packetloom.stage import dropped, gathered, written

FRAME = (
    "frame bigint, t_ms double, conv string, kind string, wire_len bigint, proto string, src string, sport int, dst string, dport int, isn bigint, ack bigint, "
    "of_frame bigint, qname string, rcode int, ttl int, method string, host string, uri string, status int, part int, detail string"
)
KINDS = ("scalar_number", "scalar_enum", "record", "set")
ANOMALIES = ("out_of_order", "missing_segment", "dup_ack", "zero_window")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth files, one JSON object each, with an explicit schema of their frames and facts."""
    frame = "array<struct<frame bigint, t_ms double, conv string, kind string, of_frame bigint, qname string, rcode int, ttl int, method string, uri string, status int>>"
    return spark.read.schema(f"capture string, packet_count bigint, duration_ms double, frames {frame}, facts struct<conversations array<struct<id string, proto string, src string, sport int, dst string, dport int, start_ms double, bytes bigint, frames array<bigint>>>, handshakes array<struct<conv string, syn_frame bigint, synack_frame bigint, ack_frame bigint, handshake_ms double>>, retransmissions array<struct<frame bigint, conv string, of_frame bigint, direction string>>, tcp_anomalies array<struct<kind string, frame bigint, conv string, detail string>>>").json(path, multiLine=True)


def conversations(frames: DataFrame) -> DataFrame:
    """One row a flow label; the endpoints are the first frame's."""
    start = frames.select(F.min("t_ms")).scalar()
    g = frames.filter("conv is not null").groupBy("conv").agg(F.min(F.struct("frame", "proto", "src", "sport", "dst", "dport", "t_ms")).alias("f"), F.sum("wire_len").alias("bytes"), F.sort_array(F.collect_list("frame")).alias("frames"))
    return g.select(F.col("conv").alias("id"), "f.proto", "f.src", "f.sport", "f.dst", "f.dport", (F.col("f.t_ms") - start).alias("start_ms"), "bytes", "frames")


def handshakes(frames: DataFrame) -> DataFrame:
    """SYN, then the first SYN-ACK after it, then the first ACK after that, of each flow: three
    aggregations, each over what comes after the one before."""
    d = frames.filter("kind in ('syn', 'synack', 'ack') and conv is not null").select("conv", "kind", F.struct("frame", "t_ms").alias("at"))
    found = d.filter("kind = 'syn'").groupBy("conv").agg(F.min("at").alias("a"))
    for kind, before, name in (("synack", "a", "b"), ("ack", "b", "c")):
        later = d.filter(F.col("kind") == kind).join(found, "conv").filter(F.col("at.frame") > F.col(f"{before}.frame"))
        found = later.groupBy(*found.columns).agg(F.min("at").alias(name))
    return found.select("conv", F.col("a.frame").alias("syn_frame"), F.col("b.frame").alias("synack_frame"), F.col("c.frame").alias("ack_frame"), F.round(F.col("c.t_ms") - F.col("a.t_ms"), 3).alias("handshake_ms"))


def dns(frames: DataFrame) -> DataFrame:
    """Each response with the latest earlier query of its flow and name; null names are one."""
    key = ["conv", "qname"]
    rows = frames.filter("kind in ('dns_query', 'dns_response')").select(*key, "frame", "kind", "rcode", "ttl")
    seen = prefix(laid(rows, key, ["frame"]), key, query_frame=("last", F.when(F.col("kind") == "dns_query", F.col("frame"))))
    return seen.filter("kind = 'dns_response' and query_frame is not null").select("query_frame", F.col("frame").alias("response_frame"), "qname", "rcode", "ttl")


def http(frames: DataFrame) -> DataFrame:
    """Responses (one or more frames) attach to the latest request of their flow."""
    rows = frames.filter("kind in ('http_request', 'http_response')").select("conv", "frame", "kind", "status", F.when(F.col("kind") == "http_request", F.struct("frame", "method", "host", "uri")).alias("ask"))
    d = prefix(laid(rows, ["conv"], ["frame"]), ["conv"], req=("last", F.col("ask")))
    g = d.filter("kind = 'http_response' and req is not null").groupBy("conv", "req").agg(F.sort_array(F.collect_list("frame")).alias("response_frames"), F.min_by("status", "frame").alias("status"))
    return g.select(F.col("req.frame").alias("request_frame"), F.col("response_frames")[0].alias("response_frame"), "response_frames", "req.method", "req.host", "req.uri", "status")


def retransmissions(frames: DataFrame) -> DataFrame:
    """Labelled repeats, with the way they go: from the flow's first sender or back."""
    flows = frames.filter("conv is not null")
    first = flows.groupBy("conv").agg(F.min(F.struct("frame", "src", "sport")).alias("f"))
    d = flows.filter("kind = 'retransmission'").join(first, "conv")
    out = F.col("src").eqNullSafe(F.col("f.src")) & F.col("sport").eqNullSafe(F.col("f.sport"))
    return d.select("frame", "conv", "of_frame", F.when(out, "c2s").otherwise("s2c").alias("direction"))


def anomalies(frames: DataFrame) -> DataFrame:
    return frames.filter(F.col("kind").isin(*ANOMALIES)).select("kind", "frame", "conv", "detail")


def facts(frames: DataFrame) -> dict[str, DataFrame]:
    """All tables of a ground truth, from labelled frames."""
    return {"frames": frames, "convs": conversations(frames), "handshakes": handshakes(frames), "retransmissions": retransmissions(frames), "dns": dns(frames), "http": http(frames), "anomalies": anomalies(frames)}


_MEMBERS = "(SELECT id, explode(frames) AS frame FROM {convs})"
_SHAKE = "{handshakes} h JOIN {frames} a ON a.frame = h.syn_frame JOIN {frames} b ON b.frame = h.synack_frame JOIN {frames} c ON c.frame = h.ack_frame"
_PARTS = "(SELECT *, posexplode(response_frames) AS (pos, part_frame) FROM {http})"

#: What must hold of a ground truth: a name, and the SELECT of frames that break it.
RULES = {
    "frame numbers are 1..n": "SELECT top AS frame FROM (SELECT count(*) AS n, max(frame) AS top, count(DISTINCT frame) AS d FROM {frames}) WHERE n <> top OR n <> d",
    "time is known": "SELECT frame FROM {frames} WHERE t_ms IS NULL",
    "a frame has a kind": "SELECT frame FROM {frames} WHERE kind IS NULL",
    "a flow is listed once": "SELECT min(frames[0]) AS frame FROM {convs} GROUP BY id HAVING count(*) > 1 OR id IS NULL",
    "a flow has endpoints": "SELECT frames[0] AS frame FROM {convs} WHERE proto IS NULL OR src IS NULL OR sport IS NULL OR dst IS NULL OR dport IS NULL",
    "a flow has frames in order": "SELECT coalesce(frames[0], 0) AS frame FROM {convs} WHERE size(frames) < 1 OR frames <> array_sort(frames)",
    "a flow starts with its first frame": "SELECT f.frame FROM {convs} c JOIN {frames} f ON f.frame = c.frames[0] CROSS JOIN (SELECT min(t_ms) AS t0 FROM {frames}) WHERE NOT f.conv <=> c.id OR abs(c.start_ms - (f.t_ms - t0)) > 1e-9",
    "a listed frame has its flow's label": "SELECT m.frame FROM " + _MEMBERS + " m LEFT JOIN {frames} f ON f.frame = m.frame WHERE NOT f.conv <=> m.id",
    "a frame is in one flow": "SELECT frame FROM " + _MEMBERS + " GROUP BY frame HAVING count(*) > 1",
    "a labelled frame is listed": "SELECT f.frame FROM {frames} f LEFT JOIN " + _MEMBERS + " m ON f.frame = m.frame AND f.conv = m.id WHERE f.conv IS NOT NULL AND m.id IS NULL",
    "a listed frame has its flow's endpoints": "SELECT f.frame FROM " + _MEMBERS + " m JOIN {convs} c USING (id) JOIN {frames} f ON f.frame = m.frame "
    "WHERE f.src IS NOT NULL AND NOT (f.proto = c.proto AND array_sort(array(concat(f.src, ':', f.sport), concat(f.dst, ':', f.dport))) = array_sort(array(concat(c.src, ':', c.sport), concat(c.dst, ':', c.dport))))",
    "a handshake is of a known flow": "SELECT h.syn_frame AS frame FROM {handshakes} h LEFT ANTI JOIN {convs} c ON c.id = h.conv",
    "a handshake has a SYN, a SYN-ACK and an ACK in order": "SELECT h.syn_frame AS frame FROM " + _SHAKE + " WHERE NOT (a.kind = 'syn' AND b.kind = 'synack' AND c.kind = 'ack' AND a.frame < b.frame AND b.frame < c.frame)",
    "a handshake's frames are there": "SELECT h.syn_frame AS frame FROM {handshakes} h LEFT ANTI JOIN (SELECT h.syn_frame FROM " + _SHAKE + ") k ON h.syn_frame = k.syn_frame",
    "a handshake is of one flow": "SELECT h.syn_frame AS frame FROM " + _SHAKE + " WHERE NOT (a.conv <=> h.conv AND b.conv <=> h.conv AND c.conv <=> h.conv)",
    "a handshake took the time between": "SELECT h.syn_frame AS frame FROM " + _SHAKE + " WHERE abs(h.handshake_ms - (c.t_ms - a.t_ms)) > 1e-3",
    "a SYN-ACK acknowledges its SYN": "SELECT b.frame FROM " + _SHAKE + " WHERE a.isn IS NOT NULL AND b.ack IS NOT NULL AND b.ack <> a.isn + 1",
    "an ACK acknowledges its SYN-ACK": "SELECT c.frame FROM " + _SHAKE + " WHERE b.isn IS NOT NULL AND c.ack IS NOT NULL AND c.ack <> b.isn + 1",
    "a listed retransmission is labelled so": "SELECT r.frame FROM {retransmissions} r LEFT JOIN {frames} f ON f.frame = r.frame WHERE NOT (f.kind <=> 'retransmission' AND f.conv <=> r.conv)",
    "a labelled retransmission is listed": "SELECT f.frame FROM {frames} f LEFT ANTI JOIN {retransmissions} r ON r.frame = f.frame WHERE f.kind = 'retransmission' AND f.conv IS NOT NULL",
    "a retransmission goes one way or the other": "SELECT frame FROM {retransmissions} WHERE direction IS NULL OR direction NOT IN ('c2s', 's2c')",
    "a retransmission repeats an earlier frame of its flow": "SELECT r.frame FROM {retransmissions} r LEFT JOIN {frames} o ON o.frame = r.of_frame WHERE r.of_frame IS NOT NULL AND (o.frame IS NULL OR o.frame >= r.frame OR NOT o.conv <=> r.conv)",
    "a retransmission goes as its original": "SELECT r.frame FROM {retransmissions} r JOIN {frames} f ON f.frame = r.frame JOIN {frames} o ON o.frame = r.of_frame WHERE NOT (f.src <=> o.src AND f.sport <=> o.sport AND f.dst <=> o.dst AND f.dport <=> o.dport)",
    "a DNS pair is a query and a response": "SELECT d.response_frame AS frame FROM {dns} d LEFT JOIN {frames} q ON q.frame = d.query_frame LEFT JOIN {frames} r ON r.frame = d.response_frame WHERE NOT (q.kind <=> 'dns_query' AND r.kind <=> 'dns_response' AND q.conv <=> r.conv)",
    "a DNS pair has one name": "SELECT d.response_frame AS frame FROM {dns} d JOIN {frames} q ON q.frame = d.query_frame JOIN {frames} r ON r.frame = d.response_frame WHERE NOT (q.qname <=> d.qname AND r.qname <=> d.qname)",
    "a DNS answer is its response's": "SELECT d.response_frame AS frame FROM {dns} d JOIN {frames} r ON r.frame = d.response_frame WHERE d.rcode IS NULL OR NOT (r.rcode <=> d.rcode AND r.ttl <=> d.ttl)",
    "a DNS response has a query": "SELECT f.frame FROM {frames} f LEFT ANTI JOIN {dns} d ON d.response_frame = f.frame WHERE f.kind = 'dns_response'",
    "an HTTP transaction begins with a request": "SELECT h.request_frame AS frame FROM {http} h LEFT JOIN {frames} q ON q.frame = h.request_frame WHERE NOT (q.kind <=> 'http_request' AND q.method <=> h.method AND q.host <=> h.host AND q.uri <=> h.uri)",
    "an HTTP transaction has a response and a status": "SELECT request_frame AS frame FROM {http} WHERE size(response_frames) < 1 OR status IS NULL OR NOT response_frame <=> response_frames[0]",
    "an HTTP response is of its request's flow and status": "SELECT p.part_frame AS frame FROM " + _PARTS + " p LEFT JOIN {frames} r ON r.frame = p.part_frame LEFT JOIN {frames} q ON q.frame = p.request_frame WHERE NOT (r.kind <=> 'http_response' AND r.conv <=> q.conv AND r.status <=> p.status)",
    "parts of an HTTP response are numbered in order": "SELECT r.frame FROM " + _PARTS + " p JOIN {frames} r ON r.frame = p.part_frame WHERE r.part IS NOT NULL AND r.part <> p.pos + 1",
    "an HTTP response has a request": "SELECT f.frame FROM {frames} f LEFT ANTI JOIN (SELECT explode(response_frames) AS frame FROM {http}) h ON h.frame = f.frame WHERE f.kind = 'http_response'",
    "an anomaly is of a known kind": "SELECT frame FROM {anomalies} WHERE kind IS NULL OR kind NOT IN ('out_of_order', 'missing_segment', 'dup_ack', 'zero_window')",
    "an anomaly has a detail": "SELECT frame FROM {anomalies} WHERE coalesce(detail, '') = ''",
    "an anomaly is labelled so": "SELECT a.frame FROM {anomalies} a LEFT JOIN {frames} f ON f.frame = a.frame WHERE NOT f.conv <=> a.conv OR f.kind <=> 'retransmission' OR (a.kind <> 'missing_segment' AND NOT f.kind <=> a.kind)",
    "a labelled anomaly is listed": "SELECT f.frame FROM {frames} f LEFT ANTI JOIN {anomalies} a ON a.frame = f.frame AND a.kind = f.kind WHERE f.kind IN ('out_of_order', 'dup_ack', 'zero_window')",
}


def violations(frames: DataFrame, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """(rule, frame) of every broken rule; empty if all is well. Tables of a truth file may be
    given and are then judged against its frames; others are made of the frames. Some thirty
    rules read each table, so those made here are written first, and the rules are judged one
    after another: planned as one, their joins fill the driver."""
    made = {n: written(t, n) for n, t in facts(frames).items() if n != "frames" and n not in (given or {})}
    tables = {"frames": frames} | made | (given or {})

    def broken(rule: str, sql: str) -> DataFrame:
        used = {n: t for n, t in tables.items() if "{" + n + "}" in sql}
        return frames.sparkSession.sql(sql, **used).select(F.lit(rule).alias("rule"), F.col("frame").cast("bigint").alias("frame"))

    out = gathered((broken(rule, sql) for rule, sql in RULES.items()), "broken")
    dropped(*made.values())
    return out


def node(value: dict, least: int = 1) -> dict:
    """Schema of an answer field: a value and the frames that show it."""
    return {"type": "object", "properties": {"value": value, "evidence": {"type": "array", "items": {"type": "integer", "minimum": 1}, "minItems": least, "uniqueItems": True}}, "required": ["value", "evidence"], "additionalProperties": False}


@dataclass(frozen=True)
class Template:
    """A kind of question. sql gives (of, place, value, tolerance, frames): what it is about,
    the place of a set's element, the gold value as JSON, and the frames that show it."""

    kind: str
    type: str
    field: str
    value: dict
    sql: str
    least: int = 1
    match: str = ""


#: Names, types and tolerances are those of truth files; each template reads their tables.
TEMPLATES = (
    Template("dns_ttl", "scalar_number", "ttl_seconds", {"type": "integer", "minimum": 0}, "SELECT qname AS of, 0 AS place, string(ttl) AS value, double(NULL) AS tolerance, array(response_frame) AS frames FROM {dns} WHERE ttl IS NOT NULL"),
    Template("handshake", "scalar_number", "tcp_handshake_ms", {"type": "number", "minimum": 0}, "SELECT conv AS of, 0 AS place, string(handshake_ms) AS value, double(2) AS tolerance, array(syn_frame, synack_frame, ack_frame) AS frames FROM {handshakes}"),
    Template("retransmissions", "record", "retransmission_count", {"type": "integer", "minimum": 0}, "SELECT conv AS of, 0 AS place, string(count(*)) AS value, double(NULL) AS tolerance, sort_array(collect_list(frame)) AS frames FROM {retransmissions} GROUP BY conv"),
    Template("top3_bytes", "set", "top3_sessions", {"type": "object"},
             "SELECT 'all' AS of, place, to_json(struct(dport, dst, proto, sport, src)) AS value, double(NULL) AS tolerance, frames FROM (SELECT *, row_number() OVER (ORDER BY bytes DESC, id) AS place, count(*) OVER () AS n FROM {convs} WHERE bytes IS NOT NULL) WHERE n > 2 AND place < 4", match="ordered"),
    Template("zero_window", "scalar_enum", "zero_window_seen", {"type": "boolean"},
             "SELECT c.id AS of, 0 AS place, string(a.frames IS NOT NULL) AS value, double(NULL) AS tolerance, coalesce(a.frames, array()) AS frames FROM {convs} c LEFT JOIN (SELECT conv, sort_array(collect_list(frame)) AS frames FROM {anomalies} WHERE kind = 'zero_window' GROUP BY conv) a ON a.conv = c.id WHERE c.proto = 'tcp'", least=0),
)


def gold(tables: dict[str, DataFrame], capture: str = "cap") -> DataFrame:
    """(question_id, kind, type, field, match, place, value, tolerance, frames) of all questions
    that the templates find in the tables of facts(); one row for each value or set element."""
    out = None
    for t in TEMPLATES:
        used = {n: x for n, x in tables.items() if "{" + n + "}" in t.sql}
        rows = next(iter(used.values())).sparkSession.sql(t.sql, **used)
        rows = rows.select(
            F.concat(F.lit(f"{capture}:{t.kind}:"), F.col("of").cast("string")).alias("question_id"), F.lit(t.kind).alias("kind"), F.lit(t.type).alias("type"), F.lit(t.field).alias("field"), F.lit(t.match).alias("match"),
            F.col("place").cast("int").alias("place"), "value", "tolerance", F.col("frames").cast("array<bigint>").alias("frames"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def derive(tables: dict[str, DataFrame], capture: str = "cap", packet_count: int | None = None, skip: frozenset[str] | set[str] = frozenset()) -> list[dict]:
    """Questions with schema, gold, evidence and samples, ready to be written as JSON; a repeated
    id or a frame outside the capture is an error. skip lists question ids. Questions go to
    readers one by one, so they are collected; gold() is the whole as a table."""
    spec = {t.kind: t for t in TEMPLATES}
    n = tables["frames"].count() if packet_count is None else packet_count
    found: dict[str, list] = {}
    for r in gold(tables, capture).orderBy("question_id", "place").collect():
        found.setdefault(r["question_id"], []).append(r)
    out = []
    for qid, rows in found.items():
        if qid in skip:
            continue
        t = spec[rows[0]["kind"]]
        values = [json.loads(r["value"]) for r in rows]
        if t.type != "set" and len(rows) > 1:
            raise ValueError(f"repeated question id {qid}")
        outside = [f for r in rows for f in r["frames"] if not 1 <= f <= n]
        if outside:
            raise ValueError(f"{qid}: frames {outside} are not in 1..{n}")
        several = t.type == "set"
        q = {
            "question_id": qid, "type": t.type, "tags": {"skill": [t.kind]},
            "gold": {t.field: {"value": values if several else values[0]} | ({"tolerance_abs": rows[0]["tolerance"]} if rows[0]["tolerance"] is not None else {})},
            "gold_evidence": {t.field: {key_of(v): r["frames"] for v, r in zip(values, rows, strict=True)} if several else rows[0]["frames"]},
            "answer_schema": {"x-kind": t.type, "type": "object", "properties": {t.field: {"type": "array", "items": node(t.value, t.least)} if several else node(t.value, t.least)}, "required": [t.field], "additionalProperties": False} | ({"x-match": t.match} if t.match else {}),
        }
        q["samples"] = samples(q, n)
        out.append(q)
    return out


def samples(q: dict, packet_count: int) -> list[dict]:
    """Four answers with the verdict that each must get: the right one, and one each with a
    value off, with a cited frame that the capture doesn't have, and with a word too many."""
    (field, want), shows = next(iter(q["gold"].items())), next(iter(q["gold_evidence"].values()))
    several = q["type"] == "set"
    cell = lambda v, frames: {"value": v, "evidence": frames}
    right = [cell(v, shows[key_of(v)]) for v in want["value"]] if several else cell(want["value"], shows)

    def off(v):
        if isinstance(v, bool):
            return not v
        return v * 3 + 10 + want.get("tolerance_abs", 0) if isinstance(v, (int, float)) else f"not {v}"

    beyond = lambda c: cell(c["value"], [*c["evidence"], packet_count + 1])
    made = {
        "right": ({field: right}, ()),
        "value": ({field: right[::-1] if several else cell(off(want["value"]), shows)}, ("correctness",)),
        "evidence": ({field: [*right[:-1], beyond(right[-1])] if several else beyond(right)}, ("evidence_pass",)),
        "form": ({field: right, "remark": "not asked for"}, ("schema_valid", "correctness", "evidence_pass")),
    }
    return [{"name": name, "answer": a, "expect": {k: k not in fails for k in ("schema_valid", "correctness", "evidence_pass")}} for name, (a, fails) in made.items()]


def write_questions(questions: list[dict], truth: dict, folder: str) -> list[str]:
    """One JSON file a question, written only if every sample gets its verdict and no question
    has a fault; the paths written."""
    from packetloom.scoring.score import meta_evaluate

    wrong = [f"{q['question_id']}: {f}" for q in questions for f in question_faults(q, truth)]
    wrong += [f"{c['question_id']}: sample '{c['side']}' gets another verdict" for c in meta_evaluate([(q, truth) for q in questions])["checks"] if not c["match"]]
    if wrong:
        raise ValueError("; ".join(wrong[:20]))
    os.makedirs(folder, exist_ok=True)
    paths = []
    for q in questions:
        paths.append(os.path.join(folder, re.sub(r"[^A-Za-z0-9._-]", "_", q["question_id"]) + ".json"))
        with open(paths[-1], "w", encoding="utf-8") as f:
            json.dump(q, f, ensure_ascii=False, indent=1, sort_keys=True)
    return paths


_STEM = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def load_json(folder: str, name: str, suffix: str) -> dict:
    """One JSON object by its plain name. Names are whitelisted, and what they lead to must lie
    in the folder (no links out of it)."""
    if not _STEM.fullmatch(name) or ".." in name:
        raise ValueError(f"'{name}' is not a plain file name")
    root = os.path.realpath(folder)
    path = os.path.realpath(os.path.join(root, name + suffix))
    if os.path.commonpath([root, path]) != root:
        raise ValueError(f"'{name}' lies outside {folder}")
    with open(path, encoding="utf-8") as f:
        out = json.load(f)
    if not isinstance(out, dict):
        raise ValueError(f"{name}{suffix} is not a JSON object")
    return out


def load_question(folder: str, name: str) -> dict:
    q = load_json(folder, name, ".json")
    if missing := [k for k in ("question_id", "type", "gold", "gold_evidence", "answer_schema") if k not in q]:
        raise ValueError(f"question '{name}' lacks {', '.join(missing)}")
    return q


def load_truth(folder: str, capture: str) -> dict:
    t = load_json(folder, capture, ".gt.json")
    if not isinstance(t.get("frames"), list) or not isinstance(t.get("packet_count"), int):
        raise ValueError(f"truth of '{capture}' has no frames or packet_count")
    return t


def question_faults(q: dict, truth: dict) -> list[str]:
    """What is wrong with a question as such: unknown schema words, fields without gold or
    evidence, evidence outside the capture, set elements without evidence, missing tags."""
    from packetloom.scoring.answer import schema_faults
    from packetloom.scoring.score import leaves, samples_of

    out = schema_faults(q["answer_schema"])
    for path, kind, _ in leaves(q):
        gold = q["gold"].get(path)
        if gold is None or "value" not in gold:
            out.append(f"{path}: no gold value")
            continue
        shows = q["gold_evidence"].get(path.split(".")[0])
        if kind == "set":
            keys = {key_of(v) for v in gold["value"]}
            if set(shows or {}) != keys:
                out.append(f"{path}: evidence keys differ from gold elements")
            frames = [f for fs in (shows or {}).values() for f in fs]
        else:
            frames = shows if isinstance(shows, list) else []
            if shows is None:
                out.append(f"{path}: no gold evidence")
        out += [f"{path}: frame {f} is not in 1..{truth['packet_count']}" for f in frames if not 1 <= f <= truth["packet_count"]]
    if not q.get("tags", {}).get("skill"):
        out.append("tags.skill is empty")
    sides = {n for n, *_ in samples_of(q)}
    if not sides & {"right", "known_good"}:
        out.append("no sample of a right answer")
    if not sides - {"right", "known_good"}:
        out.append("no sample of a wrong answer")
    if q["type"] not in KINDS:
        out.append(f"unknown type '{q['type']}'")
    if not str(q.get("question_id") or "").strip():
        out.append("question_id is empty")
    fields = set((q["answer_schema"].get("properties") or {}))
    out += [f"{x}: gold for a field that the schema lacks" for x in sorted({g.split(".")[0] for g in q["gold"]} - fields)]
    out += [f"{x}: evidence for a field that the schema lacks" for x in sorted(set(q["gold_evidence"]) - fields)]
    out += [f"{x}: tolerance is negative" for x, g in q["gold"].items() if any((g.get(k) or 0) < 0 for k in ("tolerance_abs", "tolerance_rel"))]
    lists = [f for f in q["gold_evidence"].values() if isinstance(f, list)] + [f for d in q["gold_evidence"].values() if isinstance(d, dict) for f in d.values()]
    if any(len(set(f)) < len(f) for f in lists):
        out.append("a gold frame is listed twice")
    return out
