"""What a review found: each of these failed before."""

import os
import re

from packetloom import model_queries
from packetloom.llm import bpe
from packetloom.operators import ordered, reassembly
from packetloom.scoring import relational, truth
from tests import own_tables
from tests import test_queries as catalogue


def tables(folder, name, sql):
    """Own tables, one of them of another making."""
    import duckdb

    own_tables.write(folder)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW old AS SELECT * FROM '{folder}/{name}.parquet'")
    c.execute(f"COPY ({sql}) TO '{folder}/new.parquet' (FORMAT parquet)")
    os.replace(f"{folder}/new.parquet", f"{folder}/{name}.parquet")
    return folder


def test_cited_frame_5_is_there(spark, tmp_path):
    """Order 0 has five lines, so the frame that answers cite in vain is one of its frames."""
    d = tables(str(tmp_path), "lineitem", "SELECT * FROM old UNION ALL SELECT * REPLACE (0 AS l_orderkey) FROM (SELECT * FROM old LIMIT 6)")
    c = catalogue.connected(d)
    assert c.execute("SELECT count(*) FROM lineitem WHERE l_orderkey > 0 AND l_tax = 0.01").fetchone()[0] > 0
    catalogue.test_query(spark, c, "score_set_citations", d)


def test_ids_asked_for_have_six_digits(spark, monkeypatch):
    """The SQL asks for evt:____50 and evt:____75; from a million events on ids are longer."""

    class Million:
        asked = None

        class events:
            count = staticmethod(lambda: 1_000_100)

        def evidence(self, event_ids):
            Million.asked = event_ids
            return {"frames": [], "requested": 0, "truncated": False}

    monkeypatch.setattr(model_queries, "_session", lambda spark, d: Million())
    model_queries.tool_evidence(spark, "")
    assert Million.asked[0] == "evt:000050" and Million.asked[-1] == "evt:999975"
    assert len(Million.asked) == 20_000 and {len(x) for x in Million.asked} == {10}


def exchanges(df):
    """The distinct exchanges of rows of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def test_scoring_deals_rows_few_times(spark, tmp_path):
    """Gold and answers meet once, so a plan has few exchanges; it had 30 and more."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = model_queries._scored(spark, own_tables.write(str(tmp_path)))
        assert exchanges(relational.sets(*scored[:2])) <= 5
        assert exchanges(relational.citations(*scored)) <= 4
        assert exchanges(relational.run_scores(*scored)) <= 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rules_are_judged_one_by_one(spark):
    """What comes back is a table; the joins of all rules are not planned as one."""
    base = {k.split()[0]: None for k in truth.FRAME.split(", ")}
    rows = [base | {"frame": 1, "t_ms": 0.0, "conv": "A", "kind": "dns_response", "wire_len": 9, "proto": "udp", "src": "a", "sport": 1, "dst": "b", "dport": 53}, base | {"frame": 3, "t_ms": 1.0, "kind": "data"}]
    found = truth.violations(spark.createDataFrame([tuple(r.values()) for r in rows], truth.FRAME))
    assert exchanges(found) == 0 and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [("a DNS response has a query", 1), ("frame numbers are 1..n", 3)]


def test_scans_carry_no_texts(spark, monkeypatch):
    """Texts are written once a step and meet the results of its scans once."""
    seen, real = [], ordered.laid
    monkeypatch.setattr(reassembly, "laid", lambda df, keys, order: (seen.append(df.columns), real(df, keys, order))[1])
    rows = [("a", 1, 100, b"ab\r"), ("a", 2, 103, b"\ncd\r\n"), ("a", 3, 101, b"b\r\n")]
    pieces = reassembly.merged(spark.createDataFrame(rows, "k string, frame_number long, seq long, data binary"), ["k"])
    found = reassembly.messages(pieces, ["k"], b"\r\n")
    assert [r.text for r in found.orderBy("message").collect()] == ["ab", "cd", ""]
    assert len(seen) == 3 and not any("text" in columns for columns in seen)


def made(spark, query, d):
    """The exchanges that a query has made when it has run, reused ones once: what they are dealt by."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = query(spark, d)
        df.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sorted(re.search(r"hashpartitioning\(([a-z_]+)#", x)[1] for x in plan.splitlines() if "Exchange hashpartitioning" in x and "Reused" not in x)


def test_sets_are_scored_where_lines_lie(spark, tmp_path):
    """The lines' one exchange, and those of their heads (of two widths); lines were written and dealt again by other keys."""
    assert made(spark, model_queries.score_sets, own_tables.write(str(tmp_path))) == ["question_id"] * 3


def test_citations_look_up_where_lines_lie(spark, tmp_path):
    """Besides the lines and their heads (of two widths) only frames, those looked up, and what is found there; lines were written and dealt again by other keys."""
    assert made(spark, model_queries.score_citations, own_tables.write(str(tmp_path))) == ["frame"] * 2 + ["question_id"] * 4


def test_set_citations_look_up_where_lines_lie(spark, tmp_path):
    """As for single values: elements and what is cited for them meet in the lines' exchange."""
    assert made(spark, model_queries.score_set_citations, own_tables.write(str(tmp_path))) == ["frame"] * 2 + ["question_id"] * 4


def test_a_task_encodes_each_word_once():
    """As many different words as a task of 16 MB has; the memo held half of them, and most were encoded twice."""
    codec = bpe.Codec(*bpe.vocabulary())
    text, seen, real = " ".join(f"w{chr(97 + i % 26)}{'abcdefghij'[i // 26 % 10]}{i}x" for i in range(40_000)).translate(str.maketrans("0123456789", "klmnopqrst")), [], codec.transducer.encode
    text = " ".join(a + w for a in ("qu", "sch", "the", "zo") for w in text.split())
    codec.transducer.encode = lambda piece: (seen.append(piece), real(piece))[1]
    assert codec.encode(text) == codec.encode(text)
    assert len(seen) == len(set(seen)) > 150_000
