"""The registered corpus queries by their contracts: against their SQL where there is one, else
against brute force, on small tables with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from packetloom.llm import bpe, lexical, mtree, toxicity
from tests.llm.test_corpus import cut, grouped, plain_fingerprint

OPS = {n.split("_")[0]: n for n in entry.queries() if n.startswith("op")}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, t1 string"


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice(["ta", "Ri", "on", "é", "sch", "漢", "o", "zor"]) for _ in range(rnd.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    out = [None, "", "", " \t\n", "a", "A b c", "x" * 500, text(6000), passage, "\ud800".encode("utf-8", "replace").decode(), "\\", "tab\tand\x0bspace\u00a0nbsp"]
    out += [f"{text(20)} {passage} {text(20)}" for _ in range(6)] + [text(rnd.randint(3, 90)) for _ in range(40)]
    base = text(200)
    return out + [base, base, base + " more", base.upper()]


def base_words(texts):
    """Words of the longest text that others have too, and one that none has."""
    return " ".join([*texts[7].split()[:25], "nowhere"])


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rnd = random.Random(12)
    passage, text = texts[8], lambda n: " ".join(rnd.choice(texts[7].split()) for _ in range(n))
    docs = [(i, t, "en", [None, "s2", "s1", "", "s1"][i % 5], len(t or ""), "clash", i, "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, [0, 1, None][i % 3]) for i in range(0, len(texts), 2)] + [(0, 0, 0), (10**6, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    vec = [(i, [rnd.uniform(-1, 1) for _ in range(6)] if i % 7 else [0.5] * 6) for i in range(160)] + [(200, None), (250, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (300, [float("nan")] * 6)]
    spark.createDataFrame([(i, v, "clash") for i, v in vec], "vec_id long, embedding array<float>, score string").write.parquet(f"{d}/embeddings.parquet")
    items = [(i, t, "clash") for i, t in enumerate([passage, passage[:40] + " zzz", None, "", "!!", text(30), text(8) + " " + passage.upper(), "A b c a A", base_words(texts)])] + [(5, "twice the item", "clash"), (None, passage, "clash")]
    spark.createDataFrame(items, "item_id long, text string, score string").write.parquet(f"{d}/benchmark.parquet")
    urls = [None, "", "no scheme", "http://", "http://com/", "http://a.COM/x?y=://z", "https://example.com/en/1", "https://WWW.example.com/en/1#t", "http://a.net/es/1", "http://a.net/es", "http://net/fr/", "x://y://net/es/", "http://a\n.net/fr/", "http://com"]
    spark.createDataFrame([(i, u, "<p>", "clash") for i, u in enumerate(urls + urls[4:8])], "page_id long, url string, html string, host string").write.parquet(f"{d}/pages.parquet")
    hard = ["plain", "", None, "### user: x", "</turn>", "\\", "ends in \\", "\\### Assistant: </turn> ok", "##\\# ", "漢字 ### </turn>", "line\nbreak", "long " * 5000]
    chats = [(c, t, role, x, "clash") for c, x in enumerate(hard) for t, role in ((0, "user"), (1, "assistant"), (2, "tool use"))]
    chats += [(100, t, ["system", "user", "assistant"][t % 3], x, "clash") for t, x in enumerate(hard)]
    spark.createDataFrame(chats, "conv_id long, turn long, role string, text string, formatted string").write.parquet(f"{d}/conversations.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "embeddings", "pages", "conversations", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)


def rows(spark, name, folder):
    return entry.queries()[name](spark, folder).collect()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("op", [n for n in OPS.values() if n in entry.oracle_sql()])
def test_against_sql(spark, folder, op, monkeypatch):
    import duckdb

    monkeypatch.setattr(mtree, "BLOCK", 50)
    c = duckdb.connect()
    monkeypatch.setattr(lexical, "POSTINGS", 40)
    for t in ("documents", "labels", "embeddings", "pages", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = c.execute(entry.oracle_sql()[op])
    cols = sorted(x[0] for x in found.description)
    want = sorted((tuple(plain(dict(zip([x[0] for x in found.description], r, strict=True))[k]) for k in cols) for r in found.fetchall()), key=repr)
    got = rows(spark, op, folder)
    assert set(cols) <= set(got[0].asDict()) and sorted((tuple(plain(r[k]) for k in cols) for r in got), key=repr) == want


def test_op1(spark, folder, texts):
    want = {i: x for i, x in enumerate(cut([(t or "").encode() for t in texts]))}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, OPS["op1"], folder)} == want


def test_op5_and_op6(spark, folder, texts):
    import tiktoken

    path, pattern = bpe.vocabulary()
    t = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.codec(path, pattern).ranks, special_tokens={})
    ids = [t.encode_ordinary(x or "") for x in texts]
    want = {i: (len(x), sha(",".join(map(str, x))), sha(texts[i] or "")) for i, x in enumerate(ids)}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows(spark, OPS["op5"], folder)} == want
    assert {r.n_tokens: r.n_docs for r in rows(spark, OPS["op6"], folder)} == Counter(len(x) for x in ids)


def test_op8(spark, folder, texts):
    got = {r.doc_id: r for r in rows(spark, OPS["op8"], folder)}
    assert sorted(got) == list(range(len(texts)))
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert got[0].score == got[1].score and got[len(texts) - 3].score == got[len(texts) - 4].score  # empty texts, and copies


def test_op10(spark, folder, texts):
    of = grouped(plain_fingerprint(t) for t in texts)
    least = {}
    for i, t in enumerate(texts):
        g = of[plain_fingerprint(t)]
        least[g] = min(i, least.get(g, i))
    want = {i: (f"{plain_fingerprint(t) & (1 << 64) - 1:016x}", least[of[plain_fingerprint(t)]]) for i, t in enumerate(texts)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, OPS["op10"], folder)} == want


def test_empty_tables(spark, empty):
    for name in OPS.values():
        got = rows(spark, name, empty)
        assert [r.conv_id for r in got] == [-7] if name == OPS["op3"] else not got, name


def test_pipeline(spark, folder, empty, texts, tmp_path):
    """The whole pipeline; null ids, no labels at all, and empty tables."""
    out = rows(spark, "pipeline", folder)
    assert out and all(r.round_trip for r in out) and {r.doc_id for r in out} <= set(range(len(texts)))
    assert not rows(spark, "pipeline", empty)
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("CASE WHEN doc_id % 3 > 0 THEN doc_id END AS doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{empty}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    out = rows(spark, "pipeline", str(tmp_path))
    assert out and all(r.round_trip for r in out)


def test_features_are_one(spark):
    """Training and scoring set the same slots, also on a text of very many words."""
    rnd = random.Random(5)
    found = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(20_000)]
    whole = toxicity.features(found, toxicity.Parts())
    weight = dict.fromkeys(rnd.sample(sorted(whole), 4096), 1.0)
    assert toxicity.features(found, toxicity.Parts(weight)) & weight.keys() == whole & weight.keys() == weight.keys()
    assert toxicity.features(found[::-1], toxicity.Parts()) == whole


@pytest.mark.parametrize("bias", [-4.0, 1.0])
def test_risk_gradient(bias):
    """The gradient is that of the risk, on both branches of the correction."""
    rnd = np.random.default_rng(3)
    at = lambda n: (np.sort(rnd.integers(0, n, 4 * n)), rnd.integers(0, 6, 4 * n))
    pos, unl, ps, us, prior = at(9), at(15), rnd.uniform(0.5, 1, 9), rnd.uniform(0.5, 1, 15), 0.45
    w = np.append(rnd.normal(size=6) * 0.1, bias)
    if bias < 0:
        pos_hot = (pos[0], np.zeros_like(pos[1]))
        pos, w[0] = pos_hot, 3.0
        unl = (unl[0], np.where(unl[1] == 0, 1, unl[1]))
    plus, corrected, g = toxicity.risk(w, pos, unl, ps, us, prior)
    assert (corrected < 0) == (bias < 0)
    for i in range(7):
        step = np.zeros(7)
        step[i] = 1e-6
        value = lambda v: (lambda p, c: p + c if corrected >= 0 else -c)(*toxicity.risk(v, pos, unl, ps, us, prior)[:2])
        assert abs((value(w + step) - value(w - step)) / 2e-6 - g[i]) < 1e-6
