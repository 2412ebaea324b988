"""Corpus operators against brute force, with nulls, ties, repeats, clashes and empty tables."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import bpe, chat, components, exact_dedup, mixing, mtree, simhash, suffix_dedup, token_counts, toxicity, url_filter
from packetloom.llm.common import WORD, materialize, without

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages, nulls, repeats and one very long text."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice(["ta", "ri", "on", "é", "sch", "Al", "漢", "o"]) for _ in range(rnd.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(70)
    out = [None, "", " \n", "a", "a b", "a b c", "a" * 450, "ab" * 230, passage, passage]
    out += [f"{text(30)} {passage} {text(30)}" for _ in range(12)]
    base = text(300)
    for k in range(8):
        w = base.split(" ")
        w[40 * k % 300] = word() + str(k)
        out.append(" ".join(w))
    out += [base, base, base, text(9000), "tab\tand\x0bspace\u00a0nbsp", "NULL", "null"] + [text(rnd.randint(1, 120)) for _ in range(60)]
    rows = [(i, t, "en", [None, "src1", "src0", "s"][i % 4] if i % 3 else "src0", len(t or "")) for i, t in enumerate(out)]
    return rows + [rows[20], rows[20], (None, "no id", "en", "s", 5), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return materialize(spark.createDataFrame(corpus, DOCS).repartition(3), "test")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1: repeated byte strings ---


def cut(texts):
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        mark = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                mark[i : i + 200] = True
        kept = bytes(b for b, m in zip(t, mark, strict=False) if not m)
        out.append((len(t), len(t) - len(kept), int((np.diff(np.concatenate(([0], mark.astype(int)))) == 1).sum()), sha(kept)))
    return out


@pytest.mark.parametrize("crowd", [16_384, 2])
def test_remove_repeats(spark, docs, corpus, empty, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    want = Counter(zip([r[0] for r in corpus], cut([(r[1] or "").encode() for r in corpus]), strict=True))
    got = suffix_dedup.remove_repeats(docs.withColumn("kept", F.lit("clash")).withColumn("t1", F.lit(0)), carry=["doc_id", "t1", "kept"]).collect()
    assert Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept)))) for r in got) == want
    if crowd > 2:
        assert suffix_dedup.remove_repeats(empty).count() == 0


def test_remove_repeats_across_buffers(monkeypatch):
    """Long texts are cut into pieces; each string of DEPTH bytes is whole in one."""
    monkeypatch.setattr(suffix_dedup, "BUFFER", 1000)
    texts = [bytes(random.Random(k).randbytes(n)) for k, n in enumerate((0, 199, 200, 700, 4000))]
    seen = Counter()
    for data, rows in suffix_dedup.pieces(texts):
        for k, at, pos, n in rows:
            assert data[pos : pos + n] == texts[k][at : at + n]
        s, e, _, _, which, _ = suffix_dedup.runs(data, rows)
        for a, z, w in zip(s, e, which, strict=True):
            k, at, pos, _ = rows[w]
            seen.update((k, x - pos + at) for x in range(a, z + 1))
    assert seen.keys() == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 199)} and max(seen.values()) == 1


# --- 2: top-k ---


@pytest.mark.parametrize(("block", "balls", "large"), [(16384, 1 << 20, 1), (64, 1 << 20, 1), (64, 0, 1), (64, 1 << 20, 1e6)])
def test_top_k(spark, monkeypatch, block, balls, large):
    """One block and many, with and without balls, scores beyond 2^53, repeated rows."""
    monkeypatch.setattr(mtree, "BLOCK", block)
    monkeypatch.setattr(mtree, "BALL_BYTES", balls)
    monkeypatch.setattr(mtree, "PAGE", 16)
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 8)).astype(np.float32)
    x[100:220] = x[50]  # one very common vector
    x *= np.float32(large)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(350, [float(v) for v in x[350]]), (350, [float(v) for v in x[350]]), (1000, None), (1050, [1.0, None]), (1100, [float("nan")]), (1150, [float("inf")]), (1200, [0.5]), (7, [9.0] * 8), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = sorted(tuple(r) for r in mtree.top_k(df, every=50).collect())
    ok = [(i, np.pad(np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int), (0, 8 - len(v)))) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        mine = {tuple(a) for i, a in ok if i == q}
        best = sorted((-sum(int(x) * int(y) for x, y in zip(a, c, strict=True)), i) for a in mine for i, c in ok if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    if large == 1 and block > 64:
        assert mtree.top_k(df.limit(0)).count() == 0 and mtree.top_k(df.filter("vec_id = 50")).count() == 0
        with pytest.raises(ValueError, match="64 bits"):
            mtree.top_k(spark.createDataFrame([(50, [1e17, 1.0])], "vec_id long, embedding array<double>"))


# --- 3: chats ---


def test_chats(spark):
    hard = ["plain", "", "### user: x", "</turn>", "\\", "\\### Assistant: </turn> ok", "a</turn>\n### b: c", "a</turn>\n### 50%zz: c", "##\\# ", "line\nbreak ###", "漢字 ### </turn>", "<\\/turn>", "\\\\n", "##", "### "]
    rows = [(c, t, r, x) for c, (t, r, x) in enumerate((t, r, x) for x in hard for t, r in ((0, "user"), (1, "assistant")))]
    rows += [(900, t, ["system", "user", "assistant"][t % 3], x) for t, x in enumerate(hard)]
    rows += [(901, 0, None, None), (901, None, "a: b ### </turn>", "odd"), (901, 0, None, None), (None, 1, "assistant", "x"), (902, 1, "assistant", "b"), (902, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_chats(df)
    back = out.withColumn("turns", chat.parse(F.col("formatted"))).collect()
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert len(back) == len(by)
    for r in back:
        turns = [(a, b) for *_, a, b in sorted(by[r.conv_id])]
        assert [tuple(t) for t in r.turns] == turns
        loss = [re.sub(r"(?s)\\(.)", r"\1", r.formatted[s.start : s.end]) for s in r.loss_spans]
        assert loss == [x for role, x in turns if role == "assistant"]
        assert r.formatted.count("### ") == len(turns) == r.formatted.count("</turn>")
    assert {r.level for r in back} == {0, 1, 2}
    assert chat.format_chats(df.limit(0)).count() == 0


# --- 4: exact dedup ---


def test_exact_dedup(spark, docs, corpus, empty):
    want = {}
    for i, t, *_ in corpus:
        want.setdefault(t or "", []).append(i)
    got = exact_dedup.exact_dedup(docs.withColumn("kept", F.lit("clash")).withColumn("h", F.lit(1))).collect()
    assert len(got) == len(corpus)
    for r in got:
        ids = want[r.text or ""]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None) and r.text_sha256 == sha(r.text or "")
    assert Counter(r.text or "" for r in got if r.kept) == dict.fromkeys(want, 1)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.exact_dedup(docs, carry=["doc_id"]).filter("kept").count() == len(want)


def test_exact_dedup_with_a_full_filter(spark, docs, corpus, monkeypatch):
    """A filter that is too small lets more rows through and changes nothing."""
    monkeypatch.setattr(exact_dedup, "capped_bits", lambda n, *a: 64)
    assert exact_dedup.exact_dedup(docs).filter("kept").count() == len({r[1] or "" for r in corpus})


def test_exact_dedup_by_ranges(spark, docs, corpus, monkeypatch):
    """Several filters, each for a range of hashes, find what one finds."""
    monkeypatch.setattr(exact_dedup, "MOST", 300)
    for carry in (None, ["doc_id"]):
        out = exact_dedup.exact_dedup(docs, carry=carry)
        assert out.filter("kept").count() == len({r[1] or "" for r in corpus}) and out.count() == len(corpus)


def test_without(spark):
    df = spark.range(1000).withColumn("k", F.lit("clash"))
    out = without(df, F.xxhash64("id"), spark.range(0, 1000, 7).select(F.xxhash64("id").alias("k")))
    assert sorted(r.id for r in out.collect()) == [i for i in range(1000) if i % 7] and out.columns == ["id", "k"]


# --- 5 and 6: byte-level BPE ---


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    path, pattern = bpe.vocabulary()
    c = bpe.codec(path, pattern)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=c.ranks, special_tokens={}), c


def test_bpe_fuzz(tokenizer, monkeypatch):
    t, c = tokenizer
    rnd, words = random.Random(5), [w.decode("utf-8", "ignore") for w in random.Random(6).sample(list(c.ranks), 800)]
    letters = "abcdefghijéèüñ  \n\t0123'stre🙂漢字%$#.,-ÀÿABC"
    for looked in (3, 512):
        monkeypatch.setattr(bpe, "LOOKED", looked)
        c.memo.clear()
        c.older.clear()
        for k in range(900):
            text = ("".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))), "".join(rnd.choice(words) for _ in range(9)), rnd.choice(["a", "ab", "=", "-= "]) * rnd.randint(1, 300))[k % 3]
            ids = np.frombuffer(c.encode(text), "<i4")
            assert ids.tolist() == t.encode_ordinary(text)
            assert "".join(c.decode(ids, step=rnd.randint(1, 5))) == text


def test_utf8_machine():
    text = "aé漢🙂" * 3
    m = bpe.Utf8Machine()
    assert "".join(m.feed(bytes([b])) for b in text.encode()) + m.feed(b"", final=True) == text
    m = bpe.Utf8Machine()
    assert m.feed(b"\xe6\xbc") == "" and m.feed(b"", final=True) == "\ufffd"


def test_encode_decode_and_histogram(spark, docs, corpus, empty, tokenizer):
    t, _ = tokenizer
    path, pattern = bpe.vocabulary()
    df = docs.withColumn("ids", F.lit("clash"))
    out = bpe.decode(bpe.encode(df, path, pattern), path, pattern).collect()
    want = Counter((i, x, tuple(t.encode_ordinary(x or ""))) for i, x, *_ in corpus)
    assert Counter((r.doc_id, r.text, tuple(r.ids)) for r in out) == want and all(r.decoded == (r.text or "") and r.n_tokens == len(r.ids) for r in out)
    assert bpe.encode(empty, path, pattern).count() == 0 and bpe.decode(bpe.encode(empty, path, pattern), path, pattern).count() == 0
    sizes = Counter(len(k[2]) for k in want.elements())
    rows = {r.n_tokens: r for r in token_counts.length_histogram(bpe.encode(docs, path, pattern, ids=False)).collect()}
    assert {k: r.n_docs for k, r in rows.items()} == sizes
    for k, r in rows.items():
        assert r.docs_upto == sum(v for s, v in sizes.items() if s <= k) and r.docs_over == sum(v for s, v in sizes.items() if s > k)
        assert r.tokens_upto == sum(s * v for s, v in sizes.items() if s <= k) and r.truncated_total == sum(min(s, k) * v for s, v in sizes.items())
        assert (r.n_total, r.tokens_total) == (len(corpus), sum(s * v for s, v in sizes.items()))
    hist = token_counts.length_histogram(bpe.encode(docs, path, pattern, ids=False).unionByName(spark.createDataFrame([(None,)], "n_tokens long"), allowMissingColumns=True))
    limits = [0, 1, 3, 50, 10**7, max(sizes), min(sizes) - 1]
    got = {r.n_limit: (r.docs_over, r.truncated_total) for r in token_counts.at_limits(hist, limits).collect()}
    assert got == {x: (sum(v for s, v in sizes.items() if s > x), sum(max(0, min(s, x)) * v for s, v in sizes.items())) for x in limits}
    flat = sorted(sizes.elements())
    for share, n in ((r.share, r.n_tokens) for r in token_counts.quantiles(hist, [0, 0.25, 0.5, 0.99, 1]).collect()):
        assert n == flat[max(0, math.ceil(share * len(flat)) - 1)]
    none = token_counts.length_histogram(spark.createDataFrame([], "n_tokens long"))
    assert none.count() == 0 and token_counts.quantiles(none, [0.5]).count() == 0 and [tuple(r) for r in token_counts.at_limits(none, [5]).collect()] == [(5, 0, 0)]


# --- 7: mixing ---


def goals(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, total = set(order), share * sum(sizes.values())
    while left:
        level = (total - sum(most * sizes[s] for s in order if s not in left)) / sum(w[s] for s in left)
        over = {s for s in left if level * w[s] > most * sizes[s] + 1e-9}
        if not over:
            break
        left -= over
    return {s: level * w[s] if s in left else most * sizes[s] for s in order}


def test_mix(spark, docs, corpus, empty):
    got = mixing.mix(docs.withColumn("size", F.lit("clash")).withColumn("h", F.lit(1))).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((r[0], r[3], words(r[1])) for r in corpus)
    total, taken = Counter(), Counter()
    for r in got:
        total[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    want = goals(dict(total))
    largest = {s: max(r.size for r in got if r.source == s) for s in total}
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(want[r.source])
    # the nearest whole document: off by half of one at most (rows of one doc_id go together)
    assert all(abs(taken[s] - want[s]) <= 1.5 * largest[s] + 1 for s in total)
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    n = {r.doc_id: r["count"] for r in mixed.filter("doc_id is not null and doc_id <> 20").groupBy("doc_id").count().collect()}
    assert all(n.get(r.doc_id, 0) * r.size == r.taken for r in got if r.doc_id not in (None, 20))



def test_targets_reshare(spark):
    """A small source is capped and its excess goes to the others by weight."""
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == {"a": 20, "b": pytest.approx(2995 / 3), "c": pytest.approx(5990 / 3)}


# --- 8: toxicity ---


def test_toxicity(spark, empty):
    rnd = random.Random(2)
    clean = [f"w{rnd.choice('abcdefghij')}{rnd.choice('klmnopqrst')}o" for _ in range(80)]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 6 == 0
        words = [rnd.choice(clean) for _ in range(rnd.randint(5, 60))] + ([f"zorg{rnd.choice('abcdef')}" for _ in range(3)] if bad else [])
        rnd.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 1))
        if rnd.random() < 0.5:
            labels.append((i, 1, int(bad)))
    rows += [(5000, None, None, None, None), (5001, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    table = spark.createDataFrame([*labels, (9999, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, table)
    out = toxicity.score(docs, model, carry=["doc_id"]).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held and r.doc_id < 1500]
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    assert [r.predicted for r in out if r.doc_id >= 5000] == [0, 0]
    # held-out labels never matter
    flipped = table.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.allclose(toxicity.train(docs, flipped).weights, model.weights)
    nothing = toxicity.train(docs, table.limit(0))
    assert {r.predicted for r in toxicity.score(docs, nothing).collect()} == {0}
    assert toxicity.score(empty, model).count() == 0 and toxicity.train(empty, table).bias < 0


def test_toxicity_of_long_texts(spark, tmp_path):
    """Clean texts hold a toxic word by chance now and then; joined, they stay clean."""
    import corpus_pipeline as p

    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(8000)]
    bad = [f"{a}{b}{c}qx" for a in "wz" for b in "aeiou" for c in "rstv"]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    clean = [" ".join(text(rnd.randint(20, 300)) + [rnd.choice(bad)] * (rnd.random() < 0.1)) for _ in range(1200)]
    toxic = [" ".join(text(n := rnd.randint(20, 300)) + rnd.sample(bad, 2 + n // 40)) for _ in range(200)]
    long = [" ".join(rnd.sample(clean, n)) for n in (100, 100, 300, 1000)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean + toxic + long)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 1200)) for i in range(1400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id for r in p.toxic(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert {i for i, *_ in rows[1400:]} <= kept
    assert len([i for i in kept if i < 1200]) >= 0.98 * 1200 and len([i for i in kept if 1200 <= i < 1400]) <= 0.1 * 200


# --- 9: urls ---


def judged(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fit, default=(0, None, "allow"))
    return host, path, rule, verdict


@pytest.mark.parametrize("literal", [2000, 0])
def test_urls(spark, literal, monkeypatch):
    monkeypatch.setattr(url_filter, "LITERAL_RULES", literal)
    urls = [None, "", "no scheme", "http://", "http://com/", "http://a.COM/x?y=://z", "https://example.com/en/1", "https://WWW.example.com/en/1#t", "https://x.www.example.com/en/", "http://notexample.com/en/", "http://a.net/es/1", "http://a.net/es",
            "http://net/fr/", "http://anet/fr/", "http://a.net?/es/", "http://a.net/de/", "x://y://net/es/", "http://É.net/es/", "http://a\n.net/fr/", "http://a.net:80/es/", "http://com"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(df).collect()}
    assert got == {i: judged(u, url_filter.RULES) for i, u in enumerate(urls)}
    assert url_filter.url_filter(df.limit(0)).count() == 0
    # rules without a literal token, and repeated rows
    more = [*url_filter.RULES, ("block", "", "/x"), ("block", "", "")]
    odd = [*urls, "file:///x/y", "file:///z", "file://", "http://net/fr/", "http://a./x", None]
    df = spark.createDataFrame(list(enumerate(odd)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(df, more).collect()}
    assert got == {i: judged(u, more) if "://" in (u or "") else ("", "", None, "allow") for i, u in enumerate(odd)}
    assert {t for t, _ in url_filter.index([url_filter.Rule(*r) for r in url_filter.RULES])} == {"com", "example", "www", "es", "fr"}


# --- 10: SimHash ---


def plain_fingerprint(t):
    import xxhash

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    v = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return v - (1 << 64) if v >> 63 else v


def grouped(points):
    """fingerprint -> smallest fingerprint reachable."""
    todo, out = set(points), {}
    while todo:
        root = min(todo)
        front = [root]
        todo.discard(root)
        while front:
            p = front.pop()
            out[p] = root
            near = {q for q in todo if ((p ^ q) & (1 << 64) - 1).bit_count() <= 4}
            todo -= near
            front += near
    return out


def test_near_dedup(spark, docs, corpus, empty):
    got = simhash.near_dedup(docs.withColumn("fp", F.lit("clash"))).collect()
    prints = {r[1]: plain_fingerprint(r[1]) for r in corpus}
    of = grouped(prints.values())
    least = {}
    for i, t, *_ in corpus:
        if i is not None:
            least[of[prints[t]]] = min(i, least.get(of[prints[t]], i))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in got) == Counter((r[0], prints[r[1]], least.get(of[prints[r[1]]])) for r in corpus)
    assert simhash.near_dedup(empty).count() == 0


@pytest.mark.parametrize(("bucket", "many"), [(1 << 16, 4_000_000), (3, 4_000_000), (1 << 16, 10), (40, 10)])
def test_links_find_all(spark, bucket, many, monkeypatch):
    """Clusters around centres, under short and long keys and with crowded keys."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "MANY", many)
    rnd = random.Random(9)
    points = set()
    for _ in range(12):
        c = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 3, 90]) if bucket > 3 else 6):
            points.add(c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    parts = {r.node: r.component for r in components.connected_components(simhash.links(df)).collect()}
    of = grouped(signed)
    assert {p: parts.get(p, p) for p in signed} == of


def test_wider_keys_lose_no_chain():
    """Every way to spread four differing bits that keeps a chain's budgets agrees with some
    key, at each width that splitting reaches."""
    rnd = random.Random(4)
    level = [(0, 1, 2, *r) for r in simhash.SHORT]
    chains = []
    while len(chains) < 400:
        bits = [0] * 16
        for _ in range(4):
            bits[rnd.randint(3, 15)] += 1
        if all(sum(bits[:n]) <= n // 4 for n in range(1, 17)):
            chains.append({j for j in range(16) if not bits[j]})
    while level:
        assert all(any(set(k) <= c for k in level) for c in chains)
        level = [w for k in level for w in simhash._wider(k)]
        level = sorted(set(level))
        assert all(len(k) <= 12 for k in level)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words():
    assert re.findall(WORD, "a\x0bb\u00a0c d") == ["a", "b\u00a0c", "d"] and json.dumps(simhash.SHORT)


# --- pipeline ---


def test_near_keeps_one_of_a_group(spark):
    import corpus_pipeline as p

    rnd = random.Random(9)
    base = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400))
    nobody, shared, mixed, plain, other = (base() for _ in range(5))
    rows = [(None, nobody), (None, nobody + " x"), (None, nobody + " y"), (7, shared), (7, shared + " x"), (7, shared), (None, mixed), (9, mixed + " x"), (3, plain), (2, plain + " x"), (7, other)]
    texts = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    of = grouped(plain_fingerprint(t) for _, t in rows)
    assert len({of[plain_fingerprint(t)] for _, t in rows}) == 5
    kept = p.near(spark, texts, "").collect()
    assert Counter(of[plain_fingerprint(r.text)] for r in kept) == Counter(set(of[plain_fingerprint(t)] for _, t in rows))
    assert sorted((r.doc_id or 0, r.text in (other,)) for r in kept) == [(0, False), (2, False), (7, False), (7, True), (9, False)]
    again = p.near(spark, texts.repartition(3), "").collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, kept))


def test_pipeline(spark, corpus, tmp_path):
    """Each stage against its brute force on what the one before it kept."""
    import corpus_pipeline as p

    rows = [r for r in corpus if r[0] is not None and r[0] < 80]
    rows += [(1000 + k, f"clean words {k} and zorga zorgb zorgc number {k * k}", "en", "s", 1) for k in range(40)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 1000)) for i, *_ in rows], "doc_id long, quality int, toxic int").distinct().write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in p.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), "stage")
        kept[name] = docs.collect()
    names = [n for n, _ in p.STAGES]
    first = Counter(tuple(r) for r in kept[names[0]])
    assert not [r for r in first if r[0] >= 1000] and len(kept[names[0]]) >= len(rows) - 42
    best = {}
    for r in first:
        best[r[1] or ""] = max(best.get(r[1] or "", -1), r[0])
    assert Counter(r.doc_id for r in kept[names[1]]) == Counter(best.values())
    of = grouped(plain_fingerprint(t) for t in best)
    least = {}
    for t, i in best.items():
        g = of[plain_fingerprint(t)]
        least[g] = min(i, least.get(g, i))
    assert Counter(r.doc_id for r in kept[names[2]]) == Counter(least.values())
    assert all(list(r.asDict()) == DOCS.replace(" long", "").replace(" string", "").split(", ") for n in names[:4] for r in kept[n][:1])
    assert {r.doc_id for r in kept[names[3]]} <= set(least.values()) and max(Counter(r.doc_id for r in kept[names[3]]).values()) <= 2
    assert len(kept[names[4]]) == len(kept[names[3]]) and all(r.round_trip for r in kept[names[4]])
