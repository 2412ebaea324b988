"""Language-model scores, the filter audit and lexical search against brute force."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import filter_audit, lexical, pitman_yor

DOCS = "doc_id long, text string, held string, kept int"


def plain_tokens(text):
    return [*pitman_yor.WORD.findall((text or "").encode().lower()), pitman_yor.END]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    word = lambda: rnd.choice(["the", "The", "of", "a", "zür", "Ünder", "x" * 40] + [f"w{rnd.randrange(60)}"] * 6)
    out = [None, "", " \t\n", "the", "unseen-word the", "the " * 3000]
    out += [" ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(90)]
    return out + [out[20]] * 25


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


@pytest.mark.parametrize(("block", "bytes_", "split"), [(1 << 21, 12 << 20, 1 << 21), (150, 2000, 100)])
def test_scores(spark, texts, monkeypatch, block, bytes_, split):
    """The columns that the counts decide, and a model that beats them; small blocks, buckets and
    parts of contexts give the same counts."""
    monkeypatch.setattr(pitman_yor, "BLOCK", block)
    monkeypatch.setattr(pitman_yor, "BUCKET_BYTES", bytes_)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the end"), (3, "the again")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], DOCS).repartition(4)
    got = pitman_yor.scores(docs, ~pitman_yor.training(F.col("doc_id")), split=split).collect()
    count = Counter(w for i, t in rows if not held(i) for w in plain_tokens(t))
    total, words = sum(count.values()), len(count)

    def want(i, t):
        x = plain_tokens(t)
        return (-1 if i is None else i, held(i), len(x), sum(w in count for w in x), total, round(sum(math.log10((count[w] + 1) / (total + words + 1)) for w in x), 6))

    found = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert found == sorted(want(i, t) for i, t in rows)
    assert all(r.score < 0 for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)
    assert any(held(i) for i, _ in rows)


def test_scores_are_a_distribution(spark):
    """What follows a context, of all known words, the end and one unknown, sums to 1. With f(w) one
    over the probability of the end after w, sums over "w x" give f = 1 + R f for R(w, x) =
    P(w x) / P(w); the f that solves this must make all beginnings sum to 1. Reruns agree."""
    rnd = random.Random(9)
    words = [f"v{k}" for k in range(12)]
    train = [" ".join(rnd.choice(words[: rnd.randint(2, 12)]) for _ in range(30)) for _ in range(40)]
    words.append("nobody")
    texts = ["", *words, *(f"{w} {x}" for w in words for x in words)]
    docs = spark.createDataFrame([(i, t, i >= 40) for i, t in enumerate([*train, *texts])], "doc_id long, text string, out boolean")
    run = lambda: {r.doc_id: r.score for r in pitman_yor.scores(docs, F.col("out")).collect()}
    got = run()
    assert run() == pytest.approx(got, abs=1e-9)
    p = {t: 10 ** got[40 + k] for k, t in enumerate(texts)}
    r = np.array([[p[f"{w} {x}"] / p[w] for x in words] for w in words])
    f = np.linalg.solve(np.eye(len(words)) - r, np.ones(len(words)))
    assert (f > 1).all() and sum(p[w] * x for w, x in zip(words, f, strict=True)) + p[""] == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("d", [0.5, 0.8])
def test_tables_follow_the_conditional(d):
    """Draws of the number of tables against all seatings of few customers, written out."""
    seating, rng = pitman_yor.Seating(d), np.random.default_rng(1)
    others, p, c, n = 3.0, 0.2, 4, 40_000
    weight = Counter()

    def seat(sizes, left, w):
        if not left:
            weight[len(sizes)] += w
            return
        for k, size in enumerate(sizes):
            seat([*sizes[:k], size + 1, *sizes[k + 1 :]], left - 1, w * (size - d))
        seat([*sizes, 1], left - 1, w * (others + d * len(sizes)) * p)

    seat([], c, 1.0)
    drawn = Counter(seating.tables(np.full(n, c), np.full(n, others), np.full(n, p), rng).tolist())
    for t in range(1, c + 1):
        assert drawn[t] / n == pytest.approx(weight[t] / sum(weight.values()), abs=0.01)
    large = seating.tables(np.array([0, 1, 5_000_000]), np.full(3, 3.0), np.full(3, 0.5), rng)
    assert large[0] == 0 and large[1] == 1 and 1 < large[2] < 5_000_000


def test_packed_arrays():
    for x in (np.array([], np.int64), np.array([5, 2**62, -1]), np.arange(300, dtype=np.uint8), np.array([2**63, 2**64 - 1], np.uint64)):
        assert (pitman_yor.unpack(pitman_yor.pack(x), x.dtype) == x).all()
    up = np.sort(np.array([1, 2**63 + 5, 2**64 - 1], np.uint64))
    assert (pitman_yor._sums(pitman_yor._steps(up), np.uint64) == up).all()


def test_no_training_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = pitman_yor.scores(docs, F.lit(True)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert pitman_yor.scores(docs.limit(0), F.lit(False)).count() == 0


def test_audit_of_own_filters(spark):
    """Any filters over any facts: each edge counted, each order's steps in line with it."""
    rnd = random.Random(6)
    facts = [(rnd.choice(["p", "p", "p", "q", ""]), *(rnd.random() < s for s in (0.5, 0.3, 0.6)), rnd.random() < 0.5, rnd.random() < 0.2) for _ in range(300)]
    df = spark.createDataFrame(facts, "part string, X boolean, Y boolean, Z boolean, good boolean, toxic boolean")
    got = {(r.part, r.filter_order, r.step): tuple(r[k] for k in filter_audit.COUNTS) for r in filter_audit.audit(df, "XYZ").collect()}
    at = {"X": 1, "Y": 2, "Z": 3}
    want, removed = {}, Counter()
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        for order in map("".join, itertools.permutations("XYZ")):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [f for f in left if f[at[x]]]
                left = [f for f in left if not f[at[x]]]
                fails = sum(f[at[x]] for f in mine)
                removed[part, x] += len(gone)
                want[part, order, step] = (len(left), len(gone), fails - len(gone), sum(f[at[x]] and sum(f[1:4]) == 1 for f in mine), sum(f[4] for f in gone), sum(f[5] for f in gone), x)
    assert got == {k: (*v[:6], removed[k[0], v[6]]) for k, v in want.items()}


def test_facts_of_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(5, "s", "same"), (2, "s", "same"), (None, "s", "same"), (2, None, "same"), (9, "", None), (10, "", "")], "doc_id long, source string, text string")
    labels = spark.createDataFrame([(2, 0, 1), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = sorted((r.part, r.E, r.good, r.toxic) for r in filter_audit.facts(docs, labels).collect())
    assert got == sorted([("s", True, False, False), ("s", False, True, True), ("s", False, False, False), ("", False, True, True), ("", False, False, False), ("", True, False, False)])


def test_block_borders_are_optimal():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 7, 11):
        s = rnd.integers(1, 100, n)
        price = 2.0 * s.max()

        def cost(ends, s=s, price=price):
            return sum((e - b) * s[b:e].max() + price for b, e in itertools.pairwise([0, *ends]))

        best = min(cost([*c, len(s)]) for k in range(len(s)) for c in itertools.combinations(range(1, len(s)), k))
        (found,) = lexical.cuts([s])
        assert cost(found.tolist()) == pytest.approx(best)
    many = [rnd.integers(1, 50, k) for k in (30, 3, 200, 1, 30)]
    for s, ends in zip(many, lexical.cuts(many, longest=8), strict=True):
        assert ends[-1] == len(s) and np.diff(np.append(0, ends)).max() <= 8
        assert (ends == lexical.cuts([s], longest=8)[0]).all()


def test_search_of_a_shard_is_exact(monkeypatch):
    monkeypatch.setattr(lexical, "STEP", 8)
    rnd = np.random.default_rng(3)
    docs, terms = np.nonzero(rnd.random((400, 12)) < rnd.random(12))
    impacts = rnd.integers(1, 6, len(docs))
    ids = rnd.permutation(1000)[:400]
    shard = lexical.Shard(docs, terms, impacts)
    for _ in range(25):
        query = [(int(t), int(rnd.integers(0, 4))) for t in rnd.permutation(14)[:5]]
        score = Counter()
        for d, t, x in zip(docs.tolist(), terms.tolist(), impacts.tolist(), strict=True):
            score[int(ids[d])] += x * dict(query).get(t, 0)
        want = sorted(((s, i) for i, s in score.items() if s > 0), key=lambda x: (-x[0], x[1]))[:10]
        assert shard.search(query, 10, ids, []) == want
        assert shard.search(query, 10, ids, [(10**6, 5)])[0] == (10**6, 5)


def test_terms_of_long_texts(monkeypatch):
    text = ("Abc dé,f" * 50 + "x" * 300).encode()
    whole = lexical.TERM.findall(text.lower())
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(lexical, "PIECE", piece)
        assert [x for part in lexical.terms_of(text) for x in part] == whole


def test_search_in_passes(spark, monkeypatch):
    """More items than one pass takes; null ids and empty sides."""
    docs = spark.createDataFrame([(1, "red apple"), (2, "red pear"), (2, "Red, red"), (None, "red"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "apple"), (2, "pear red"), (3, None), (None, "red")], "item_id long, text string")
    whole = sorted(map(tuple, lexical.search(docs, items).collect()))
    monkeypatch.setattr(lexical, "ITEM_BYTES", 5)
    assert sorted(map(tuple, lexical.search(docs, items).collect())) == whole
    assert [(i, r, d) for i, r, d, _ in whole if i == 1] == [(1, 1, 1)] and [d for i, _, d, _ in whole if i == 2][0] == 2
    assert lexical.search(docs.limit(0), items).count() == lexical.search(docs, items.limit(0)).count() == 0
