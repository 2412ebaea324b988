"""Ranked lexical search by variable-block-max WAND.

Documents are tokenised once, for the terms of the items. A task cuts its documents into shards;
in a shard a posting list is cut into blocks by dynamic programming, so that the blocks' maxima
exceed the real impacts by as little as possible in sum. A search adds up the maxima of the
blocks that lie over a stretch of documents: a stretch whose bound is below the k-th score so
far is skipped unread, and the others are scored exactly. The k best of the items so far go
along from shard to shard, so later shards skip more."""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import discard, materialize, ship, slices, tidy

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
SQL_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of the items' terms that one pass over the documents looks for (they are broadcast);
#: more items take more passes.
ITEM_BYTES = 8 << 20
#: Postings and documents of a shard at most; a single longer document is a shard of its own.
POSTINGS, DOCS = 1 << 20, 1 << 17
#: The longest block, and what a block costs, as a share of its list's largest impact.
LONGEST, BLOCK_COST = 64, 2.0
#: Posting lists that are cut side by side.
TOGETHER = 4096
#: Stretches are scored best first, so many postings at a time.
STEP = 4096
#: Bytes of text whose terms are held as objects at once.
PIECE = 1 << 20
SATURATION, B = 1000, 75


def terms_of(text: bytes):
    """The terms of a text, a piece at a time, so that a text of any length is counted in
    memory bounded by its distinct terms."""
    text = text.lower()  # of bytes: A-Z only
    start = 0
    while start < len(text):
        stop = min(len(text), start + PIECE)
        if stop < len(text):
            m = TERM.match(text, stop)
            stop = m.end() if m else stop
        yield TERM.findall(text, start, stop)
        start = stop


def cuts(scores: list[np.ndarray], longest: int = LONGEST, cost: float = BLOCK_COST) -> list[np.ndarray]:
    """For each posting list (impacts in document order, none empty) the ends of its blocks:
    those that minimise the sum over blocks of (length * maximum - impacts) + cost * the
    list's largest impact."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    for k in range(0, len(order), TOGETHER):
        some = order[k : k + TOGETHER]
        for i, end in zip(some, _cut([scores[i] for i in some], longest, cost), strict=True):
            out[i] = end
    return out


def _cut(scores: list[np.ndarray], longest: int, cost: float) -> list[np.ndarray]:
    """The programme for lists of falling length, side by side, a posting a step: `now` is the
    least cost of the first j postings; `best` and `top` have the cost before each block that
    could end at j and its maximum, by the block's start modulo `longest`."""
    sizes = np.array([len(s) for s in scores])
    ends = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.concatenate(scores).astype(float)
    price = cost * np.maximum.reduceat(flat, ends[:-1])
    back = np.zeros(len(flat), np.int32)
    top, best = np.zeros((len(scores), longest)), np.full((len(scores), longest), np.inf)
    now = np.zeros(len(scores))
    slot = np.arange(longest)
    active = len(scores)
    for j in range(int(sizes[0])):
        while sizes[active - 1] <= j:
            active -= 1
        at = j % longest
        best[:active, at], top[:active, at] = now[:active], 0.0
        np.maximum(top[:active], flat[ends[:active] + j, None], out=top[:active])
        length = (at - slot) % longest + 1
        total = best[:active] + top[:active] * length
        pick = total.argmin(axis=1)
        now[:active] = total[np.arange(active), pick] + price[:active]
        back[ends[:active] + j] = length[pick]
    out = []
    for k in range(len(scores)):
        path, j, mine = [], int(sizes[k]), back[ends[k] : ends[k + 1]]
        while j > 0:
            path.append(j)
            j -= int(mine[j - 1])
        out.append(np.array(path[::-1], np.int64))
    return out


class Shard:
    """The posting lists of some documents, cut into blocks."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        """docs (numbers from 0, rising within a term), terms and impacts of all postings."""
        order = np.lexsort((docs, terms))
        self.docs, self.impacts, t = docs[order], impacts[order], terms[order]
        ids, first = np.unique(t, return_index=True)
        last = np.append(first[1:], len(t))[: len(ids)]
        self.spans = {int(k): (int(a), int(b)) for k, a, b in zip(ids, first, last, strict=True)}
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for (k, (a, b)), end in zip(self.spans.items(), cuts([self.impacts[a:b] for a, b in self.spans.values()]), strict=True):
            begin = np.append(0, end[:-1])
            self.blocks[k] = (self.docs[a:b][begin], self.docs[a:b][end - 1] + 1, np.maximum.reduceat(self.impacts[a:b], begin))

    def search(self, query: list[tuple[int, int]], k: int, ids: np.ndarray, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best of (score, doc_id) among `best` and the documents here; ties to smaller
        ids. query: terms and what an impact of theirs counts."""
        query = [(t, w) for t, w in query if t in self.spans and w > 0]
        if not query:
            return best
        # the pivot test of all stretches at once: between two borders of blocks the bound is
        # one number, the sum of what the blocks over it can add at most
        borders = np.concatenate([x for t, _ in query for x in self.blocks[t][:2]])
        change = np.concatenate([x for t, w in query for x in (self.blocks[t][2] * w, -self.blocks[t][2] * w)])
        at, where = np.unique(borders, return_inverse=True)
        bound = np.zeros(len(at), np.int64)
        np.add.at(bound, where, change)
        bound = np.cumsum(bound)[:-1]
        order = np.argsort(-bound, kind="stable")
        lists = [(self.docs[a:b], self.impacts[a:b], w) for (a, b), w in ((self.spans[t], w) for t, w in query)]
        room, done = max(1, STEP * len(at) // max(1, sum(len(x[0]) for x in lists))), 0
        while done < len(order):
            least = best[-1][0] if len(best) == k else 1
            some = order[done : done + room]
            some = np.sort(some[bound[some] >= least])
            if not len(some):
                break
            done += room
            room *= 2
            found, worth = [], []
            # stretches side by side are one range of each list
            gap = np.flatnonzero(np.diff(some) > 1)
            lo, hi = at[some[np.append(0, gap + 1)]], at[some[np.append(gap, len(some) - 1)] + 1]
            for docs, impacts, w in lists:
                a, b = np.searchsorted(docs, lo), np.searchsorted(docs, hi)
                n = b - a
                take = np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                found.append(docs[take])
                worth.append(impacts[take] * w)
            who, spot = np.unique(np.concatenate(found), return_inverse=True)
            score = np.zeros(len(who), np.int64)
            np.add.at(score, spot, np.concatenate(worth))
            good = np.flatnonzero(score >= least)
            if len(good):
                if len(good) > 4 * k:  # ties of the k-th stay
                    good = good[score[good] >= np.partition(score[good], -k)[-k]]
                best = sorted([*best, *zip(score[good].tolist(), ids[who[good]].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
        return best


def _read(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts): all terms of each text that has one, and how often it has
    those of the vocabulary; written once."""
    spark = docs.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(vocabulary)  # ITEM_BYTES at most

    def run(batches):
        words = known.value
        for b in slices(batches, "text"):
            n, held = np.zeros(b.num_rows, np.int64), []
            for i, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                seen: Counter = Counter()
                for part in terms_of(t or b""):
                    n[i] += len(part)
                    seen.update(part)
                held.append([(words[x], seen[x]) for x in seen.keys() & words.keys()])
            ends = pa.array(np.append(0, np.cumsum([len(x) for x in held])).astype(np.int32))
            flat = np.array([x for h in held for x in h], np.int64).reshape(-1, 2)
            lists = [pa.ListArray.from_arrays(ends, pa.array(flat[:, 0].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(flat[:, 1]))]
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "counts"])
            yield out.filter(pa.array(n > 0))
        tidy()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(source.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>"), "terms")


def _lengths(n: np.ndarray, total: int, words: int) -> np.ndarray:
    """m of the documents' lengths n."""
    if len(n) and int(n.max()) * total * B < 1 << 62:
        return 100 - B + B * n * total // words
    return np.array([100 - B + B * x * total // words for x in n.tolist()], np.int64)


def _searched(rows: DataFrame, queries: list[tuple[int, list[tuple[int, int]]]], k: int, total: int, words: int) -> DataFrame:
    """The k best (item, doc_id, score) of each task's documents."""
    asked = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        best: dict[int, list] = {item: [] for item, _ in asked.value}
        held, size, docs = [], 0, 0

        def searched():
            ids = np.concatenate([h[0] for h in held])
            per = np.concatenate([h[1] for h in held])
            terms, tf = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
            who = np.repeat(np.arange(len(ids)), per)
            m = _lengths(np.concatenate([h[4] for h in held]), total, words)[who]
            shard = Shard(who, terms, 10**9 * tf // (SATURATION * tf + 8 * m))
            for item, query in asked.value:
                best[item] = shard.search(query, k, ids, best[item])

        for whole in batches:
            start = 0
            while start < whole.num_rows:
                ends = whole.column("terms").offsets.to_numpy()
                stop = max(start + 1, min(int(np.searchsorted(ends, ends[start] + POSTINGS - size, "right")) - 1, start + DOCS - docs))
                b = whole.slice(start, min(stop, whole.num_rows) - start)
                per = np.diff(b.column("terms").offsets.to_numpy())
                held.append((b.column("doc_id").to_numpy(zero_copy_only=False), per, b.column("terms").flatten().to_numpy(), b.column("counts").flatten().to_numpy(), b.column("n").to_numpy()))
                size, docs, start = size + int(per.sum()), docs + b.num_rows, start + b.num_rows
                if size >= POSTINGS or docs >= DOCS or start < whole.num_rows:
                    searched()
                    held, size, docs = [], 0, 0
        if held:
            searched()
        found = [(item, d, s) for item, rows in best.items() for s, d in rows]
        for i in range(0, len(found), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[i : i + (1 << 16)], strict=True)], names=["item", "doc_id", "score"])
        tidy()

    return rows.filter(F.col("doc_id").isNotNull()).mapInArrow(run, "item long, doc_id long, score long")


def _passes(items: DataFrame, id_col: str, text_col: str):
    """The items (id, terms with their counts) in groups whose different terms have ITEM_BYTES at
    most; an item with more is a group of its own. Rows that share an id are one item."""
    held: list[tuple[int, Counter]] = []
    words: set[bytes] = set()
    size = 0
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("i is not null").orderBy("i").toLocalIterator()
    for i, some in groupby(rows, key=lambda r: r["i"]):
        terms = Counter(x for r in some for part in terms_of((r["t"] or "").encode()) for x in part)
        new = terms.keys() - words
        if held and size + sum(map(len, new)) > ITEM_BYTES:
            yield held
            held, words, size, new = [], set(), 0, terms.keys()
        held.append((i, terms))
        words |= new
        size += sum(map(len, new))
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, scores above 0 only,
    ties to smaller doc_ids; exact.

    A term is a maximal run of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.
    Null and empty texts have none, and a document without a term isn't counted. N, lengths and
    frequencies cover all rows; rows with a null id count there but aren't ranked, items with
    one are left out. Rows that share a doc_id are documents of their own; items that share an
    item_id are one item with the terms of all. Other columns aren't read. Empty tables give an
    empty result. Items may be any number: each ITEM_BYTES of them take a pass over docs."""
    spark = docs.sparkSession
    out = None
    for counted in _passes(items, item_id, text):
        vocabulary = {x: n for n, x in enumerate(sorted(set().union(*(c for _, c in counted))))}
        rows = _read(docs, vocabulary, doc_id, text)
        total, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not total:
            discard(rows)
            continue
        frequency = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
        weight = frequency.select("t", F.floor(1000 * F.log(F.lit(2.0 * total + 2) / (2 * F.col("df") + 1))).alias("w"))
        weights = dict(weight.collect())  # a row a term of the group
        queries = [(i, [(vocabulary[x], n * weights[vocabulary[x]]) for x, n in sorted(c.items()) if weights.get(vocabulary[x], 0) > 0]) for i, c in counted]
        found = materialize(_searched(rows, queries, k, total, words), "found")
        discard(rows)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    # the k best of an item are cut in each task before they meet
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def op13(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs.select("doc_id", "text"), items.select("item_id", "text"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SQL_TERM}') AS w FROM documents),
p AS (SELECT r, doc_id, len(w)::BIGINT AS n, w FROM d WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM p),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SQL_TERM}')) AS term FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT item_id, term, count(*)::BIGINT AS times FROM b GROUP BY ALL),
e AS (SELECT r, unnest(w) AS term FROM p),
f AS (SELECT r, term, count(*)::BIGINT AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
g AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, docs),
s AS (SELECT q.item_id, p.r, p.doc_id, CAST(sum(q.times * g.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (25 + (75 * p.n * c.docs) // c.words)))) AS BIGINT) AS score
      FROM q JOIN g USING (term) JOIN f USING (term) JOIN p USING (r), c GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
