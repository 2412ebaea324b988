"""Language-model scoring by a hierarchical Pitman-Yor model over words.

A restaurant for each context (the word before, or the end of a text at its start) seats the
words that follow it; all contexts share one parent restaurant, whose customers are their
tables, and the parent's base is even over all known words and one for the unknown. Seating is
sampled by Gibbs; the averaged predictive probabilities score the texts.

Documents are kept in blocks of tokens. Words and pairs of words are counted at home buckets:
a block sends each bucket one packed row with its different words or pairs, and gets a row back
with the counts in the same order. So a shuffle moves few rows, holds each different pair once a
block, and nothing of the vocabulary goes through the driver or a broadcast. The pairs of a
context that is frequent are dealt to several buckets."""

from __future__ import annotations

import re
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import discard, materialize, ship, slices, tidy

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: A token that no word can be.
END = b" "
#: Tokens of a block, bytes of text for each bucket, and words whose hash a task remembers.
BLOCK, BUCKET_BYTES, WORDS = 1 << 21, 12 << 20, 1 << 18
#: A context's pairs fill one more bucket for each so many tokens.
SPLIT = 1 << 21
#: Discount and strength of the contexts, and of their parent.
CONTEXT, PARENT = (0.8, 2.0), (0.6, 2.0)
#: Sweeps over a restaurant's entries, and how many of the last ones are averaged.
SWEEPS, KEPT = 5, 3
#: Entries of up to so many customers have their tables drawn from the exact conditional;
#: of larger ones the other customers are seated in turn, in steps of a share of those there.
EXACT, SHARE = 256, 32
RANK = 40

ROW = "kind int, dest long, src long, a binary, b binary, c binary, d binary, e binary, ids array<long>, held array<boolean>, sizes array<long>, x double, y double"
_ARROW = pa.schema(
    [("kind", pa.int32()), ("dest", pa.int64()), ("src", pa.int64()), *((k, pa.binary()) for k in "abcde")]
    + [("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("x", pa.float64()), ("y", pa.float64())]
)
TOKENS, ASKED, COUNTED, TOTAL, PAIRS, SEATED, CUSTOMERS, TABLES, PARENTS = range(9)


def pack(x: np.ndarray) -> bytes:
    """An array, its bytes by place, deflated: small numbers of a wide type cost little."""
    x = np.ascontiguousarray(x)
    return zlib.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def unpack(b: bytes, kind=np.int64) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _steps(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def _sums(b: bytes, kind=np.int64) -> np.ndarray:
    return np.cumsum(unpack(b, kind), dtype=kind)


def _sent(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _exchange(parts: list[DataFrame], run) -> DataFrame:
    """All rows of a destination together, by kind and source; run(dest, rows) yields rows."""
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)

    def each(batches):
        stream = (r for b in batches for r in b.to_pylist())
        for dest, group in groupby(stream, key=lambda r: r["dest"]):
            held, size = [], 0
            for r in run(dest, group):
                held.append(r)
                size += sum(len(r.get(k) or b"") for k in "abcde")
                if size > 2 << 20:
                    yield _sent(held)
                    held, size = [], 0
            if held:
                yield _sent(held)
        tidy()

    return rows.repartition("dest").sortWithinPartitions("dest", "kind", "src").mapInArrow(each, ROW)


def training(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2


class _Hashes(dict):
    """word -> 64 bits of hash; a full memo is emptied."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def _blocks(docs: DataFrame, bits: int) -> DataFrame:
    """A TOKENS row for each block (documents, their lengths, tokens as places among the block's
    words by hash) and ASKED rows with its words and their training counts, by bucket."""

    def run(batches):
        hashes = _Hashes()
        end = np.uint64(hashes[END])
        task, serial = TaskContext.get().partitionId(), 0
        ids, held, texts, size = [], [], [], 0

        def block():
            nonlocal serial
            sizes = np.array([len(t) for t in texts])
            words, at, n = _places(np.concatenate(texts), np.repeat(np.array(held), sizes))
            me = task << 32 | serial
            serial += 1
            yield dict(kind=TOKENS, dest=me, a=pack(at.astype(np.int32)), ids=ids, held=held, sizes=sizes.tolist(), x=float(np.searchsorted(words, end)))
            bucket = words >> np.uint64(64 - bits) if bits else np.zeros(len(words), np.uint64)
            cut = np.append(0, np.flatnonzero(np.diff(bucket)) + 1)
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(words)], strict=True):
                yield dict(kind=ASKED, dest=int(bucket[s]), src=me, a=_steps(words[s:e]), b=pack(n[s:e]))

        for b in slices(batches, "text"):
            for i, h, t in zip(b.column("doc_id").to_pylist(), b.column("held").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                found = WORD.findall((t or b"").lower())  # of bytes: A-Z only
                x = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
                if texts and size + len(x) >= BLOCK:
                    for r in block():
                        yield _sent([r])
                    ids, held, texts, size = [], [], [], 0
                ids.append(i)
                held.append(h)
                texts.append(np.append(x, end))
                size += len(x) + 1
        if texts:
            yield _sent(list(block()))
        tidy()

    return materialize(docs.mapInArrow(run, ROW), "blocks")


def _places(tokens: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words, each token's place among them, and their counts in training."""
    words, at = np.unique(tokens, return_inverse=True)
    return words, at, np.bincount(at, ~held, len(words)).astype(np.int64)


def _words(bucket: int, rows):
    """Counts and numbers of a bucket's words, in the order in which each block asked. A number
    is the bucket and the word's rank among its training words (unknown: -1), so numbers rise
    with hashes. The TOTAL row has the tokens and the different words."""
    asked = [(r["src"], _sums(r["a"], np.uint64), unpack(r["b"])) for r in rows]
    words, at = np.unique(np.concatenate([h for _, h, _ in asked]), return_inverse=True)
    count = np.bincount(at, np.concatenate([n for _, _, n in asked])).astype(np.int64)
    number = np.where(count > 0, np.cumsum(count > 0) - 1 + (bucket << RANK), -1)
    start = 0
    for block, h, _ in asked:
        mine = at[start : start + len(h)]
        start += len(h)
        yield dict(kind=COUNTED, dest=block, src=bucket, a=pack(count[mine]), b=pack(number[mine]))
    yield dict(kind=TOTAL, dest=-1, src=bucket, x=float(count.sum()), y=float((count > 0).sum()))


class _Block:
    """A block whose words have their counts: its pairs, in the order of the buckets they go to."""

    def __init__(self, tokens: dict, count: np.ndarray, number: np.ndarray, buckets: int, split: int):
        at = unpack(tokens["a"], np.int32)
        self.sizes = np.array(tokens["sizes"])
        self.word = at
        before = np.append(0, at[:-1])
        before[np.append(0, np.cumsum(self.sizes)[:-1])] = int(tokens["x"])  # a text starts after an end
        pair, self.pair = np.unique(before.astype(np.int64) << 32 | at, return_inverse=True)
        self.u, self.w = pair >> 32, pair & 0xFFFFFFFF
        held = np.repeat(np.array(tokens["held"]), self.sizes)
        n = np.bincount(self.pair, ~held, len(pair)).astype(np.int32)
        ask = np.flatnonzero((count[self.u] > 0) & (count[self.w] > 0))
        splits = 1 + count[self.u[ask]] // split
        part = number[self.w[ask]] % splits
        mixed = (number[self.u[ask]].astype(np.uint64) + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        bucket = ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket.astype(np.int32), kind="stable")
        self.asked, self.bucket, self.splits, self.n = ask[order], bucket[order], splits[order], n[ask[order]]

    def messages(self, me: int, count: np.ndarray, number: np.ndarray):
        """A PAIRS row for each bucket: contexts, how many pairs each has and over how many
        buckets they are dealt, second words, training counts and levels of the words' counts."""
        cut = np.append(0, np.flatnonzero(np.diff(self.bucket)) + 1)
        level = np.round(6 * np.log2(count[self.w[self.asked]])).astype(np.uint8)
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(self.bucket)], strict=True) if len(self.bucket) else ():
            u, w = number[self.u[self.asked[s:e]]], number[self.w[self.asked[s:e]]]
            first = np.append(0, np.flatnonzero(np.diff(u)) + 1)
            runs = np.stack((np.diff(np.append(first, e - s)), self.splits[s:e][first])).astype(np.int32).ravel()
            yield dict(kind=PAIRS, dest=int(self.bucket[s]), src=me, a=_steps(u[first]), b=pack(runs), c=pack(w), d=pack(self.n[s:e]), e=pack(level[s:e]))


def _gathered(rows, kinds: tuple[int, ...]) -> tuple[dict, list[list[np.ndarray]], list[dict]]:
    """A block's tokens, its words' columns from all buckets side by side, and the other rows."""
    tokens, columns, rest = None, [], []
    for r in rows:
        if r["kind"] == TOKENS:
            tokens = r
        elif r["kind"] in kinds:
            columns.append([unpack(r[k]) for k in "abcde" if r[k] is not None])
        else:
            rest.append(r)
    return tokens, [np.concatenate(c) for c in zip(*columns, strict=True)], rest


def _stirling(d: float) -> np.ndarray:
    """log S[c, t]: the weight of all ways to seat c customers at t tables with discount d."""
    out = np.full((EXACT + 1, EXACT + 2), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, EXACT + 2)
    for c in range(EXACT):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c, 1:] + np.log(np.maximum(c - d * t, 1e-300))
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.where(np.isfinite(out[c, 1:]), stay, -np.inf))
    return out


class Seating:
    """Tables of entries (a word in a restaurant) given the tables of all others."""

    def __init__(self, d: float):
        self.d, self.ways = d, _stirling(d)

    def tables(self, c: np.ndarray, others: np.ndarray, p: np.ndarray, rng) -> np.ndarray:
        """A draw for each entry with c customers: others is the strength and the discounted
        tables of its restaurant's other entries, p the parent's probability of the word. Up to
        EXACT customers the number of tables is drawn from its exact conditional, all seatings
        summed: S[c, t] * p^t * product of (others + j * d) for j < t."""
        t = np.minimum(c, 1).astype(np.int64)
        some = np.flatnonzero(c > 1)
        some = some[np.argsort(np.minimum(c[some], EXACT), kind="stable")]
        size = np.minimum(c[some], EXACT)
        cut = np.append(0, np.flatnonzero(np.diff(size)) + 1)
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(some)], strict=True) if len(some) else ():
            n = int(size[s])
            for i in range(s, e, max(1, (1 << 19) // n)):
                at = some[i : min(e, i + max(1, (1 << 19) // n))]
                opens = np.log(others[at, None] + self.d * np.arange(n)) + np.log(p[at, None])
                weight = self.ways[n, 1 : n + 1] + np.cumsum(opens, axis=1)
                weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
                t[at] = 1 + (weight < rng.random(len(at))[:, None] * weight[:, -1:]).sum(axis=1)
        there = np.minimum(c, EXACT)
        left = np.flatnonzero(c > EXACT)
        while len(left):
            step = np.minimum(c[left] - there[left], np.maximum(1, there[left] // SHARE))
            new = (others[left] + self.d * t[left]) * p[left]
            t[left] += rng.binomial(step, new / (new + there[left] - self.d * t[left]))
            there[left] += step
            left = left[there[left] < c[left]]
        return t


def _contexts(total: float, seed: int):
    """The restaurants of a bucket's contexts: pair counts, then Gibbs sweeps over the entries,
    from the state in which every customer has a table, so the parent is proportional to the
    words' counts. Rows back to the blocks (SEATED: counts, and tables summed over the KEPT last
    sweeps) and on to the words (CUSTOMERS of the parent, TABLES in a word's own restaurant)."""
    d, strength = CONTEXT
    seating = Seating(d)

    def run(bucket, rows):
        got, us, ws, ns, levels, splits = [], [], [], [], [], []
        for r in rows:
            u, (runs, split) = _sums(r["a"]), unpack(r["b"], np.int32).reshape(2, -1)
            got.append((r["src"], int(runs.sum())))
            us.append(np.repeat(u, runs))
            splits.append(np.repeat(split, runs))
            ws.append(unpack(r["c"]))
            ns.append(unpack(r["d"], np.int32))
            levels.append(unpack(r["e"], np.uint8))
        u, ui = np.unique(np.concatenate(us), return_inverse=True)
        w, wi = np.unique(np.concatenate(ws), return_inverse=True)
        pair, at = np.unique(ui << 32 | wi, return_inverse=True)
        pu, pw = pair >> 32, pair & 0xFFFFFFFF
        c = np.bincount(at, np.concatenate(ns), len(pair)).astype(np.int64)
        p, share = np.empty(len(w)), np.ones(len(u))
        p[wi] = np.exp2(np.concatenate(levels) / 6) / total
        share[ui] = np.concatenate(splits)  # the bucket has one part in so many of a context
        rng = np.random.default_rng([seed, bucket])
        t, kept, mine = c.copy(), np.zeros(len(pair), np.int64), np.flatnonzero(c > 0)
        for sweep in range(SWEEPS):
            there = np.bincount(pu, t, len(u)) * share
            t[mine] = seating.tables(c[mine], strength + d * (there[pu[mine]] - t[mine]), p[pw[mine]], rng)
            if sweep >= SWEEPS - KEPT:
                kept += t
        start = 0
        for block, n in got:
            back = at[start : start + n]
            start += n
            yield dict(kind=SEATED, dest=block, src=bucket, a=pack(c[back]), b=pack(kept[back]))
        for kind, who, x in ((CUSTOMERS, w, np.bincount(pw, t, len(w))), (TABLES, u, np.bincount(pu, kept, len(u)))):
            who, x = who[x > 0], x[x > 0].astype(np.int64)
            home = who >> RANK
            cut = np.append(0, np.flatnonzero(np.diff(home)) + 1)
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(who)], strict=True) if len(who) else ():
                yield dict(kind=kind, dest=int(home[s]), src=bucket, a=_steps(who[s:e]), b=pack(x[s:e]))

    return run


def _parents(words: float, seed: int):
    """The parent restaurant's part at a word bucket: its customers are the tables of all
    contexts. Rows back to the blocks (PARENTS: counts, numbers, customers, tables summed over
    the KEPT sweeps, tables of the word's own restaurant) and the TOTALs."""
    d, strength = PARENT
    seating = Seating(d)

    def run(bucket, rows):
        asked, size, sent = [], 0, []
        for r in rows:
            if r["kind"] == COUNTED:
                asked.append((r["dest0"], unpack(r["a"]), unpack(r["b"])))
                size = max(size, int((asked[-1][2] & (1 << RANK) - 1)[asked[-1][2] >= 0].max(initial=-1)) + 1)
            else:
                sent.append((r["kind"], _sums(r["a"]) & (1 << RANK) - 1, unpack(r["b"])))
        got = {k: np.zeros(size, np.int64) for k in (CUSTOMERS, TABLES)}
        for kind, at, x in sent:
            got[kind][at] += x  # each number once a row
        c = got[CUSTOMERS]
        rng = np.random.default_rng([seed, 1, bucket])
        t, kept = np.minimum(c, 1), np.zeros(size, np.int64)
        for sweep in range(SWEEPS):
            extra = t.sum() - (c > 0).sum()  # other buckets' words have one table and as many more
            t = seating.tables(c, np.full(size, strength + d * max(0.0, (words - 1) * (1 + extra / max(1, size)))), np.full(size, 1 / (words + 1)), rng)
            if sweep >= SWEEPS - KEPT:
                kept += t
        for block, count, number in asked:
            known, at = number >= 0, number & (1 << RANK) - 1
            pick = lambda x: pack(np.where(known, x[np.where(known, at, 0)] if size else 0, 0))  # noqa: B023, E731
            yield dict(kind=PARENTS, dest=block, src=bucket, a=pack(count), b=pack(number), c=pick(c), d=pick(kept), e=pick(got[TABLES]))
        yield dict(kind=TOTAL, dest=-1, src=bucket, x=float(c.sum()), y=float(kept.sum()))

    return run


def _scores(total: float, words: float, customers: float, tables: float, buckets: int, split: int):
    """The result's rows of a block: log10 probabilities summed over each document's tokens."""
    (d, strength), (d0, strength0) = CONTEXT, PARENT

    def run(dest, rows):
        tokens, (count, number, cust, kept, own), rest = _gathered(rows, (PARENTS,))
        b = _Block(tokens, count, number, buckets, split)
        up = (cust - d0 * kept / KEPT + (strength0 + d0 * tables / KEPT) / (words + 1)) / (strength0 + customers)
        c, t = np.zeros(len(b.u)), np.zeros(len(b.u))
        if len(b.asked):
            c[b.asked] = np.concatenate([unpack(r["a"]) for r in rest])
            t[b.asked] = np.concatenate([unpack(r["b"]) for r in rest]) / KEPT
        parent, cu = up[b.w], count[b.u]
        p = np.where(cu > 0, (c - d * t + (strength + d * own[b.u] / KEPT) * parent) / (strength + cu), parent)
        doc = np.repeat(np.arange(len(b.sizes)), b.sizes)
        n = len(b.sizes)
        known = np.bincount(doc, count[b.word] > 0, n).astype(np.int64)
        base = np.bincount(doc, np.log10((count + 1) / (total + words + 1))[b.word], n)
        score = np.bincount(doc, np.log10(p)[b.pair], n)
        cols = [tokens["ids"], tokens["held"], b.sizes, known, [int(total)] * n, base, score]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, _KINDS, strict=True)], names=_NAMES)

    return run


_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
_KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, held_out: Column, seed: int = 7, split: int = SPLIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (words alone, one added to each count) and score (the model's).

    Scores are log10 probabilities of the words and one end, in an event space of all training
    words and one unknown. Null and empty texts are one end. A null or repeated id is a row like
    others; other columns aren't read. Without training rows every token is unknown: its
    probability is 1. An empty table gives an empty result. Words are told apart by 64 bits of
    hash. A text of any length is scored whole, in a block of its own if it has more than BLOCK
    tokens. Reruns agree.

    One round of blocked Gibbs: contexts are swept given the parent, then the parent given the
    contexts' tables; predictions average the last sweeps. Parts of a split context hold the
    others' tables for as many as their own."""
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(0, (size // BUCKET_BYTES).bit_length())
    buckets = 1 << bits
    blocks = _blocks(source, bits)
    tokens, asked = blocks.filter(f"kind = {TOKENS}"), blocks.filter(f"kind = {ASKED}")
    counted = materialize(_exchange([asked], _words), "words")
    total, words = counted.filter(f"kind = {TOTAL}").agg(F.coalesce(F.sum("x"), F.lit(0.0)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    replies = counted.filter(f"kind = {COUNTED}")

    def pairs(me, rows):
        row, (count, number), _ = _gathered(rows, (COUNTED,))
        yield from _Block(row, count, number, buckets, split).messages(me, count, number)

    seated = materialize(_exchange([_exchange([tokens, replies], pairs)], _contexts(total, seed)), "seated")
    to_words = seated.filter(F.col("kind").isin(CUSTOMERS, TABLES))
    # the blocks' words go home once more, by number
    home = replies.withColumns({"dest": F.col("src"), "src": F.col("dest")})
    parent = _parents(words, seed)
    parents = materialize(_exchange([home, to_words], lambda bucket, rows: parent(bucket, ({**r, "dest0": r["src"]} for r in rows))), "parents")
    customers, tables = parents.filter(f"kind = {TOTAL}").agg(F.coalesce(F.sum("x"), F.lit(0.0)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    last = _scores(total, words, customers, tables, buckets, split)
    rows = tokens.unionByName(parents.filter(f"kind = {PARENTS}")).unionByName(seated.filter(f"kind = {SEATED}"))

    def run(batches):
        stream = (r for b in batches for r in b.to_pylist())
        for dest, group in groupby(stream, key=lambda r: r["dest"]):
            yield from last(dest, group)
        tidy()

    out = materialize(rows.repartition("dest").sortWithinPartitions("dest", "kind", "src").mapInArrow(run, _RESULT), "scores")
    for spent in (blocks, counted, seated, parents):
        discard(spent)
    return out


def op11(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scores(docs, ~training(F.col("doc_id")))
