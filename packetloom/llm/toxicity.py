"""Toxicity by non-negative positive-unlabelled learning: a linear classifier in numpy is
trained from confirmed toxic examples and unlabelled texts with a class-prior-corrected risk."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.common import discard, materialize, ship, slices, tidy

#: Bounds of the training sample (documents) and sizes of the model. The sample has the
#: smallest hashes of doc_id; statistics over labels cover all labelled rows.
POSITIVES, UNLABELLED = 3000, 9000
SLOTS, FEATURES, LEAST = 1 << 20, 4096, 20.0
PREFIXES = (3, 4, 5, 6)
#: Where a prior taken from labels is held: below a half, a text without evidence isn't toxic.
PRIOR = (1e-3, 0.45)
#: Words whose slots a scoring task remembers; a full memo is emptied.
WORDS = 60_000
#: A text of this many words counts its evidence about 0.7 times.
USUAL = 200
LETTERS = re.compile(r"[^\W\d_]+")


def _slot(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "replace")) & (SLOTS - 1)


def slots_of(word: str) -> list[int]:
    """Hash slots of a lower-cased word: the word, then its prefixes."""
    return [_slot("=" + word), *(_slot("^" + word[:n]) for n in PREFIXES if len(word) >= n)]


def again(slot: int) -> int:
    """The slot that says that two different words of a text share the prefix in `slot`."""
    return (slot * 40503 + 12829) & (SLOTS - 1)


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def scale(words):
    """The factor of the evidence of a text with so many words. Slots that a text sets by
    chance grow with its words; unscaled, their sum passes any fixed threshold."""
    return 1 / np.sqrt(1 + np.asarray(words) / USUAL)


class Parts(dict):
    """word -> (its own slot, its prefixes' slots); with `weight` only those that a model
    weighs, itself or by their shared form. A full memo is emptied."""

    def __init__(self, weight: dict[int, float] | None = None):
        self.weight = weight

    def __missing__(self, word: str):
        if len(self) >= WORDS:
            self.clear()
        own, *prefixes = slots_of(word)
        if self.weight is None:
            out = ((own,), prefixes)
        else:
            out = ((own,) if own in self.weight else (), tuple(x for x in prefixes if x in self.weight or again(x) in self.weight))
        self[word] = out
        return out


def features(words: list[str], parts: Parts) -> set[int]:
    """The slots that the words of a whole text set: of each word, of its prefixes, and of
    prefixes that two different words share. Training and scoring both call this; scoring
    leaves out what the model doesn't weigh."""
    hits: set[int] = set()
    once: set[int] = set()
    twice: set[int] = set()
    for w in set(words):
        word, prefixes = parts[w]
        if word:
            hits.update(word)
        for s in prefixes:
            (twice if s in once else once).add(s)
    return hits | once | {again(s) for s in twice}


@dataclass
class Model:
    slots: np.ndarray  # selected hash slots, sorted
    weights: np.ndarray
    bias: float
    prior: float


def select(counts: DataFrame, n: int, m: int) -> np.ndarray:
    """Of counts (slot, p, u: positives and unlabelled texts that set it; n and m in all) the
    FEATURES slots that stand out most among positives by the log-likelihood ratio of their
    share; LEAST keeps what chance brings among so many slots out of the model."""
    both = (F.col("p") + F.col("u")) / (n + m)

    def part(x: Column, k: int) -> Column:
        there = F.when(x > 0, x * F.log(x / (both * k))).otherwise(0.0)
        return there + F.when(x < k, (k - x) * F.log((k - x) / ((1 - both) * k))).otherwise(0.0)

    g = F.round(2 * (part(F.col("p"), n) + part(F.col("u"), m)), 6)
    good = counts.withColumn("g", g).filter((F.col("g") > LEAST) & (F.col("p") >= 3) & (F.col("p") / n > F.col("u") / m))
    return np.sort(np.array([r["slot"] for r in good.orderBy(F.col("g").desc(), "slot").limit(FEATURES).collect()], np.int64))


def _sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and columns of the selected slots that each text sets."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return at, (np.concatenate(rows).astype(int) if rows else np.zeros(0, int))


def risk(w: np.ndarray, pos: tuple, unl: tuple, ps: np.ndarray, us: np.ndarray, prior: float, beta: float = 0.0) -> tuple[float, float, np.ndarray]:
    """(positive risk, corrected negative risk, gradient) at weights w (the bias last) for the
    rows and columns of set slots and the scales of the texts. The risk to go down along the
    gradient is their sum; while the corrected negative risk is below -beta it is that risk
    with its sign reversed, so the model doesn't fit unlabelled positives as negatives."""
    (pr, pc), (ur, uc) = pos, unl
    k = len(w) - 1
    fp = np.bincount(pr, w[pc], len(ps)) * ps + w[k]
    fu = np.bincount(ur, w[uc], len(us)) * us + w[k]
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    sp, su = sig(fp), sig(fu)
    plus = prior * np.logaddexp(0, -fp).mean()
    corrected = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    up, down, free = -(1 - sp) * prior / len(ps), sp * prior / len(ps), su / len(us)
    a, b = (up - down, free) if corrected >= -beta else (down, -free)
    g = np.empty(k + 1)
    g[:k] = np.bincount(pc, (a * ps)[pr], k) + np.bincount(uc, (b * us)[ur], k)
    g[k] = a.sum() + b.sum()
    return plus, corrected, g


def fit(slots: np.ndarray, pos: list[np.ndarray], unl: list[np.ndarray], pos_words: list[int], unl_words: list[int], prior: float, steps: int = 400, rate: float = 0.05, l2: float = 2e-4, beta: float = 0.0) -> Model:
    """Minimise prior * Rp(+) + max(0, Ru(-) - prior * Rp(-)) with logistic loss (Adam, full
    batch; see risk()). pos and unl hold, for each text, the places in `slots` that it sets.
    Without positives: prior as score. The sum of weights is scaled by the number of words,
    here as in score(). A prior outside (0, 1) is a ValueError."""
    if not 0 < prior < 1:
        raise ValueError(f"a class prior lies between 0 and 1, not at {prior}")
    if not pos or not unl:
        return Model(np.zeros(0, int), np.zeros(0), float(np.log(prior / (1 - prior))), prior)
    p, u = _sparse(pos), _sparse(unl)
    ps, us = scale(pos_words), scale(unl_words)
    k = len(slots)
    w, mean, var = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    w[k] = -2.0
    for t in range(1, steps + 1):
        g = risk(w, p, u, ps, us, prior, beta)[2]
        g[:k] += l2 * w[:k]
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        w -= rate * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-9)
    return Model(slots, w[:k], float(w[k]), prior)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _features(docs: DataFrame) -> DataFrame:
    """(positive, words, slots): the packed slots of each text, written once."""
    ship(docs.sparkSession)

    def run(batches):
        parts = Parts()
        for b in slices(batches, "text"):
            found = [words_of(t) for t in b.column("text").to_pylist()]
            packed = pa.array([np.sort(np.fromiter(features(x, parts), np.int32)).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("positive"), pa.array([len(x) for x in found], pa.int32()), packed], names=["positive", "words", "slots"])
        tidy()

    return materialize(docs.select("positive", "text").mapInArrow(run, "positive boolean, words int, slots binary"), "features")


def _counts(rows: DataFrame) -> DataFrame:
    """(slot, p, u) over the packed slots; each task sends a slot once."""

    def run(batches):
        seen = np.zeros((2, SLOTS), np.int32)
        for b in slices(batches, "slots"):
            for positive, packed in zip(b.column("positive").to_pylist(), b.column("slots"), strict=True):
                seen[0 if positive else 1, np.frombuffer(packed.as_buffer(), np.int32)] += 1  # a text has each slot once
        slot = np.flatnonzero(seen.any(axis=0))
        for i in range(0, len(slot), 1 << 16):
            part = slot[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(seen[0, part], pa.int64()), pa.array(seen[1, part], pa.int64())], names=["slot", "p", "u"])

    return rows.mapInArrow(run, "slot int, p long, u long").groupBy("slot").agg(F.sum("p").cast("double").alias("p"), F.sum("u").cast("double").alias("u"))


def _chosen(rows: DataFrame, slots: np.ndarray) -> DataFrame:
    """(positive, words, at): the places in `slots` that each text sets, two bytes each."""

    def run(batches):
        for b in slices(batches, "slots"):
            at = [np.flatnonzero(np.isin(slots, np.frombuffer(x.as_buffer(), np.int32))).astype(np.uint16).tobytes() for x in b.column("slots")]
            yield pa.RecordBatch.from_arrays([b.column("positive"), b.column("words"), pa.array(at, pa.binary())], names=["positive", "words", "at"])

    return rows.mapInArrow(run, "positive boolean, words int, at binary")


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic).

    Labels of held-out rows, null labels and label 0 are never looked at as examples. The
    class prior is the caller's, whatever it is (from 0.5 on, texts without evidence may count as
    toxic); without one, the share of 1 among all labelled rows that aren't held out, within
    PRIOR. The sample has the POSITIVES and UNLABELLED documents with the smallest hashes of
    doc_id; what reaches the driver of it is at most FEATURES places of two bytes each, below
    100 MB in any case. A repeated label counts once as an example; a document with
    contradictory labels is a positive. Of rows that share a sampled doc_id one is the example,
    that with the smallest hash of its text, so their number doesn't matter. Null ids are never
    examples. Without positives, or without documents, every score is the prior."""
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    if prior is None:
        share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
        prior = min(max(share, PRIOR[0]), PRIOR[1])
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    pos = known.filter("toxic = 1").join(ids, "doc_id", "left_semi").select("doc_id").distinct().orderBy(*order).limit(POSITIVES).withColumn("positive", F.lit(True))
    unl = ids.distinct().orderBy(*order).limit(UNLABELLED).withColumn("positive", F.lit(False))
    chosen = F.broadcast(pos.unionByName(unl))  # at most POSITIVES + UNLABELLED ids
    ids = F.broadcast(pos.unionByName(unl).select("doc_id").distinct())
    # rows of one id meet as one row a task
    one = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text")))["text"]
    texts = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id").agg(one.alias("text"))
    rows = _features(texts.join(chosen, "doc_id"))
    sizes = {r["positive"]: r["n"] for r in rows.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        discard(rows)
        return fit(np.zeros(0, int), [], [], [], [], prior)
    slots = select(_counts(rows), sizes[True], sizes[False])
    examples: dict[bool, list[np.ndarray]] = {True: [], False: []}
    words: dict[bool, list[int]] = {True: [], False: []}
    for r in _chosen(rows, slots).collect():  # bounded by the sample and FEATURES
        examples[r["positive"]].append(np.frombuffer(bytes(r["at"]), np.uint16))
        words[r["positive"]].append(r["words"])
    discard(rows)
    return fit(slots, examples[True], examples[False], words[True], words[False], prior)


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The carried columns with score and predicted; a narrow map. A null text is empty: it
    has no features and gets the bias alone. Columns of those names are replaced. A text of any
    length is scored whole, a row at a time if it is long; an empty table gives an empty result."""
    ship(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name not in ("score", "predicted") and (carry is None or f.name in carry)]
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    names = [f.name for f in keep]
    weight = dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True))

    def run(batches):
        parts = Parts(weight)
        for b in slices(batches, "text"):
            out, size = np.empty(b.num_rows), np.empty(b.num_rows)
            for i, t in enumerate(b.column("text").to_pylist()):
                found = words_of(t)
                size[i] = len(found)
                out[i] = sum(weight.get(x, 0.0) for x in sorted(features(found, parts)))
            out = model.bias + out * scale(size)
            p = 1 / (1 + np.exp(-np.clip(out, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(p), pa.array((p >= 0.5).astype("int32"))], names=schema.names)
        tidy()

    source = docs.select(*names, *([] if "text" in names else ["text"]))
    return source.mapInArrow(run, schema)


def op8(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, carry=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
