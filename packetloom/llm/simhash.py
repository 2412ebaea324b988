"""SimHash near-dedup with pigeonring filtering.

A 64-bit fingerprint is a ring of 16 segments of 4 bits. If two differ in at most 4 bits, some
chain of consecutive segments has, for every length l, at most l/4 differing bits in its first
l segments: none in 3, one in 7, two in 11, three in 15. Keys are made of the parts that such a
chain must leave equal; pairs that meet under a key are pruned by the chain's budgets and only
then compared in full."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.common import LOWER, UPPER, materialize, ship, slices, tidy
from packetloom.llm.components import connected_components

SEED, WIDTH, DIFFER = 42, 4, 4
SEGMENTS, BITS = 16, 4
#: Sets of segments of a chain that a key takes besides the first three: with one differing bit
#: in segments 3-6, 3-4 or 5-6 are equal; with two in 3-10, one of the five pairs of parts is.
SHORT = ((3, 4), (5, 6))
LONG = tuple((*a, *b) for a, b in combinations(((3, 4), (5, 6), (7, 8), (9, 10)), 2) if (a, b) != ((7, 8), (9, 10)))
#: Above so many distinct fingerprints the long keys (28 bits) replace the short ones (20).
MANY = 4_000_000
#: Fingerprints under one key that are compared in one task; keys with more are split by
#: further segments of their chain. Keys of twelve segments can't have more: 16 bits are left.
BUCKET = 1 << 16
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None) -> int:
    """As a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "replace").translate(LOWERED).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= WIDTH:
        starts, ends = starts[: len(words) - WIDTH + 1], ends[WIDTH - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    n, counts, digest = len(starts), np.zeros(64, np.int64), xxhash.xxh64_digest
    for i in range(0, n, 1 << 16):
        part = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[i : i + (1 << 16)].tolist(), ends[i : i + (1 << 16)].tolist(), strict=True)])
        counts += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """The carried columns and fp (long); a narrow map. Null and wordless texts have
    fingerprint 0."""
    ship(docs.sparkSession)
    schema = T.StructType([*(docs.schema[c] for c in carry), T.StructField("fp", T.LongType())])

    def run(batches):
        for b in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array([fingerprint(t) for t in b.column(text_col).to_pylist()], pa.int64())], names=schema.names)
        tidy()

    return docs.select(*carry, *([text_col] if text_col not in carry else [])).mapInArrow(run, schema)


def _mask(start: int, segments: tuple[int, ...]) -> int:
    """The bits of a chain's segments, as a signed 64-bit integer."""
    m = sum(15 << 4 * ((start + j) % SEGMENTS) for j in segments)
    return m - (1 << 64) if m >> 63 else m


def _code(start: int, segments: tuple[int, ...]) -> int:
    return start << SEGMENTS | sum(1 << j for j in segments)


def _keys(fps: DataFrame, long: bool) -> DataFrame:
    """(code, part, fp): for each start of the ring and each choice of segments (the code),
    the fingerprint's bits there."""
    keys = [(start, (0, 1, 2, *rest)) for start in range(SEGMENTS) for rest in (LONG if long else SHORT)]
    pairs = F.array(*(F.struct(F.lit(_code(*k)).cast("long").alias("code"), F.col("fp").bitwiseAND(F.lit(_mask(*k)).cast("long")).alias("part")) for k in keys))
    return fps.select(F.explode(pairs).alias("k"), "fp").select("k.code", "k.part", "fp")


def _wider(segments: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The keys with one segment more that together find all that a key finds: the first l
    segments of a chain differ in l // 4 bits at most, so of one more than that of them that
    the key leaves open, one is equal. Empty where the budgets give no more."""
    for upto in range(4, SEGMENTS + 1):
        open_ = [j for j in range(upto) if j not in segments]
        if len(open_) > upto * DIFFER // SEGMENTS:
            return [tuple(sorted((*segments, j))) for j in open_]
    return []


def _split(keys: DataFrame) -> DataFrame:
    """Rows of crowded keys under the wider keys of each."""
    codes = [r["code"] for r in keys.select("code").distinct().collect()]  # at most 16 starts by the sets of segments
    book = []
    for code in codes:
        start, segments = code >> SEGMENTS, tuple(j for j in range(SEGMENTS) if code >> j & 1)
        book += [(code, _code(start, w), _mask(start, w)) for w in _wider(segments)]
    table = F.broadcast(keys.sparkSession.createDataFrame(book, "code long, wider long, mask long"))
    out = keys.join(table, "code").select(F.col("wider").alias("code"), F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp")
    return out.distinct()  # several keys may widen to one


def _turned(f: np.ndarray, start: int) -> np.ndarray:
    """The ring from a chain's start on."""
    n = np.uint64(4 * start)
    return f if not start else (f >> n) | (f << (np.uint64(64) - n))


def _budgeted(x: np.ndarray) -> np.ndarray:
    """Where a turned xor keeps to the budgets of its chain and differs in at most DIFFER
    bits. Each budget is checked only on what the one before it left."""
    alive = np.arange(len(x))
    for upto in (3, 7, 11, 15, 16):  # segments of the chain; its budget is upto // 4 bits
        mask = np.uint64((1 << (4 * upto)) - 1)
        alive = alive[np.bitwise_count(x[alive] & mask) <= upto * DIFFER // SEGMENTS]
    return alive


def _spread(f: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links (fingerprint, first of its group) within one key, by search from node to node."""
    left, turned, out = f, _turned(f, start), []
    while len(left):
        root, front, left, turned = left[0], [turned[0]], left[1:], turned[1:]
        while front and len(left):
            near = _budgeted(turned ^ front.pop())
            if len(near):
                out += [(int(v), int(root)) for v in left[near]]
                front += list(turned[near])
                left, turned = np.delete(left, near), np.delete(turned, near)
    return out


def _linked(keys: DataFrame) -> DataFrame:
    """Links within each key. Each task streams its sorted keys; what one key links is passed
    on as a forest and never as all pairs."""
    ship(keys.sparkSession)

    def links(code: np.ndarray, part: np.ndarray, f: np.ndarray):
        edge = np.flatnonzero((code[1:] != code[:-1]) | (part[1:] != part[:-1])) + 1
        begin, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(code)]))
        size = end - begin
        starts = code >> SEGMENTS
        a, b = [], []
        for s, e in zip(begin[size > 64].tolist(), end[size > 64].tolist(), strict=True):
            got = np.array(_spread(f[s:e], int(starts[s])), np.uint64).reshape(-1, 2)
            a.append(got[:, 0])
            b.append(got[:, 1])
        small = np.repeat((size > 1) & (size <= 64), size)
        at = np.flatnonzero(small)
        stop = np.repeat(end, size)[at]
        turned = f.copy()
        for start in range(1, SEGMENTS):
            here = starts == start
            turned[here] = _turned(f[here], start)
        for d in range(1, 64):
            keep = at + d < stop
            at, stop = at[keep], stop[keep]
            if not len(at):
                break
            good = _budgeted(turned[at] ^ turned[at + d])
            a.append(f[at][good])
            b.append(f[at + d][good])
        return (np.concatenate(a), np.concatenate(b)) if a else (f[:0], f[:0])

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in batches:
            code, part, f = (np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False).view(h.dtype))) for i, h in enumerate(held))
            if not len(code):
                continue
            last = np.flatnonzero((code != code[-1]) | (part != part[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last key may go on
            held = [code[cut:], part[cut:], f[cut:]]
            if cut:
                a, b = links(code[:cut], part[:cut], f[:cut])
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
        if len(held[0]):
            a, b = links(*held)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return keys.repartition("code", "part").sortWithinPartitions("code", "part").mapInArrow(run, "a long, b long")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) such that exactly those that chains of
    at most DIFFER bits connect are connected. Keys with more than BUCKET fingerprints are
    split by wider keys, level by level; only rows of crowded keys go on to the next."""
    keys, out = _keys(fps, fps.count() > MANY), None
    while True:
        sizes = keys.groupBy("code", "part").count().filter((F.col("count") > BUCKET) & (F.bit_count(F.col("code").bitwiseAND(F.lit(0xFFFF))) < SEGMENTS - DIFFER))
        crowded = materialize(sizes.select("code", "part"), "crowded")
        n = crowded.count()
        full = F.broadcast(crowded) if n <= 100_000 else crowded
        found = _linked(keys.join(full, ["code", "part"], "left_anti") if n else keys)
        out = found if out is None else out.unionByName(found)
        if not n:
            return out
        keys = materialize(_split(keys.join(full, ["code", "part"], "left_semi")), "wider")


def near_dedup(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The carried columns (default: the id), fp and component_id, one row for each row of
    docs: component_id is the smallest id that links of at most 4 differing bits reach.

    Equal fingerprints are one node, so exact copies add no links. Null and wordless texts
    have fingerprint 0 and are linked like any other. Null ids are never a component's id
    unless it has no other. Columns that aren't carried aren't read; carried ones named like
    result columns are replaced. An empty table gives an empty result."""
    return near_components(docs, carry, id_col, text_col).drop("component")


def near_components(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_dedup with component, a fingerprint that names the component whatever its ids. Nulls
    and empty texts have fingerprint zero and are linked like any other; repeated and null ids
    are rows of their own; an empty table gives an empty result. A text of any length is one
    row, whose shingles a task holds in turn."""
    carry = [c for c in (carry or [id_col]) if c not in ("fp", "component_id", "component")]
    rows = materialize(fingerprints(docs, carry, text_col), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    parts = materialize(connected_components(links(nodes.select("fp"))), "parts")
    named = parts.join(nodes, parts["node"] == nodes["fp"]).select("fp", "component", "least")
    first = materialize(named.groupBy("component").agg(F.min("least").alias("id")), "first")
    moved = materialize(parts.join(first, "component").select(F.col("node").alias("fp"), "component", "id"), "moved")
    whole = materialize(nodes.join(moved, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("id", "least").alias("component_id")), "whole")
    return rows.join(whole, "fp").select(*carry, "fp", "component_id", "component")


def op10(spark, sf_dir):
    out = near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
