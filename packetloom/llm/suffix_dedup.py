"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first DEPTH bytes, most significant digit first; a
digit has DIGIT bytes. A pass splits the groups that the digits before left equal; suffixes
alone in their group leave; groups left equal after the last digit are exactly the repeated
strings. That compares bytes. Two kinds of results rest on hashes instead and don't pass the
radix sort, as said below: whole runs that are equal, and crowded groups.

Not every suffix need be sorted. Of the GRAMs inside a string of DEPTH bytes the one with the
smallest hash stands for it; equal strings have equal representatives at the same place, so
suffixes with different ones, or with one that occurs once, are thinned out before the sort.
Consecutive suffixes with one representative are a run; where whole runs are equal (by 128
bits of hash and the gram's 64), all their strings repeat, and one run of each kind is sorted.
Groups of more than CROWD kinds are dealt suffix by suffix, each digit in a shuffle of its own
with digits of half the depth, each by 128 bits of hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.common import PIECE, bitmap, bits_of, capped_bits, discard, has_bit, in_bits, materialize, ship, slices, tidy

DEPTH, GRAM, DIGIT = 200, 64, 8
SPREAD = DEPTH - GRAM  # last place of a gram in a string
#: Bytes hashed at once; longer texts go in pieces that overlap by DEPTH - 1.
BUFFER = 1 << 20
_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    done = 1
    while done < n:
        step = _U(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


_pow: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _pow:
        n = BUFFER + DEPTH + 1
        _pow["up"], _pow["down"] = _powers(_BASE, n), _powers(_INVERSE, n)
    return _pow["up"], _pow["down"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def pieces(texts: list[bytes]):
    """(buffer, [(text number, offset in the text, offset in the buffer, length)]): short texts
    together, long ones cut so that each string of DEPTH bytes is whole in one piece."""
    held, rows, size = [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(0, len(t) - DEPTH + 1), BUFFER - DEPTH):
            part = t[at : at + BUFFER - 1]
            if size + len(part) > BUFFER and held:
                yield b"".join(held), rows
                held, rows, size = [], [], 0
            rows.append((k, at, size, len(part)))
            held.append(part)
            size += len(part)
    if held:
        yield b"".join(held), rows


def runs(data: bytes, rows: list[tuple[int, int, int, int]]):
    """(start, end, place of the representative, its gram's hash, row, prefix sums): for each
    run of suffixes with one representative the first and last place in the buffer."""
    up, down = _tables()
    x = np.frombuffer(data, np.uint8)
    n = len(x)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[x] * up[:n], out=sums[1:])
    gram = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    least = (gram & _U(0xFFFFFFFFFF000000)) | np.arange(len(gram), dtype=_U)  # equal hashes: the first
    width = 1
    while 2 * width <= SPREAD + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = SPREAD + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    own = (least & _U(0xFFFFFF)).astype(np.int64)
    fits = np.zeros(len(own), np.int32)
    for k, (_, _, at, length) in enumerate(rows):
        fits[at : at + length - DEPTH + 1] = k + 1
    change = np.flatnonzero((own[1:] != own[:-1]) | (fits[1:] != fits[:-1])) + 1
    start = np.concatenate(([0], change))
    end = np.concatenate((change, [len(own)])) - 1
    good = fits[start] > 0
    start, end = start[good], end[good]
    return start, end, own[start], gram[own[start]], fits[start] - 1, sums


def run_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of each run's bytes, as two columns."""
    h = xxhash.xxh3_128_digest
    both = b"".join([h(data[s:e]) for s, e in zip(start.tolist(), (end + DEPTH).tolist(), strict=True)])
    return np.frombuffer(both, np.int64).reshape(-1, 2)


#: Groups with more kinds of runs are dealt by single suffixes; of the others a task holds one
#: at a time (336 bytes a run at most, and some 60 for each of its 69 suffixes or so).
CROWD = 16_384
#: Suffixes that a task sorts at once: whole groups of about so many.
SORTED = 1 << 18
_SPAN = T.StructType([T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType()), T.StructField("span", T.LongType())])


def _span(start, end):
    return F.shiftleft(start, 32).bitwiseOR(end)


def _scan(docs: DataFrame, schema: str, emit) -> DataFrame:
    """Run emit(buffer, start, end, anchor, gram, sums, places in texts, t1, t2) over docs
    (t1, t2, text) and collect the record batches it gives."""
    ship(docs.sparkSession)

    def run(batches):
        for b in slices(batches, "text"):
            texts = [(t or "").encode("utf-8", "replace") for t in b.column("text").to_pylist()]
            t1, t2 = b.column("t1").to_numpy(zero_copy_only=False), b.column("t2").to_numpy(zero_copy_only=False)
            for data, rows in pieces(texts):
                start, end, anchor, gram, k, sums = runs(data, rows)
                which = np.array([r[0] for r in rows])[k]
                shift = np.array([r[1] - r[2] for r in rows])[k]
                yield from emit(data, start, end, anchor, gram.view(np.int64), sums, shift, t1[which], t2[which])
        tidy()

    return docs.mapInArrow(run, schema)


def _table(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()], names=list(cols))


def _bits(rows: DataFrame, pos) -> tuple[DataFrame, int]:
    """A capped bitmap of a few bits a row, and the mask of its positions."""
    bits = capped_bits(rows.count(), 32)
    return bitmap(rows.select(pos.bitwiseAND(F.lit(bits - 1)).alias("pos")).distinct(), "pos"), bits - 1


def _runs(docs: DataFrame) -> DataFrame:
    """(g, c, d, t1, t2, span) of every run; each text is hashed once for this."""

    def emit(data, start, end, anchor, g, sums, shift, t1, t2):
        c = run_hashes(data, start, end)
        yield _table(g=g, c=c[:, 0], d=c[:, 1], t1=t1, t2=t2, span=(start + shift) << 32 | (end + shift))

    return materialize(_scan(docs, "g long, c long, d long, t1 long, t2 long, span long", emit), "runs")


#: Mixes a place into a text's hash; the product of a place and this stays under 2^63.
_STEP = 2654435761


def _chosen_runs(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(g, t1, t2, first, ahead, bytes) of the chosen runs (t1, t2, span): where they start,
    how far ahead their representative is, and their bytes. The filter is capped and may let
    others through: they are runs of the texts they name, so what they share does repeat. Of
    copies of a text a task gives each run once."""
    place = F.col("t1").bitwiseXOR(F.shiftright("span", 32) * F.lit(_STEP))
    pieces_, mask = _bits(chosen, place)
    elect = bits_of(pieces_, mask + 1)
    seen: set[tuple[int, int, int]] = set()  # each task has its own; its partition bounds it

    def emit(data, start, end, anchor, g, sums, shift, t1, t2):
        ok = np.flatnonzero(in_bits(elect.value, (t1 ^ (start + shift) * _STEP) & mask))
        new = []
        for k, key in zip(ok.tolist(), zip(t1[ok].tolist(), t2[ok].tolist(), (start + shift)[ok].tolist(), strict=True), strict=True):
            if key not in seen:
                seen.add(key)
                new.append(k)
        ok = np.array(new, int)
        for i in range(0, len(ok), 8192):
            k = ok[i : i + 8192]
            cut = [data[s : e + DEPTH] for s, e in zip(start[k].tolist(), end[k].tolist(), strict=True)]
            yield _table(g=g[k], t1=t1[k], t2=t2[k], first=(start + shift)[k], ahead=(anchor - start)[k].astype(np.int32), bytes=pa.array(cut, pa.binary()))

    return materialize(_scan(docs, "g long, t1 long, t2 long, first long, ahead int, bytes binary", emit), "strings")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(t1, t2, span) for docs (t1, t2, text), t1 and t2 being hashes of the text: places from
    which DEPTH bytes occur elsewhere too, as first << 32 | last."""
    every = _runs(docs)
    grams = materialize(every.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g"), "grams")
    some, mask = _bits(grams, F.col("g"))
    some = F.broadcast(materialize(some.toDF("piece", "bits"), "some"))  # at most 32 MiB
    at = every.withColumn("p", F.col("g").bitwiseAND(F.lit(mask)))
    units = at.join(some, F.expr(f"p div {PIECE}") == F.col("piece")).filter(has_bit(F.col("bits"), F.col("p"))).select(*every.columns)
    units = materialize(units, "units")
    discard(every)

    # whole runs that occur twice are repeated all through; one run stands for each kind
    kind = ["g", "c", "d"]
    classes = materialize(units.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"), *(F.first(x).alias(x) for x in ("t1", "t2", "span"))), "classes")
    whole = materialize(units.join(classes.filter("n > 1").select(*kind), kind).select("t1", "t2", "span"), "whole")
    discard(units)

    # groups of one kind are done; the others are sorted
    groups = materialize(classes.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "kinds")
    chosen = materialize(classes.join(groups, "g").select("g", "t1", "t2", "span"), "chosen")
    discard(classes)
    crowded = groups.filter(F.col("kinds") > CROWD).select("g")
    full = F.broadcast(crowded) if crowded.count() <= 100_000 else crowded
    one = _chosen_runs(docs, chosen)
    discard(chosen)
    near = materialize(_sorted_groups(one.join(full, "g", "left_anti")), "near")
    loose = materialize(_dealt(one.join(full, "g", "left_semi").dropDuplicates(["g", "t1", "t2", "first"])), "loose")
    discard(one)
    return whole.unionByName(near).unionByName(loose)


def radix(group: np.ndarray, at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which of the suffixes (starting at `at` in data, DEPTH bytes long, in groups) are equal
    to another of their group. Most significant digit first: each pass orders every group
    that the digit splits, and drops what is alone; groups that a digit leaves whole stay as
    they are."""
    word = np.ndarray((len(data) - DIGIT + 1,), ">u8", data, strides=(1,))
    live = np.argsort(group, kind="stable")
    group = group[live]
    for depth in range(0, DEPTH + DIGIT, DIGIT):
        if len(live):  # alone in the group: leave
            edge = np.concatenate(([True], group[1:] != group[:-1], [True]))
            stay = ~(edge[1:] & edge[:-1])
            live, group = live[stay], group[stay]
        if depth >= DEPTH or not len(live):
            return live
        digit = word[at[live] + depth].astype(np.uint64)
        begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.concatenate((begin, [len(live)])))
        split = np.repeat(np.minimum.reduceat(digit, begin) != np.maximum.reduceat(digit, begin), size)
        if split.any():
            where = np.flatnonzero(split)
            order = np.lexsort((digit[where], group[where]))
            live[where], digit[where] = live[where][order], digit[where][order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])))
        group = np.cumsum(new)
    return live


def _equal(t: pa.Table) -> pa.RecordBatch:
    """Spans of the strings that occur twice in the groups of t, sorted by group and run. A run
    that several tasks gave counts once."""
    key = [t.column(n).to_numpy() for n in ("g", "t1", "t2", "first")]
    t = t.filter(pa.array(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in key], axis=0))))).combine_chunks()
    g, t1, t2, first, ahead = (t.column(n).to_numpy() for n in ("g", "t1", "t2", "first", "ahead"))
    bytes_ = t.column("bytes").combine_chunks()
    ends = np.frombuffer(bytes_.buffers()[1], np.int32)[bytes_.offset : bytes_.offset + len(bytes_) + 1].astype(np.int64)
    data = np.frombuffer(bytes_.buffers()[2], np.uint8)
    size = np.diff(ends) - DEPTH + 1
    row = np.repeat(np.arange(len(g)), size)
    step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    which = np.cumsum(np.concatenate(([0], g[1:] != g[:-1])))
    # equal strings have their representative at the same place
    group = which[row] * (SPREAD + 1) + ahead[row] - step
    hit = np.zeros(len(row), bool)
    hit[radix(group, ends[row] + step, data)] = True
    same = hit[1:] & hit[:-1] & (row[1:] == row[:-1])  # neighbours make one span
    start = np.flatnonzero(hit & ~np.concatenate(([False], same)))
    stop = np.flatnonzero(hit & ~np.concatenate((same, [False])))
    r = row[start]
    return _table(t1=t1[r], t2=t2[r], span=(first[r] + step[start]) << 32 | (first[r] + step[stop]))


def _sorted_groups(rows: DataFrame) -> DataFrame:
    """Equal strings within each group of at most CROWD kinds; tasks stream sorted groups."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.column("bytes").nbytes - b.num_rows * (DEPTH - 1)
            if n < SORTED:
                continue
            t = pa.Table.from_batches(held)
            cut = int(np.searchsorted(t.column("g").to_numpy(), t.column("g")[-1].as_py()))  # the last group may go on
            if cut:
                yield _equal(t.slice(0, cut).combine_chunks())
            rest = t.slice(cut).combine_chunks()
            held, n = rest.to_batches(), (n if not cut else rest.column("bytes").nbytes - rest.num_rows * (DEPTH - 1))
        if held:
            yield _equal(pa.Table.from_batches(held).combine_chunks())
        tidy()

    return rows.repartition("g").sortWithinPartitions("g", "t1", "t2", "first").mapInArrow(run, _SPAN)


def _dealt(rows: DataFrame) -> DataFrame:
    """The same for crowded groups: a row for each suffix, grouped by one digit of half the
    depth and, where that is shared, by the next. Aggregation combines before the shuffle and
    what is shared is joined back, so a string with very many copies holds no task up."""
    half = DEPTH // 2

    def suffixes(batches):
        h = xxhash.xxh3_128_digest
        for b in slices(batches, "bytes", 1 << 18):
            at, parts = [], []
            for i, data in enumerate(b.column("bytes").to_pylist()):
                n = len(data) - DEPTH + 1
                at.append(np.column_stack((np.full(n, i), np.arange(n))))
                digits = np.frombuffer(b"".join([h(data[k : k + half]) for k in range(n + half)]), np.int64).reshape(-1, 2)
                parts.append(np.column_stack((digits[:n], digits[half : n + half])))
            at, parts = np.concatenate(at), np.concatenate(parts)
            row = pa.array(at[:, 0])
            place = b.column("ahead").take(row).to_numpy() - at[:, 1]
            yield _table(**{n: b.column(n).take(row) for n in ("g", "t1", "t2", "first")}, k=at[:, 1].astype(np.int32), o=place.astype(np.int32), a1=parts[:, 0], a2=parts[:, 1], b1=parts[:, 2], b2=parts[:, 3])

    each = materialize(rows.mapInArrow(suffixes, "g long, t1 long, t2 long, first long, k int, o int, a1 long, a2 long, b1 long, b2 long"), "suffixes")
    digit = ["g", "o", "a1", "a2"]
    for more in ([], ["b1", "b2"]):
        digit = digit + more
        shared = materialize(each.groupBy(*digit).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "shared")
        left = materialize(each.join(shared, digit, "left_semi"), "left")
        discard(each)
        each = left
    starts = each.groupBy("t1", "t2", "first").agg(F.collect_set("k").alias("ks"))  # at most SPREAD + 1 places of one run
    begin = F.array_sort(F.filter("ks", lambda k: ~F.array_contains("ks", k - 1)))
    end = F.array_sort(F.filter("ks", lambda k: ~F.array_contains("ks", k + 1)))
    spans = starts.select("t1", "t2", "first", F.explode(F.arrays_zip(begin.alias("a"), end.alias("z"))).alias("s"))
    return spans.select("t1", "t2", _span(F.col("first") + F.col("s.a"), F.col("first") + F.col("s.z")).alias("span"))


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The carried columns (default: all), n_bytes, n_removed, n_spans and kept (binary).

    Texts count as UTF-8 bytes, null as empty. Each byte that a string of DEPTH bytes covers
    which also starts anywhere else, in the same text or another, is removed; what is repeated
    is judged on the input; strings never cross texts. n_spans counts maximal removed runs.
    Texts shorter than DEPTH are kept whole, however many; of longer ones all equal texts go (no
    copy is spared). A text of any length is read in pieces of BUFFER bytes; its own bytes and
    its spans are held whole once, by the task that cuts it. Names that begin with two
    underscores are kept for the operator.
    Input columns named like result columns are replaced; an empty table gives an empty
    result. A text's spans depend on nothing but the text and the table, so texts are keyed
    by 128 bits of hash, and repeated rows or null ids do no harm."""
    made = ("n_bytes", "n_removed", "n_spans", "kept")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"__t1": F.xxhash64(text), "__t2": F.xxhash64(F.lit("second"), text), "__text": text})
    found = repeated_spans(keyed.select(F.col("__t1").alias("t1"), F.col("__t2").alias("t2"), F.col("__text").alias("text")))
    spans = materialize(found.groupBy(F.col("t1").alias("__s1"), F.col("t2").alias("__s2")).agg(F.collect_set("span").alias("__spans")), "spans")
    # texts without a span pass by the join: a capped filter of the others' hashes decides
    bits = capped_bits(spans.count(), 32)
    seen = F.broadcast(materialize(bitmap(spans.select(F.col("__s1").bitwiseAND(F.lit(bits - 1)).alias("pos")).distinct(), "pos").toDF("__piece", "__bits"), "seen"))
    rows = keyed.withColumn("__p", F.col("__t1").bitwiseAND(F.lit(bits - 1)))
    rows = rows.join(seen, F.expr("__p div 32768") == F.col("__piece"), "left").withColumn("__maybe", has_bit(F.col("__bits"), F.col("__p")))
    clean = rows.filter(~F.col("__maybe"))
    touched = rows.filter("__maybe").select(*carry, "__text", "__t1", "__t2").join(spans, (F.col("__t1") == F.col("__s1")) & (F.col("__t2") == F.col("__s2")), "left")
    binary = F.col("__text").cast("binary")
    size = F.octet_length("__text").cast("long")
    none = F.lit(0).cast("long")
    out = clean.select(*carry, size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), binary.alias("kept"))
    return out.unionByName(_cut(touched.select(*carry, "__text", "__spans"), carry))


def _cut(touched: DataFrame, carry: list[str]) -> DataFrame:
    ship(touched.sparkSession)
    schema = T.StructType([*(touched.schema[c] for c in carry), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])

    def run(batches):
        for b in slices(batches, "__text"):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, spans in zip(b.column("__text").to_pylist(), b.column("__spans"), strict=True):
                data = text.encode("utf-8", "replace")
                runs_, parts, at = 0, [], 0
                if spans.is_valid and len(spans.values):
                    s = np.sort(spans.values.to_numpy())
                    first, stop = s >> 32, np.maximum.accumulate((s & 0xFFFFFFFF) + DEPTH)
                    new = np.concatenate(([True], first[1:] > stop[:-1]))
                    ends = stop[np.concatenate((new[1:], [True]))]
                    for a, z in zip(first[new].tolist(), ends.tolist(), strict=True):
                        parts.append(data[at:a])
                        at = z
                        runs_ += 1
                parts.append(data[at:])
                kept.append(b"".join(parts))
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(kept[-1]))
                n_spans.append(runs_)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=schema.names)

    return touched.mapInArrow(run, schema)


def op1(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, carry=["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
