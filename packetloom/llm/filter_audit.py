"""Filter interaction audit by permutation-trie execution: filters are applied depth first to
persisted survivors, an unordered prefix is executed once whatever orders lead to it, and what
each edge of the trie really removes is counted.

With f filters there are f! orders but 2^f prefixes; at most f survivor tables are persisted at
a time, and each is a filter on the one above it. Texts are read once, for the facts."""

from __future__ import annotations

import itertools
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import UPPER, WORD, discard, materialize

#: Repeated texts beyond this number are joined, fewer are broadcast (48 bytes each).
BROADCAST_TEXTS = 100_000
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_rules(text: Column) -> dict[str, Column]:
    """The failure conditions that one text decides."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {"A": n < 50, "B": 100 * distinct < 65 * n, "C": 100 * capitals > 5 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A to E, good, toxic) for each row of docs, written once; a column A to E says
    whether the row fails that filter.

    Null texts are empty; a null source is the part ''. A row fails E if its text is that of a
    row with a smaller doc_id; a null doc_id neither fails it nor makes others fail. A document
    is good or toxic if any of its labels says 1; rows that share a doc_id share its labels. Texts
    are judged by Spark's functions, whatever their length; other columns aren't read."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("h"), *[c.alias(k) for k, c in text_rules(F.col("t")).items()])
    rows = materialize(rows, "audit")
    # a text's copies meet as one row a task; only texts that repeat go back to their rows
    first = rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("h", "first")
    first = materialize(first, "copies")
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")).filter("good or toxic")
    few = first.count() <= BROADCAST_TEXTS
    out = rows.join(F.broadcast(first) if few else first, "h", "left").join(marks, "doc_id", "left")
    no = F.lit(False)
    out = materialize(out.select("part", "A", "B", "C", "D", F.coalesce(F.col("first") < F.col("doc_id"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")), "facts")
    discard(rows)
    discard(first)
    return out


def edges(rows: DataFrame, filters: str, part: str = "part") -> DataFrame:
    """(part, state, letter, kept, removed, good_lost, toxic_lost): what filter `letter` does to
    the survivors of the filters in `state` (a bit mask by position in `filters`), by part;
    parts without survivors have no row. rows has a boolean column for each filter.

    The trie of orders is walked depth first. Survivors are persisted while the walk is below
    them; a state met before is not executed again, as its survivors don't depend on the order."""
    seen: set[int] = set()
    found: list[DataFrame] = []

    def lost(f: str, also: Column) -> Column:
        return F.count_if(F.col(f) & also)

    def walk(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        left = [f for i, f in enumerate(filters) if not state >> i & 1]
        survivors.persist(StorageLevel.MEMORY_AND_DISK)
        yes = F.lit(True)
        outcome = [F.struct(F.lit(f).alias("letter"), lost(f, yes).alias("removed"), lost(f, F.col("good")).alias("good_lost"), lost(f, F.col("toxic")).alias("toxic_lost")) for f in left]
        counted = survivors.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.array(*outcome).alias("edge"))
        found.append(materialize(counted.select(part, F.lit(state).alias("state"), "n", F.explode("edge").alias("e")).select(part, "state", "e.letter", (F.col("n") - F.col("e.removed")).alias("kept"), "e.removed", "e.good_lost", "e.toxic_lost"), "edge"))
        for f in left:
            below = state | 1 << filters.index(f)
            if below not in seen and below != (1 << len(filters)) - 1:
                walk(below, survivors.filter(~F.col(f)))
        survivors.unpersist()

    walk(0, rows)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def audit(rows: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of all filters and step: (part, filter_order, step) and
    COUNTS. rows: facts(), or any table with part, good, toxic and a boolean column for each
    filter; no null among them.

    Zeros are given too: each part that has a row has f! * f rows. An empty table gives none.
    What a step keeps depends on which filters came before it, not on their order, so the f! *
    f steps read 2^(f-1) * f counted edges."""
    n = len(filters)
    counted = materialize(edges(rows, filters), "edges")
    fails = sum((F.col(f).cast("int") for f in filters), F.lit(0))
    totals = F.array(*[F.struct(F.lit(f).alias("letter"), F.count_if(F.col(f)).alias("fails"), F.count_if(F.col(f) & (fails == 1)).alias("unique_fails")) for f in filters])
    per = materialize(rows.groupBy("part").agg(totals.alias("per")), "parts")
    own = per.select("part", F.explode("per").alias("p")).select("part", "p.*")
    # an edge below a state of k filters lies on k! (n-1-k)! orders
    times = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), (F.bit_count("state") + 1).cast("int"))
    shapley = counted.groupBy("part", "letter").agg(F.sum(F.col("removed") * times).alias("shapley"))
    own = own.join(shapley, ["part", "letter"])
    steps = [(o, k + 1, o[k], sum(1 << filters.index(x) for x in o[:k])) for o in map("".join, itertools.permutations(filters)) for k in range(n)]
    steps = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, letter string, state int")
    plan = own.join(F.broadcast(steps), "letter")  # f! * f steps
    out = plan.join(counted, ["part", "state", "letter"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    redundant = (F.col("fails") - F.coalesce("removed", F.lit(0))).alias("redundant")
    return out.select("part", "filter_order", "step", zero("kept"), zero("removed"), redundant, "unique_fails", zero("good_lost"), zero("toxic_lost"), "shapley")


def op12(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(facts(docs.select("doc_id", "source", "text"), labels.select("doc_id", "quality", "toxic")))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
             100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS c,
             regexp_matches(t, '[#$%&*|]') AS d, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS fails, count(*) AS n,
             sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM x LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT p.letter || q.letter || r.letter || s.letter || u.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits
      FROM f p, f q, f r, f s, f u WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31 AND len(list_distinct([p.bit, q.bit, r.bit, s.bit, u.bit])) = 5),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k-1]), 0) AS INT) AS before FROM o, range(1, 6) t(k)),
g AS (SELECT part, filter_order, CAST(step AS INT) AS step, bit,
             CAST(sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
             CAST(sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
             CAST(sum(CASE WHEN fails & before > 0 AND fails & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
             CAST(sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
             CAST(sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
             CAST(sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM g
"""
