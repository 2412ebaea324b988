"""Scoring of many answers at once, as DataFrames; score.py judges one answer object.

GOLD has a row for each gold value: question_id, field, kind (scalar_number, scalar_enum, set),
match (ordered, unordered, top_k_prefix; sets only), place (of a set's element, from 1; else 0),
value (JSON text with sorted keys), tolerance_abs, tolerance_rel, frames (array).
ANSWERS has a row for each given value: run_id, question_id, field, place, value, frames.
FRAMES has frame, conv, kind of every frame of the capture.
Nothing is collected by question: elements are counted by grouped sums, and only the places and
frames of one value of one answer are an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.stage import written

KEYS = ["run_id", "question_id", "field"]


def _plain(c: Column) -> Column:
    return F.lower(F.trim(c))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by question, the one key under which gold, runs and answers meet: all that follows is
    grouped inside it and deals nothing again. What lies so already isn't moved."""
    return rows.filter("question_id is not null").repartition("question_id")


def _wanted(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """Gold for each run that answers its question. Runs are counted, not only told apart, so that
    they need a column that others need too and all read the same exchange of the answers."""
    runs = _dealt(answers).groupBy("run_id", "question_id").agg(F.count_if(F.col("place") >= 0).alias("given")).filter("given >= 0")
    return runs.drop("given").join(_dealt(gold), "question_id")


def _singles(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each run and gold value that isn't of a set, with what the run gives (null:
    nothing): want, tolerances and golden frames beside got, place and cited frames."""
    want, got = F.struct("kind", F.col("value").alias("want"), "tolerance_abs", "tolerance_rel", F.col("frames").alias("golden")), F.struct(F.col("value").alias("got"), "place", F.col("frames").alias("cited"))
    g = _wanted(gold.filter("kind <> 'set'"), answers).select(*KEYS, want.alias("want"))
    a = _dealt(answers).select(*KEYS, got.alias("got"))
    both = g.withColumn("got", F.lit(None).cast(a.schema["got"].dataType)).unionByName(a.withColumn("want", F.lit(None).cast(g.schema["want"].dataType)))
    # answers that no such value asks for leave before those of a field become an array
    both = both.withColumn("asked", F.count("want").over(Window.partitionBy(*KEYS))).filter("asked > 0").groupBy(*KEYS).agg(F.collect_list("want").alias("want"), F.collect_list("got").alias("got"))
    return both.select(*KEYS, F.explode("want").alias("want"), "got").select(*KEYS, "want", F.explode_outer("got").alias("got")).select(*KEYS, "want.*", "got.*")


def _values(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """A row for each run and different value of a field, given or of a gold set: how often it is
    wanted and given, the first place where it is given, the number of places where it is both,
    the frames that show it, and those cited where it is first given."""
    want = _wanted(gold.filter("kind = 'set'"), answers).select(*KEYS, "value", "match", "place", "frames", F.lit(True).alias("gold"))
    got = _dealt(answers).select(*KEYS, "value", F.lit(None).cast("string").alias("match"), "place", "frames", F.lit(False).alias("gold"))
    of, by = F.col("gold"), ~F.col("gold")
    places = lambda side: F.collect_list(F.when(side, F.col("place")))
    return want.unionByName(got).groupBy(*KEYS, "value").agg(
        F.max("match").alias("match"), F.count_if(of).alias("wanted"), F.count_if(by).alias("given"), F.min(F.when(by, F.col("place"))).alias("ahead"),
        F.size(F.array_intersect(places(of), places(by))).alias("in_place"), F.array_distinct(F.flatten(F.collect_list(F.when(of, F.col("frames"))))).alias("golden"),
        F.min_by("frames", F.when(by, F.col("place"))).alias("cited"),
    )


def scalars(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """(run_id, question_id, field, pass): numbers within max(tolerance_abs, tolerance_rel *
    gold), all else equal once trimmed and lower-cased. An answer without the field fails."""
    return _scalars(_singles(gold, answers))


def _scalars(singles: DataFrame) -> DataFrame:
    want, got = F.col("want").try_cast("double"), F.col("got").try_cast("double")
    room = F.greatest(F.coalesce("tolerance_abs", F.lit(0.0)), F.abs(F.coalesce("tolerance_rel", F.lit(0.0)) * want))
    right = F.when((F.col("kind") == "scalar_number") & want.isNotNull(), F.abs(got - want) <= room).otherwise(_plain(F.col("got")) == _plain(F.col("want")))
    return singles.select(*KEYS, F.coalesce(right, F.lit(False)).alias("pass"))


def sets(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """(run_id, question_id, field, pass, partial, rank_errors): ordered sets must agree place
    by place, unordered ones as multisets, top_k_prefix ones as sets of the gold's size;
    partial and rank_errors are of the latter."""
    return _sets(_values(gold, answers))


def _sets(values: DataFrame) -> DataFrame:
    known = F.col("value").isNotNull()
    v = values.select(*KEYS, "value", "match", "wanted", "given", "ahead", "in_place").withColumn("n", F.sum("wanted").over(Window.partitionBy(*KEYS))).filter("n > 0")
    s = v.groupBy(*KEYS).agg(
        F.max("match").alias("match"), F.max("n").alias("n"), F.sum("given").alias("m"), F.sum(F.when(known, F.least("wanted", "given")).otherwise(0)).alias("common"),
        F.count_if(known & (F.col("wanted") > 0) & (F.col("ahead") <= F.col("n"))).alias("hits"), F.sum(F.when(known, F.col("in_place")).otherwise(0)).alias("in_place"),
    )
    top = F.col("match") == "top_k_prefix"
    same = F.col("m") == F.col("n")
    right = F.when(F.col("match") == "ordered", same & (F.col("in_place") == F.col("n"))).when(top, same & (F.col("hits") == F.col("n"))).otherwise(same & (F.col("common") == F.col("n")))
    return s.select(*KEYS, right.alias("pass"), F.when(top, F.round(F.col("hits") / F.col("n"), 4)).alias("partial"), F.when(top, F.least("m", "n") - F.col("in_place")).alias("rank_errors"))


def citations(gold: DataFrame, answers: DataFrame, frames: DataFrame, store: bool = True) -> DataFrame:
    """One row a run and gold value (sets: element): cited, precision, recall, valid, equivalent,
    related, irrelevant, invalid, pass and review.

    A cited frame that isn't gold is equivalent if its flow and kind are those of a gold frame,
    related if its flow is, invalid if the capture doesn't have it, else irrelevant. A
    citation passes if all of it is gold and some is there; without gold frames none may be.
    Equal elements of a gold set are one, with the frames of all. What is cited is written on
    the way, or without `store` made twice: where gold, answers and frames are of one exchange,
    a single plan reads it again and a second one would deal it again."""
    return _citations(_singles(gold, answers), _values(gold, answers), frames, store)


def _citations(singles: DataFrame, values: DataFrame, frames: DataFrame, store: bool = True) -> DataFrame:
    key = [*KEYS, "element"]
    lone = singles.groupBy(*KEYS, "kind").agg(F.array_distinct(F.flatten(F.collect_list("golden"))).alias("golden"), F.min_by("cited", "place").alias("cited"))  # a repeated answer counts once
    both = lone.select(*KEYS, F.lit(None).cast("string").alias("element"), "golden", "cited").unionByName(values.filter("wanted > 0").select(*KEYS, F.col("value").alias("element"), "golden", "cited"))
    both = both.withColumn("cited", F.array_distinct(F.coalesce("cited", F.array().cast("array<bigint>")))).withColumn("others", F.array_except("cited", "golden"))
    size = lambda c: F.size(c).cast("bigint")
    own = F.when(F.size("others") > 0, F.col("golden"))
    both = both.select(*key, size("cited").alias("cited"), (size("cited") - size("others")).alias("hits"), size("golden").alias("golden"), F.when(F.size("others") > 0, F.col("others")).alias("others"), own.alias("own"))
    both = written(both, "cited") if store else both
    # only frames that aren't gold are looked up, and the gold frames beside them
    head = [*key, "cited", "hits", "golden"]
    as_rows = lambda c, gold: F.transform(c, lambda f: F.struct(f.alias("frame"), F.lit(gold).alias("gold")))
    each = both.filter("others is not null").select(*head, F.explode(F.concat(as_rows("others", False), as_rows("own", True))).alias("f")).select(*head, "f.frame", "f.gold")
    each = each.join(frames.select("frame", "conv", "kind", F.lit(True).alias("there")), "frame", "left").select(*head, "gold", "there", "conv", "kind").repartition("question_id")
    there, gold = F.col("there").isNotNull(), F.col("gold")
    total = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    each = each.groupBy(*head, "conv", "kind").agg(F.count_if(~gold & there).alias("n"), F.count_if(~gold & ~there).alias("lost"), F.count_if(gold & there).alias("own"))
    each = each.groupBy(*head, "conv").agg(total("n", F.col("kind").isNotNull() & (F.col("own") > 0)).alias("same"), F.sum("n").alias("n"), F.sum("lost").alias("lost"), F.sum("own").alias("own"))
    flow = F.col("conv").isNotNull() & (F.col("own") > 0)
    found = each.withColumn("more", F.col("n") - F.col("same")).groupBy(*head).agg(total("same", flow).alias("equivalent"), total("more", flow).alias("related"), total("n", ~flow).alias("irrelevant"), F.sum("lost").alias("invalid"))
    plain = both.filter("others is null").select(*head, *(F.lit(0).cast("bigint").alias(c) for c in ("equivalent", "related", "irrelevant", "invalid")))
    out = plain.unionByName(found)
    none = F.col("golden") == 0
    precision = F.when(none, (F.col("cited") == 0).cast("double")).when(F.col("cited") == 0, 0.0).otherwise(F.col("hits") / F.col("cited"))
    recall = F.when(none, 1.0).otherwise(F.col("hits") / F.col("golden"))
    ok = F.when(none, F.col("cited") == 0).otherwise((F.col("cited") > 0) & (F.col("hits") == F.col("cited")))
    review = ~none & ~ok & (F.col("invalid") == 0) & (F.col("irrelevant") == 0)
    return out.select(
        *key, "cited", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), (~none & (F.col("cited") > 0) & (F.col("invalid") == 0)).alias("valid"),
        "equivalent", "related", "irrelevant", "invalid", ok.alias("pass"), review.alias("review"),
    )


def run_scores(gold: DataFrame, answers: DataFrame, frames: DataFrame) -> DataFrame:
    """One row a run and question: classification, coverage, precision and recall (means over
    its gold values). Gold and answers meet once; what they say together is written."""
    singles, values = written(_singles(gold, answers), "singles"), written(_values(gold, answers), "values")
    right = _scalars(singles).unionByName(_sets(values).select(*KEYS, "pass"))
    right = right.select("run_id", "question_id", "pass", *(F.lit(None).cast("double").alias(c) for c in ("valid", "precision", "recall")))
    cited = _citations(singles, values, frames).select("run_id", "question_id", F.lit(None).cast("boolean").alias("pass"), F.col("valid").cast("double").alias("valid"), "precision", "recall")
    out = right.unionByName(cited).groupBy("run_id", "question_id").agg(F.bool_and("pass").alias("right"), *(F.avg(c).alias(n) for c, n in (("valid", "coverage"), ("precision", "precision"), ("recall", "recall"))))
    return out.select("run_id", "question_id", F.when(F.col("right"), "correct").otherwise("wrong").alias("classification"), *(F.round(c, 4).alias(c) for c in ("coverage", "precision", "recall")))


def unsupported(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """(run_id, question_id, hallucinated) for questions whose gold says that nothing is there or
    nothing can be known ('[]' or 'unknowable'): whether the answer claims something."""
    nothing = gold.filter(F.col("value").isin("[]", "unknowable", '"unknowable"')).select("question_id", "field")
    given = answers.join(nothing, ["question_id", "field"])
    claims = F.col("value").isNotNull() & ~F.col("value").isin("[]", "unknowable", '"unknowable"', "null")
    return given.groupBy("run_id", "question_id").agg(F.bool_or(claims).alias("hallucinated"))
