"""Aggregates over scored runs, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUNS = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("question_id", "classification", "skill", "difficulty", "scenario_pack", "ir_coverage", "corpus_layer")),
    *(T.StructField(n, T.BooleanType()) for n in ("schema_valid", "m4_applicable", "hallucinated", "budget_exhausted")),
    *(T.StructField(n, T.DoubleType()) for n in ("coverage", "precision", "recall", "tokens", "wall_ms", "turns")),
])


def runs_frame(spark: SparkSession, runs: list[tuple[dict, dict, dict]]) -> DataFrame:
    """(question, scored run, metrics) triples as rows."""
    rows = []
    for q, r, m in runs:
        tags, e = q.get("tags") or {}, r["evidence"]
        rows.append((
            r["question_id"], r["classification"], "+".join(tags.get("skill") or []), tags.get("difficulty_label"), tags.get("scenario_pack"), tags.get("ir_coverage"), tags.get("corpus_layer"),
            r["schema_valid"], r["hallucination"]["applicable"], r["hallucination"]["hallucinated"], m.get("budget_exhausted"),
            *((e["coverage"], e["precision"], e["recall"]) if e else (None, None, None)), m.get("tokens"), m.get("wall_ms"), m.get("turns"),
        ))
    return spark.createDataFrame([tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in rows], RUNS)


def summary(runs: DataFrame) -> DataFrame:
    """One row: correctness, cost for each correct run (all runs' cost counts), evidence means
    over valid runs, rate of unsupported claims, and diagnostics; null where nothing counts."""
    right = F.count_if(F.col("classification") == "correct")
    measured = F.count("tokens")
    rate = lambda hit, of: F.try_divide(F.count_if(hit), F.nullif(F.count_if(of), F.lit(0)))
    cost = lambda c: F.when((right > 0) & (measured > 0), F.sum(c) / right)
    valid = lambda c: F.avg(F.when(F.col("schema_valid"), F.col(c)))
    every = F.nullif(F.count(F.lit(1)), F.lit(0))
    return runs.agg(
        F.count(F.lit(1)).alias("runs"), (right / every).alias("m1_correct"), cost("tokens").alias("tokens_per_correct"), cost("wall_ms").alias("wall_ms_per_correct"),
        valid("coverage").alias("m3_coverage"), valid("precision").alias("m3_precision"), valid("recall").alias("m3_recall"),
        rate(F.col("m4_applicable") & F.col("hallucinated"), F.col("m4_applicable")).alias("m4_hallucination"),
        F.coalesce(F.count_if(F.col("classification") == "format_error") / every, F.lit(0.0)).alias("format_error_rate"),
        F.avg("turns").alias("turns_per_question"), rate(F.col("budget_exhausted"), F.col("budget_exhausted").isNotNull()).alias("budget_exhausted_rate"),
    )


def buckets(runs: DataFrame, *keys: str) -> DataFrame:
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("classification") == "correct").alias("correct"))


def majority(runs: DataFrame) -> DataFrame:
    """A question counts as correct if more than half of its runs are."""
    return runs.groupBy("question_id").agg((F.count_if(F.col("classification") == "correct") * 2 > F.count(F.lit(1))).alias("correct"))


def usage(calls: DataFrame, col: str, most: int = 15) -> DataFrame:
    """How often each entry of an array column is used, most first."""
    return calls.select(F.explode(col).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "name").limit(most)


def context_cost(outputs: DataFrame) -> DataFrame:
    """Characters by tool (columns tool, text) with each tool's share."""
    sums = outputs.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.length("text")).alias("chars"))
    return sums.withColumn("share", F.col("chars") / outputs.select(F.sum(F.length("text"))).scalar())


def write(runs: DataFrame, folder: str, *slices: str) -> None:
    """report.json (the summary, one object) and slices.json (a line for each bucket of each
    column of `slices`), as folders of one file; the latter's numbers are counted by Spark."""
    summary(runs).coalesce(1).write.mode("overwrite").json(f"{folder}/report.json")
    out = None
    for key in slices:
        rows = buckets(runs, key).select(F.lit(key).alias("slice"), F.col(key).cast("string").alias("name"), "total", "correct")
        out = rows if out is None else out.unionByName(rows)
    if out is not None:
        rate = F.round(F.try_divide("correct", "total"), 6)
        out.withColumn("share", rate).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/slices.json")


def read_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_zipped_logs(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The same from zip archives, on any file system that Spark reads."""

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        for b in batches:
            for content in b.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        lines = z.read(name).decode("utf-8", "replace").splitlines()
                        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["line"])

    lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "line string")
    return lines.select(F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("v")).filter("v is not null").select("v.*").filter(F.greatest(*(F.col(f.name).isNotNull() for f in schema.fields)) if len(schema.fields) > 1 else F.col(schema.fields[0].name).isNotNull())
