r"""Chat formatting by a grammar round trip.

A turn is rendered as `### role: text</turn>` and a line feed; the role is url-encoded. The
parser splits at `### `, wants each piece to end in the only `</turn>` it has, and takes a
backslash away from before any character. A conversation is rendered as it is; the parser
reads it back; where the turns differ, control strings are escaped (`##\# `, `<\/turn>`), and
where they still differ, backslashes too. The last form always reads back identical."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "### ", "</turn>"


def _escape(text: Column, level: int) -> Column:
    if level == 2:
        text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    if level:
        text = F.replace(F.replace(text, F.lit(START), F.lit("##\\# ")), F.lit(END), F.lit("<\\/turn>"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _pieces(turns: Column, level: int) -> Column:
    """An array of (head, body, tail) of each turn."""
    return F.transform(turns, lambda t: F.struct(F.concat(F.lit(START), F.url_encode(t["role"]), F.lit(": ")).alias("head"), _escape(t["text"], level).alias("body"), F.lit(END + "\n").alias("tail"), (t["role"] == "assistant").alias("loss")))


def _render(turns: Column, level: int) -> Column:
    return F.array_join(F.transform(_pieces(turns, level), lambda p: F.concat(p["head"], p["body"], p["tail"])), "")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; null where the grammar doesn't fit."""
    pieces = F.split(formatted, START)
    whole = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    good = (F.element_at(pieces, 1) == "") & F.forall(whole, lambda p: p.rlike(r"(?s)^[^: ]*: .*</turn>\n$") & (F.instr(p, END) == F.length(p) - len(END)))
    turns = F.transform(whole, lambda p: F.struct(F.try_url_decode(F.substring_index(p, ": ", 1)).alias("role"), unescape(F.substring(p, F.instr(p, ": ") + 2, F.length(p) - F.instr(p, ": ") - len(END) - 2)).alias("text")))
    return F.when(good, turns)


def format_chats(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, level (of escaping: 0, 1 or 2) and loss_spans (array of start and
    end, in code points of `formatted`, of each assistant text as it is rendered).

    Rows are ordered by turn (null first), then role and text, so repeated turns stay and
    reruns agree. Null text and null role count as empty. Rows of a null conv_id form one
    conversation. Other columns are not read. An empty table gives an empty result. A conversation
    is one row, so it must fit into a task, as must any text in it."""
    rows = chats.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text"))).alias("rows"))
    grouped = grouped.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))
    same = lambda level: parse(_render(F.col("turns"), level)) == F.col("turns")
    level = F.when(same(0), 0).when(same(1), 1).otherwise(2)
    placed = grouped.withColumn("level", level).withColumn("pieces", F.when(F.col("level") == 0, _pieces(F.col("turns"), 0)).when(F.col("level") == 1, _pieces(F.col("turns"), 1)).otherwise(_pieces(F.col("turns"), 2)))
    spot = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        return F.struct((end + F.length(p["tail"])).alias("at"), F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("pieces", spot, step)
    return placed.select("conv_id", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"), "level", spans["spans"].alias("loss_spans"))


#: The conversation that the query adds: both turns hold control strings and a backslash.
ADDED = "\\### Assistant: </turn> ok"


def op3(spark, sf_dir):
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED).alias("text"))
    out = format_chats(chats.unionByName(added))
    read = out.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l AS (SELECT *, CASE WHEN bool_or(regexp_matches(text, '(?s)\\.')) OVER g THEN 2 WHEN bool_or(contains(text, '### ') OR contains(text, '</turn>')) OVER g THEN 1 ELSE 0 END AS level FROM c WINDOW g AS (PARTITION BY conv_id)),
e AS (SELECT *, CASE level WHEN 0 THEN text WHEN 1 THEN replace(replace(text, '### ', '##\# '), '</turn>', '<\/turn>')
              ELSE replace(replace(replace(text, '\', '\\'), '### ', '##\# '), '</turn>', '<\/turn>') END AS body FROM l)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(replace(replace(replace(url_encode(role), '%20', '+'), '%2A', '*'), '~', '%7E')) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
