"""Byte streams put together from segments, and the messages in them, as rows.

A segment is a row: its flow and direction (keys), its place of arrival (order), its sequence
number (32 bits, wrapping round) and its bytes. Everything is a prefix scan, so a stream of any
length is merged in ranges; only a message is ever held whole. Inside, bytes are text with a
character for each byte, which Spark's string functions cut and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.ordered import laid, prefix
from packetloom.stage import written

WRAP = 1 << 32
_BYTE = "ISO-8859-1"


def as_text(data: Column) -> Column:
    """A character for each byte."""
    return F.decode(data, _BYTE)


def as_bytes(text: Column) -> Column:
    return F.encode(text, _BYTE)


def unwrapped(segments: DataFrame, keys: list[str], order: str, seq: str) -> DataFrame:
    """segments with `at`: how far each lies from its stream's first arrival, in 64 bits.
    A segment is taken to be the nearest to the one that arrived before it, so streams may wrap
    any number of times. Rows without a sequence number are left out."""
    x = laid(segments.filter(F.col(seq).isNotNull()), keys, [order])
    x = prefix(x, keys, __last=("last", F.col(seq)))
    step = F.coalesce(F.pmod(F.col(seq) - F.col("__last") + WRAP // 2, F.lit(WRAP)) - WRAP // 2, F.lit(0))
    x = prefix(x.withColumn("__step", step.cast("long")), keys, __sum=("sum", F.col("__step")))
    return x.withColumn("at", F.coalesce("__sum", F.lit(0)) + F.col("__step")).drop("__last", "__step", "__sum", "__range", "__at")


def merged(segments: DataFrame, keys: list[str], order: str = "frame_number", seq: str = "seq", data: str = "data") -> DataFrame:
    """(keys, at, text, gap): the pieces of each stream in order, each byte once. at counts from
    the stream's lowest byte, gap is the number of bytes missing before the piece. Of bytes sent
    more than once those of the segment that begins earlier stay, of equal beginnings those
    that arrived first. Null and empty segments give nothing; null keys are a stream."""
    whole = _named(segments.filter(F.col(seq).isNotNull()).select(*keys, order, seq, as_text(F.col(data)).alias("text")), "segments")
    u = unwrapped(whole.select(*keys, order, seq, "__id", F.length("text").alias("__n")), keys, order, seq).filter("__n > 0")
    end = F.col("at") + F.col("__n")
    x = laid(u.select(*keys, order, "at", "__id", "__n"), keys, ["at", order])
    x = prefix(x, keys, __end=("max", end), __base=("first", F.col("at")))
    begin = F.greatest("at", F.coalesce("__end", "at"))
    x = x.withColumns({"__begin": begin, "gap": F.greatest(F.col("at") - F.coalesce("__end", "at"), F.lit(0)).cast("long")}).filter(end > F.col("__begin"))
    x = x.select(*keys, (F.col("__begin") - F.coalesce("__base", "at")).alias("at"), (F.col("__begin") - F.col("at") + 1).cast("int").alias("__from"), "gap", "__id")
    return x.join(whole.select("__id", "text"), "__id").select(*keys, "at", F.expr("substring(text, __from)").alias("text"), "gap")


def _named(df: DataFrame, tag: str) -> DataFrame:
    """df, written, with a number for each row: scans run over what they need, and texts meet
    their results once, by number."""
    return written(df.withColumn("__id", F.monotonically_increasing_id()), tag)


def messages(pieces: DataFrame, keys: list[str], delimiter: bytes) -> DataFrame:
    """(keys, message, text, gap): what lies between delimiters, numbered from 0 in each stream,
    empty ones too; gap is the number of bytes missing inside. A delimiter may lie across any
    pieces, but must not overlap itself (ValueError), so its places don't depend on the cuts."""
    n, mark = len(delimiter), delimiter.decode(_BYTE)
    if not n or any(delimiter[:k] == delimiter[-k:] for k in range(1, n)):
        raise ValueError("a delimiter must not be empty or overlap itself")
    whole = _named(pieces.select(*keys, "at", "text", "gap"), "pieces")
    split = lambda c: F.split(c, rf"\Q{mark}\E", -1)
    edge = F.when(F.col("gap") > 0, F.concat(F.lit("\x00"), "text")).otherwise(F.col("text"))
    # the last n - 1 bytes before a piece lie in the n - 1 pieces before it; a gap breaks them
    x = laid(whole.select(*keys, "at", "gap", "__id", F.right(edge, F.lit(n - 1)).alias("__tail0"), F.left("text", F.lit(n - 1)).alias("__head"), (F.size(split(F.col("text"))) - 1).alias("__inside")), keys, ["at"])
    for k in range(1, n):
        x = prefix(x, keys, **{f"__tail{k}": ("last", F.col(f"__tail{k - 1}"))})
    tails = [F.coalesce(F.col(f"__tail{k}"), F.lit("")) for k in range(n - 1, 0, -1)]
    tail = F.when(F.col("gap") > 0, F.lit("")).otherwise(F.right(F.concat(*tails), F.lit(n - 1))) if tails else F.lit("")
    # delimiters don't overlap, so those that end in a piece lie inside it or across its beginning
    across = F.size(split(F.concat("__t", "__head"))) - 1
    x = prefix(x.withColumn("__t", tail).withColumn("__n", (F.col("__inside") + across).cast("long")), keys, __before=("sum", F.col("__n")))
    # texts up to each delimiter that ends in the piece; the tail is cut off the first again
    x = x.select("__id", "__t", "__before").join(whole, "__id").withColumn("__parts", split(F.concat("__t", "text")))
    part = x.select(*keys, "at", "gap", F.coalesce("__before", F.lit(0)).alias("__before"), F.length("__t").alias("__cut"), F.posexplode("__parts").alias("__i", "__part"))
    own = F.when(F.col("__i") == 0, F.expr("substring(__part, __cut + 1)")).otherwise(F.col("__part"))
    # a first part shorter than the tail: the delimiter began in the pieces before, which lose it
    over = F.when(F.col("__i") == 0, F.greatest(F.col("__cut") - F.length("__part"), F.lit(0))).otherwise(0)
    rows = part.select(*keys, (F.col("__before") + F.col("__i")).alias("message"), F.struct("at", F.col("__i").alias("i"), own.alias("text"), over.alias("over"), F.when(F.col("__i") == 0, F.col("gap")).otherwise(0).alias("gap")).alias("p"))
    whole = rows.groupBy(*keys, "message").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    text = F.array_join(F.transform("ps", lambda p: p["text"]), "")
    lost = F.aggregate("ps", F.lit(0), lambda a, p: F.greatest(a, p["over"]))
    gap = F.aggregate("ps", F.lit(0).cast("long"), lambda a, p: a + p["gap"])
    return whole.select(*keys, "message", text.alias("text"), lost.alias("__lost"), gap.alias("gap")).select(*keys, "message", F.expr("substring(text, 1, length(text) - __lost)").alias("text"), "gap")
