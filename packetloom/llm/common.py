"""What the corpus operators share: a shared work folder, code shipping, capped bitmaps."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: blank and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}
_shipped: set[str] = set()


def workspace(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir (or the context's checkpoint directory); a
    temporary one only where neither is set, and then only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='packetloom-')}"
    return _own[app]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there,
    so a lost executor costs a re-read and not a recomputation. Spark deletes the folder
    when the session ends."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/packetloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._packetloom_path = path
    return out


def materialize_few(df: DataFrame, tag: str) -> DataFrame:
    """materialize() for a table of a proven bound, such as a capped bitmap: a few files, however
    many partitions it was made in (each file costs its writer a forked process or more)."""
    return materialize(df.repartition(4), tag)


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_packetloom_path", None)
    if path:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application. Where
    the session has no limit on the bytes of an Arrow batch it gets one (Spark's own is 64 MB,
    and both sides hold a batch twice)."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="packetloom-code-")
    target = os.path.join(folder, "packetloom_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)  # the driver serves it to executors, also to late ones
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _shipped.add(app)


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else untouched."""
    return F.translate(c, UPPER, LOWER)


#: Bits of one stored piece of a bitmap (what bitmap_construct_agg makes).
PIECE = 32768


def capped_bits(rows: int, a_row: int = 16, most: int = 1 << 28) -> int:
    """A power of two: a_row bits for each row, but 32 MiB (most bits) in any case. Beyond
    that a filter lets more rows pass; it never loses one."""
    bits = PIECE
    while bits < a_row * rows and bits < most:
        bits *= 2
    return bits


def bitmap(positions: DataFrame, col: str) -> DataFrame:
    """The set of bit positions as rows (piece, bits): at most positions/PIECE rows of 4 KiB."""
    return positions.groupBy(F.expr(f"{col} div {PIECE}").alias("piece")).agg(F.expr(f"bitmap_construct_agg({col} % {PIECE})").alias("bits"))


def has_bit(bits: Column, pos: Column) -> Column:
    """Whether the piece `bits` (null: no bit) has position pos."""
    at = F.pmod(pos, F.lit(PIECE))
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))


def bits_of(pieces: DataFrame, bits: int):
    """The bitmap as bytes (at most 32 MiB) for Python tasks, as a broadcast."""
    import numpy as np

    out = np.zeros(bits // 8, np.uint8)
    for r in pieces.collect():  # at most bits / PIECE rows
        at = r["piece"] * (PIECE // 8)
        out[at : at + PIECE // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return pieces.sparkSession.sparkContext.broadcast(out)


def in_bits(bits, pos):
    """Whether each position (a numpy array of int64) is set."""
    return (bits[pos >> 3] >> (pos & 7).astype("uint8")) & 1 == 1


def without(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """df without the rows whose key (a long) is in gone (one column, k). A capped filter lets
    all rows pass straight through that can't be in it; only the others are joined, by the
    key itself. Rows with a null key stay."""
    gone = materialize(gone.select(F.col("k").alias("__k")).filter("__k is not null").distinct(), "gone")
    bits = capped_bits(gone.count(), 32)
    spot = lambda k: F.xxhash64(k).bitwiseAND(F.lit(bits - 1))
    pieces = F.broadcast(materialize_few(bitmap(gone.select(spot(F.col("__k")).alias("pos")).distinct(), "pos").toDF("__piece", "__bits"), "gonebits"))
    rows = df.withColumn("__key", key).withColumn("__pos", spot(F.col("__key")))
    rows = rows.join(pieces, F.expr(f"__pos div {PIECE}") == F.col("__piece"), "left").withColumn("__maybe", has_bit(F.col("__bits"), F.col("__pos")))
    free = rows.filter(~F.col("__maybe")).select(*df.columns)
    rest = rows.filter("__maybe").join(gone, F.col("__key") == F.col("__k"), "left_anti").select(*df.columns)
    return free.unionByName(rest)


#: Bytes that a Python task turns into objects at once; a single longer row goes alone.
SLICE = 2 << 20


def slices(batches, col: str, size: int = SLICE):
    """Arrow batches cut so that the strings (or lists of int32) of a column hold `size` bytes
    at most, or are one row: what a worker holds as Python objects doesn't grow with Spark's
    batches."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        values = b.column(col)
        if b.num_rows <= 1 or values.nbytes <= size:
            if b.num_rows:
                yield b
            continue
        length = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
        ends = pc.cumulative_sum(pc.fill_null(length, 0).cast("int64")).to_numpy()
        start = 0
        while start < b.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(ends.searchsorted(before + size, "right")))
            yield b.slice(start, stop - start)
            start = stop


def tidy() -> None:
    """At the end of a Python task: hand unused memory back, for workers live on."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
