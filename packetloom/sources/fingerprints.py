"""Ids of files by their content, a few ranges of each, read on the executors."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of head and tail, of a block between them, and how many blocks.
EDGE, BLOCK, BLOCKS = 256 << 10, 64 << 10, 8


def ranges(size: int) -> list[tuple[int, int]]:
    """(start, length) of what the id of a file of this size depends on, besides the size."""
    if size <= 2 * EDGE:
        return [(0, min(size, EDGE))]
    step = max(BLOCK, (size - 2 * EDGE) // BLOCKS)
    return [(0, EDGE), *((at, BLOCK) for at in range(EDGE, size - EDGE, step)[:BLOCKS]), (size - EDGE, EDGE)]


def fingerprint(path: str) -> str:
    """The id of one file: by path, or by URI of any file system that Arrow opens."""
    system, name = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
    size = system.get_file_info(name).size
    if size is None:
        raise FileNotFoundError(path)
    h = hashlib.sha256(str(size).encode())
    with system.open_input_file(name) as f:
        for start, length in ranges(size):
            h.update(f.read_at(length, start))
    return "cap_" + h.hexdigest()[:16]


def fingerprints(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size, capture_id) of the files below a folder, a row a file. Spark lists them (the
    content column isn't asked for, so no file is opened for that); tasks read the ranges.
    Spark lists no empty file, so those have no row; an unreadable file is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"))

    def run(batches):
        for b in batches:
            ids = [fingerprint(p.removeprefix("file:") if p.startswith("file:/") else p) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("size"), pa.array(ids)], names=["path", "size", "capture_id"])

    return files.mapInArrow(run, "path string, size long, capture_id string")
