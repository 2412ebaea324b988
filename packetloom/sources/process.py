"""Lines that an external dissector prints, one run a file, on the executors."""

from __future__ import annotations

import subprocess
import threading

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.schema import DISSECTED, column_of

MAX_LINE, TIMEOUT_S, GRACE_S = 4_000_000, 300.0, 5.0


def lines_of(command: list[str], timeout_s: float = TIMEOUT_S, max_line: int = MAX_LINE):
    """Lines of stdout as they come; longer ones are left out. After timeout_s the process is
    asked to end, and killed GRACE_S later; that, or a failure, is an error."""
    p = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace")
    late = threading.Event()

    def stop():
        late.set()
        p.terminate()
        try:
            p.wait(GRACE_S)
        except subprocess.TimeoutExpired:
            p.kill()

    said: list[str] = []
    drain = threading.Thread(target=lambda: said.append(p.stderr.read(100_000)), daemon=True)
    timer = threading.Timer(timeout_s, stop)
    timer.start()
    drain.start()
    try:
        for line in p.stdout:
            if len(line) <= max_line:
                yield line.rstrip("\n")
        code = p.wait()
        drain.join(1)
        if late.is_set():
            raise TimeoutError(f"{command[0]} took more than {timeout_s:g} s")
        if code:
            raise RuntimeError(f"{command[0]} failed ({code}): {''.join(said)[:500]}")
    finally:
        timer.cancel()
        if p.poll() is None:
            p.kill()


def read_lines(files: DataFrame, command: list[str], timeout_s: float = TIMEOUT_S, max_line: int = MAX_LINE) -> DataFrame:
    """(path, line) for files (column path); {path} in the command stands for the file, which
    each executor must be able to open."""

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                held: list[str] = []
                for line in lines_of([c.replace("{path}", path) for c in command], timeout_s, max_line):
                    held.append(line)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(held, pa.string())], names=["path", "line"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(held, pa.string())], names=["path", "line"])

    return files.select("path").mapInArrow(run, "path string, line string")


def dissect(files: DataFrame, command: list[str], fields: list[str] = DISSECTED, **limits) -> DataFrame:
    """Tab-separated output as dissected rows; the file's name is the capture. Lines with too
    few fields are left out."""
    parts = F.split("line", "\t")
    rows = read_lines(files, command, **limits).filter(F.size(parts) >= len(fields))
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return rows.select(*(F.when(parts[i] != "", parts[i]).alias(column_of(f)) for i, f in enumerate(fields)), name.alias("capture_id"))
