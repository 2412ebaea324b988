"""Tables kept together: each write is a new generation, and a manifest names the current one.

Readers see the tables of one generation, never a mix; a write that fails leaves the old one
current. Works on any file system that renames without overwriting."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        self._files = self._at("x").getFileSystem(conf)

    def _manifests(self) -> list[int]:
        if not self._files.exists(self._at("manifests")):
            return []
        names = [x.getPath().getName() for x in self._files.listStatus(self._at("manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, number: int) -> dict:
        lines = self.spark.read.text(f"{self.folder}/manifests/{number:09d}.json", wholetext=True).collect()
        return json.loads(lines[0][0])

    def _publish(self, number: int, text: str) -> bool:
        """One file, complete when it appears; False if another writer took the number."""
        rough, name = self._at(f"manifests/_{uuid.uuid4().hex}"), self._at(f"manifests/{number:09d}.json")
        out = self._files.create(rough)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        done = not self._files.exists(name) and self._files.rename(rough, name)
        if not done:
            self._files.delete(rough, False)
        return done

    def current(self) -> dict | None:
        """The newest manifest: generation, marker and the schemas of its tables."""
        numbers = self._manifests()
        return self._manifest(numbers[-1]) if numbers else None

    def read(self, marker: str | None = None, schemas: dict[str, T.StructType] | None = None) -> dict[str, DataFrame] | None:
        """The current tables; None if there are none, they bear another marker, or a table lacks
        a column that `schemas` asks for (or has it with another type)."""
        m = self.current()
        if m is None or marker is not None and m["marker"] != marker:
            return None
        have = {n: T.StructType.fromJson(s) for n, s in m["tables"].items()}
        for name, schema in (schemas or {}).items():
            types = {f.name: f.dataType for f in have[name].fields} if name in have else {}
            if any(types.get(f.name) != f.dataType for f in schema.fields):
                return None
        return {n: self.spark.read.schema(s).parquet(f"{self.folder}/{m['generation']}/{n}") for n, s in have.items()}

    def write(self, marker: str, tables: dict[str, DataFrame], partition: list[str] | None = None, keep: int = 2) -> dict[str, DataFrame]:
        """A new generation of all tables, made current when it is whole. The `keep` newest
        generations stay, for those who are still reading."""
        generation = f"generation-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.option("compression", "zstd").partitionBy(*partition or []).parquet(f"{self.folder}/{generation}/{name}")
        text = json.dumps({"generation": generation, "marker": marker, "tables": {n: df.schema.jsonValue() for n, df in tables.items()}})
        number = (self._manifests() or [0])[-1] + 1
        while not self._publish(number, text):
            number += 1
        for old in self._manifests()[:-keep]:
            self._files.delete(self._at(self._manifest(old)["generation"]), True)
            self._files.delete(self._at(f"manifests/{old:09d}.json"), False)
        out = self.read()
        assert out is not None
        return out
