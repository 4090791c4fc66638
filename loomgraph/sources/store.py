"""The index: Parquet tables on any file system Spark knows, and one small file that says which are current.

A write makes new tables beside the old ones; replacing the small file, which is one
rename, makes them current all together. Whoever reads sees the old tables or the
new ones.
"""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from loomgraph.runtime import filesystem

FOLDER, VERSION = ".loomgraph", "1"


class NoIndexError(FileNotFoundError):
    """There is no index to read."""


class Store:
    """``place``: where tables are, a folder beside the sources by default; on a cluster name one that all executors see."""

    def __init__(self, spark: SparkSession, root: str | Path, place: str | None = None):
        self.spark, self.folder = spark, Path(root).resolve() / FOLDER
        self.place = (place or f"file://{self.folder}").rstrip("/")

    def _current(self) -> dict[str, str]:
        fs, path, _ = filesystem(self.spark, f"{self.place}/current.json")
        if not fs.exists(path):
            return {}
        stream = fs.open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def exists(self) -> bool:
        return "symbols" in self._current()

    def has(self, name: str) -> bool:
        return name in self._current()

    def write(self, name: str, df: DataFrame) -> None:
        self.write_all({name: df})

    def write_all(self, tables: dict[str, DataFrame]) -> None:
        """All of them become current at once."""
        fresh = {name: f"{self.place}/{name}-{uuid.uuid4().hex}" for name in tables}
        for name, df in tables.items():
            df.write.parquet(fresh[name])
        before = self._current()
        self._switch(before | fresh)
        for name in fresh.keys() & before.keys():
            fs, path, _ = filesystem(self.spark, before[name])
            fs.delete(path, True)

    def _switch(self, current: dict[str, str]) -> None:
        fs, path, conf = filesystem(self.spark, f"{self.place}/current.json")
        _, next_, _ = filesystem(self.spark, f"{self.place}/current-{uuid.uuid4().hex}.json")
        stream = fs.create(next_)
        stream.write(json.dumps(current).encode())
        stream.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else fs.getUri(), conf).rename(next_, path, options)

    def read(self, name: str) -> DataFrame:
        current = self._current()
        if name not in current:
            raise NoIndexError(f"no {name} in {self.place}: run index first")
        return self.spark.read.parquet(current[name])

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.read("meta").collect()} if self.has("meta") else {}

    def ignore(self) -> None:
        """Keep the index out of the repository."""
        path = self.folder.parent / ".gitignore"
        text = path.read_text() if path.exists() else ""
        if f"{FOLDER}/" not in text.split():
            path.write_text(text + ("" if not text or text.endswith("\n") else "\n") + f"{FOLDER}/\n")
