"""Source files of a repository as a DataFrame."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars


def tracked(root: str | Path) -> list[str]:
    """Files that are not ignored, hidden ones included; without a repository, all files."""
    root = Path(root)
    listed = subprocess.run(["git", "-C", str(root), "ls-files", "-co", "--exclude-standard"], capture_output=True, text=True)
    if listed.returncode:
        return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())
    return sorted(x for x in listed.stdout.splitlines() if (root / x).is_file())


def find_repository(start: str | Path) -> Path:
    """The nearest folder upwards that holds .git."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / ".git").exists():
            return folder
    raise FileNotFoundError(f"no repository above {start}")


def read_sources(spark: SparkSession, root: str | Path, paths: list[str] | None = None) -> DataFrame:
    """(path, lang, text, loc, file_hash) of source files. Contents are read by the executors."""
    root = Path(root).resolve()
    names = spark.createDataFrame([(p,) for p in (tracked(root) if paths is None else paths)], "path string")
    names = names.withColumn("lang", scalars.lang_from_path(F.col("path"))).where(scalars.is_source(F.col("lang")))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{root}").select(F.expr(f"substring(path, {len(f'file:{root}/') + 1})").alias("path"), "content")
    text = F.decode("content", "UTF-8")
    rows = names.join(found, "path").select("path", "lang", text.alias("text"), F.sha2("content", 256).alias("file_hash"))
    return rows.withColumn("loc", scalars.text_loc(F.col("text")))


def changed_files(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``now`` whose (path, file_hash) is not stored."""
    return now.join(stored.select("path", "file_hash"), ["path", "file_hash"], "left_anti")
