"""History of a git repository. The driver runs git, whose output goes to the shared folder; executors read and parse it."""

from __future__ import annotations

import subprocess
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.runtime import shared_dir
from loomgraph.sources import diffs


class Repository:
    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, Path(root)

    def git(self, *args: str) -> str:
        return subprocess.run(["git", "-C", str(self.root), "-c", "core.quotePath=false", *args], capture_output=True, text=True, check=True).stdout

    def head(self) -> str:
        return self.git("rev-parse", "HEAD").strip()

    def spooled(self, separator: str, *args: str) -> DataFrame:
        """(value) of git's output, cut at ``separator``: written to the shared folder as git goes, read and parsed by executors."""
        place = f"{shared_dir(self.spark)}/git-{uuid.uuid4().hex}"
        with tempfile.TemporaryDirectory(prefix="loomgraph-") as here:
            local = Path(here) / "output"
            with local.open("wb") as f:
                subprocess.run(["git", "-C", str(self.root), "-c", "core.quotePath=false", *args], stdout=f, check=True)
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(place)
            target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).copyFromLocalFile(True, True, jvm.org.apache.hadoop.fs.Path(f"file://{local}"), target)
        return self.spark.read.option("lineSep", separator).text(place)

    def history(self, since: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(commits: sha, ts, n_parents; commit_files: sha, path, lang). Merges are left out; a first commit has no files, as nothing is before it."""
        log = self.spooled("\x01", "log", "--no-merges", "--name-only", "--format=\x01%H %at %P", *([f"{since}..HEAD"] if since else []))
        rows = diffs.changed_files(log.withColumnRenamed("value", "commit"))
        listed = rows.where("n_parents > 0").select("sha", F.explode("paths").alias("path"))
        return rows.select("sha", "n_parents", F.timestamp_seconds("epoch").alias("ts")), listed.withColumn("lang", scalars.lang_from_path(F.col("path")))

    def patches(self, since: str | None = None) -> DataFrame:
        """(commit): hash and diff without context of each commit."""
        log = self.spooled("\x01", "log", "-p", "--unified=0", "--no-merges", "--format=\x01%H", *([f"{since}..HEAD"] if since else []))
        return log.withColumnRenamed("value", "commit")

    def diff(self, *revisions: str) -> DataFrame:
        """(section): the files' parts of a diff without context; one revision: against the working tree."""
        return self.spooled("\ndiff --git ", "diff", "--unified=0", *revisions).withColumnRenamed("value", "section")

    def changed(self, *revisions: str) -> list[str]:
        return [x for x in self.git("diff", "--name-only", *revisions).split("\n") if x]

    def is_ancestor(self, sha: str) -> bool:
        return subprocess.run(["git", "-C", str(self.root), "merge-base", "--is-ancestor", sha, "HEAD"], capture_output=True).returncode == 0

    def merge_base(self, a: str, b: str) -> str:
        return self.git("merge-base", a, b).strip()
