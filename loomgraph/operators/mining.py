"""History mining: churn, recency, hotspots, co-change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.runtime import materialize

MASS_COMMIT, DECAY = 50, 0.003


def without_merges(commits: DataFrame) -> DataFrame:
    return commits.where("n_parents <= 1")


def kept_files(commit_files: DataFrame, most: int = MASS_COMMIT) -> DataFrame:
    """Files of commits with at most ``most`` files of any kind, then source files only. Commits are counted before they meet their files, so a mass commit is no hot key."""
    mass = commit_files.groupBy("sha").agg(F.count("*").alias("n_files")).where(F.col("n_files") > most).select("sha")
    return commit_files.join(mass, "sha", "left_anti").where(scalars.is_source(F.col("lang")))


def file_churn(files: DataFrame) -> DataFrame:
    return files.groupBy("path").agg(F.count_distinct("sha").alias("churn"))


def last_commit(files: DataFrame, commits: DataFrame) -> DataFrame:
    """The newest commit of each file; of equally new ones the one with the largest id."""
    dated = files.join(commits.select("sha", "ts"), "sha")
    return dated.groupBy("path").agg(F.count_distinct("sha").alias("churn"), F.max(F.struct("ts", "sha")).alias("last")).select("path", "churn", F.col("last.sha").alias("last_commit_sha"), F.col("last.ts").alias("last_commit_ts"))


def age_days(ts: Column, as_of: str) -> Column:
    return F.greatest(F.datediff(F.lit(as_of).cast("date"), ts.cast("date")), F.lit(0))


def hotspot(churn: Column, most: Column, age: Column, decay: float = DECAY) -> Column:
    return churn / F.greatest(most, F.lit(1)) * F.exp(-decay * age)


def git_stats(files: DataFrame, commits: DataFrame, as_of: str) -> DataFrame:
    """path, churn, age_days, last_commit_sha, last_commit_ts, hotspot."""
    last = materialize(last_commit(files, commits), "last")  # one row a file, read twice
    most = last.agg(F.max("churn").alias("most"))  # one row
    out = last.withColumn("age_days", age_days(F.col("last_commit_ts"), as_of)).crossJoin(F.broadcast(most))
    return out.withColumn("hotspot", hotspot(F.col("churn"), F.col("most"), F.col("age_days"))).drop("most")


def pair_support(files: DataFrame) -> DataFrame:
    """(file_a, file_b, support) with file_a < file_b: commits that hold both. The mass-commit limit bounds a commit's pairs."""
    once = files.select("sha", "path").distinct()
    a, b = once.withColumnRenamed("path", "file_a"), once.withColumnRenamed("path", "file_b")
    return a.join(b, "sha").where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("support"))


def with_strength(pairs: DataFrame, churn: DataFrame) -> DataFrame:
    """strength: share of the rarer file's commits; strength_rev: share of file_b's. Files without history count as one commit."""
    side = lambda name: churn.select(F.col("path").alias(name), F.col("churn").alias(f"{name}_churn"))
    out = pairs.join(side("file_a"), "file_a", "left").join(side("file_b"), "file_b", "left")
    a, b = (F.greatest(F.coalesce(f"{x}_churn", F.lit(1)), F.lit(1)) for x in ("file_a", "file_b"))
    return out.select("file_a", "file_b", "support", (F.col("support") / F.least(a, b)).alias("strength"), (F.col("support") / b).alias("strength_rev"))


def coupled(cochange: DataFrame, path: str, strength: float = 0.3, support: int = 5) -> DataFrame:
    """Partners of a file, strongest first."""
    own = cochange.where((F.col("file_a") == path) | (F.col("file_b") == path)).where(F.col("support") >= support).where((F.col("strength") >= strength) | (F.col("strength_rev") >= strength))
    return own.select(F.when(F.col("file_a") == path, F.col("file_b")).otherwise(F.col("file_a")).alias("partner"), "support", "strength", "strength_rev").orderBy(F.desc("strength"), "partner")


def hotspots(stats: DataFrame, n: int = 20, include_tests: bool = False) -> DataFrame:
    """The hottest files; tests are left out before the cut."""
    rows = stats if include_tests else stats.where(~scalars.is_test_path(F.col("path")))
    return rows.orderBy(F.desc("hotspot"), F.desc("churn"), "path").limit(n)


def merge_incremental(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add new churn to old and keep the later last commit: (path, churn, last_commit_sha, last_commit_ts)."""
    rows = old.select("path", "churn", "last_commit_sha", "last_commit_ts").unionByName(new.select("path", "churn", "last_commit_sha", "last_commit_ts"))
    return rows.groupBy("path").agg(F.sum("churn").alias("churn"), F.max(F.struct("last_commit_ts", "last_commit_sha")).alias("last")).select("path", "churn", "last.last_commit_sha", "last.last_commit_ts")
