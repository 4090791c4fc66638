"""Hunk headers, patch logs and diffs as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OLD, NEW = r"-(\d+)(?:,(\d+))?", r"\+(\d+)(?:,(\d+))?"


def parse_hunk(line: Column) -> Column:
    """struct(old_start, old_len, new_start, new_len) of a "@@ -a,b +c,d @@" line; a length that is left out is 1."""
    part = lambda pattern, k: F.regexp_extract(line, r"^@@ .*?" + pattern, k)
    size = lambda pattern: F.coalesce(F.nullif(part(pattern, 2), F.lit("")), F.lit("1")).cast("int")
    return F.struct(part(OLD, 1).cast("bigint").alias("old_start"), size(OLD).alias("old_len"), part(NEW, 1).cast("bigint").alias("new_start"), size(NEW).alias("new_len"))


def _hunks(sections: DataFrame, section: str, *keep: str) -> DataFrame:
    """(keep, path, new_start, new_len, old_len) of sections, each a file's part of a diff.

    The path is what "+++ " names before the first hunk, or else the first line. Lines of a
    hunk begin with a sign, so no text of a file is taken for a header or a hunk.
    """
    head = F.element_at(F.split(section, "(?m)^@@ ", 2), 1)
    named = F.regexp_extract(head, r"(?m)^\+\+\+ ([^\n\t]*)", 1)
    path = F.regexp_replace(F.when(named != "", named).otherwise(F.element_at(F.split(head, "\n", 2), 1)), "^b/", "")
    hunks = F.filter(F.split(section, "\n"), lambda x: x.startswith("@@ "))
    return sections.select(*keep, path.alias("path"), F.explode(hunks).alias("line")).withColumn("h", parse_hunk(F.col("line"))).select(*keep, "path", "h.new_start", "h.new_len", "h.old_len")


def hunks_from_log(commits: DataFrame) -> DataFrame:
    """(sha, path, new_start, new_len, old_len) from a patch log, a row for each commit: its hash on the first line, then its diff, a part for each file, which begins with "diff --git ". Commits are split each by itself, without a shuffle."""
    rows = commits.select(F.regexp_extract("commit", "^([0-9a-f]{40})", 1).alias("sha"), F.explode(F.slice(F.split("commit", "(?m)^diff --git "), 2, 1 << 30)).alias("section")).where("sha <> ''")
    return _hunks(rows, "section", "sha")


def hunks_from_diff(sections: DataFrame) -> DataFrame:
    """(path, new_start, new_len, old_len) from a diff (section): a row for each file's part."""
    return _hunks(sections, "section")


def changed_files(commits: DataFrame) -> DataFrame:
    """(sha, epoch, n_parents, paths) from a log with names, a row for each commit: hash, time and parents on the first line, then paths."""
    lines = F.filter(F.split("commit", "\n"), lambda x: x != "")
    head = F.split(F.element_at(lines, 1), " ")
    rows = commits.where("commit rlike '^[0-9a-f]{40} '").select(head.alias("head"), F.slice(lines, 2, 1 << 30).alias("paths"))
    return rows.select(F.col("head")[0].alias("sha"), F.col("head")[1].cast("bigint").alias("epoch"), F.size(F.filter(F.slice("head", 3, 1 << 30), lambda x: x != "")).alias("n_parents"), "paths")
