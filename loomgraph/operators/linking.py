"""From raw call names to call edges with confidence, and what follows from edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXTERNAL, UNRESOLVED = "external:", "unresolved:"
UNIQUE_LANG, MANY_LANG, UNIQUE_ANY, MANY_ANY = 0.7, 0.3, 0.5, 0.2


def link(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, confidence, resolution) for (from_id, callee).

    A name is looked up among symbols of the caller's language; if there is none,
    among all symbols; if there is none either, it is external. All candidates get
    an edge. Callers that are not symbols have no language.
    """
    callers = symbols.select(F.col("id").alias("from_id"), F.col("lang").alias("caller_lang"))
    located = calls.join(callers, "from_id", "left").withColumn("caller_lang", F.coalesce("caller_lang", F.lit("")))
    # candidates are counted once for each name, before they meet the calls
    per_lang = symbols.groupBy("name", "lang").agg(F.count("*").alias("n_lang"))
    per_name = per_lang.groupBy("name").agg(F.sum("n_lang").alias("n_any"))
    known = located.join(per_lang.select(F.col("name").alias("callee"), F.col("lang").alias("caller_lang"), "n_lang"), ["callee", "caller_lang"], "left").join(per_name.withColumnRenamed("name", "callee"), "callee", "left")
    near = known.where("n_lang is not null").join(symbols.select(F.col("name").alias("callee"), F.col("lang").alias("caller_lang"), F.col("id").alias("to_id")), ["callee", "caller_lang"])
    far = known.where("n_lang is null and n_any is not null").join(symbols.select(F.col("name").alias("callee"), F.col("id").alias("to_id")), "callee")
    out = known.where("n_any is null").select("from_id", F.concat(F.lit(EXTERNAL), "callee").alias("to_id"), F.lit(0.0).alias("confidence"), F.lit("external").alias("resolution"))
    for rows, n, unique, many in ((near, "n_lang", UNIQUE_LANG, MANY_LANG), (far, "n_any", UNIQUE_ANY, MANY_ANY)):
        one = F.col(n) == 1
        out = out.unionByName(rows.select("from_id", "to_id", F.when(one, unique).otherwise(many).alias("confidence"), F.when(one, "resolved").otherwise("ambiguous").alias("resolution")))
    return out.select("from_id", "to_id", F.lit("calls").alias("kind"), "confidence", "resolution")


def contains_edges(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.concat(F.lit("file:"), "path").alias("from_id"), F.col("id").alias("to_id"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"))


def import_edges(imports: DataFrame) -> DataFrame:
    """From (path, import)."""
    return imports.select(F.md5("path").alias("from_id"), F.concat(F.lit("import:"), "import").alias("to_id"), F.lit("imports").alias("kind"), F.lit(1.0).alias("confidence")).distinct()


def unresolved_edges(calls: DataFrame) -> DataFrame:
    """Placeholders for (from_id, callee), which linking replaces."""
    return calls.select("from_id", F.concat(F.lit(UNRESOLVED), "callee").alias("to_id"), F.lit("calls").alias("kind"), F.lit(MANY_LANG).alias("confidence"))


def neighbours(edges: DataFrame, symbols: DataFrame, start: str, least: float = 0.0, reverse: bool = False) -> DataFrame:
    """(id, name, confidence): symbols one call away."""
    a, b = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    near = edges.where((F.col("kind") == "calls") & (F.col(a) == start) & (F.col("confidence") >= least))
    return symbols.join(near, F.col("id") == F.col(b)).select("id", "name", "confidence")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (from, to, kind), with the highest confidence; placeholders go."""
    return edges.where(~F.col("to_id").startswith(UNRESOLVED)).groupBy("from_id", "to_id", "kind").agg(F.max("confidence").alias("confidence"))


def fan_counts(edges: DataFrame) -> DataFrame:
    """(id, fanin, fanout) over call edges; ids that are no symbols count too."""
    calls = edges.where("kind = 'calls'")
    ends = calls.select(F.col("from_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(calls.select(F.col("to_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("fanin"), F.sum("o").alias("fanout"))


def with_fans(symbols: DataFrame, fans: DataFrame) -> DataFrame:
    return symbols.join(fans, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("fanin", "fanout")})


def external_callees(edges: DataFrame) -> DataFrame:
    rows = edges.where(F.col("to_id").startswith(EXTERNAL))
    return rows.select("from_id", F.substring("to_id", len(EXTERNAL) + 1, 1 << 30).alias("name"))
