"""Call edges as caller -> name -> candidates.

A name with c callers and s symbols is c + s rows here, where edges are c x s. All callers
of a name in one scope (their own language, or any where that has no such symbol) have the same
candidates and the same confidence, so a traversal goes from callers to the best product of
each name, and from there to candidates: two joins on equality, no row for each pair.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import linking
from loomgraph.runtime import discard, materialize

#: The scope of callers that look everywhere.
ANYWHERE = "*"


class Calls(NamedTuple):
    """``callers``: (from_id, name, scope, n, confidence), n the number of candidates, 0 for external names; ``candidates``: (name, scope, id)."""

    callers: DataFrame
    candidates: DataFrame


def link(calls: DataFrame, symbols: DataFrame) -> Calls:
    """As :func:`linking.link`, for (from_id, callee) and symbols (id, name, lang)."""
    callers = asking(calls, symbols)
    return Calls(callers, asked(callers, symbols))


def asking(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """``callers``: calls go to their callers once, and are made distinct there; candidates are counted by name."""
    per_lang = symbols.groupBy(F.col("name").alias("callee"), F.col("lang").alias("caller_lang")).agg(F.count("*").alias("n_lang"))
    per_name = per_lang.groupBy("callee").agg(F.sum("n_lang").alias("n_any"))
    own = symbols.select(F.col("id").alias("from_id"), F.col("lang").alias("caller_lang"))
    located = calls.distinct().join(own, "from_id", "left").withColumn("caller_lang", F.coalesce("caller_lang", F.lit("")))
    known = located.join(per_lang, ["callee", "caller_lang"], "left").join(per_name, "callee", "left")
    near, n = F.col("n_lang").isNotNull(), F.coalesce("n_lang", "n_any", F.lit(0))
    confidence = F.when(n == 0, 0.0).when(near, F.when(n == 1, linking.UNIQUE_LANG).otherwise(linking.MANY_LANG)).otherwise(F.when(n == 1, linking.UNIQUE_ANY).otherwise(linking.MANY_ANY))
    return known.select("from_id", F.col("callee").alias("name"), F.when(near, F.col("caller_lang")).otherwise(ANYWHERE).alias("scope"), n.alias("n"), confidence.alias("confidence"))


def asked(callers: DataFrame, symbols: DataFrame) -> DataFrame:
    """``candidates``: a symbol is one in its own language and, where somebody looks there, anywhere."""
    scopes = callers.where("n > 0").select("name", "scope").distinct()
    both = symbols.select("name", F.col("id"), F.explode(F.array(F.col("lang"), F.lit(ANYWHERE))).alias("scope"))
    return both.join(scopes, ["name", "scope"], "left_semi").select("name", "scope", "id")


def _not_in(rows: DataFrame, others: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that ``others`` don't have, nulls being equal."""
    names = [f"__{c}" for c in columns]
    keys = others.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True))).distinct()
    return rows.join(keys, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(n)) for c, n in zip(columns, names, strict=True))), "left_anti")


def relink(old: Calls, calls: DataFrame, symbols: DataFrame, calls_before: DataFrame, symbols_before: DataFrame) -> Calls:
    """What :func:`link` gives for ``calls`` and ``symbols``, from what it gave for those before.

    Only calls whose outcome can differ are linked again: new ones, those of names that gained or
    lost a symbol (one candidate may have become several, or one again), and those of callers
    that are new, gone or of another language. All other rows are kept as they are.
    """
    both, pair = ["id", "name", "lang"], ["from_id", "callee"]
    now, then = symbols.select(*both).distinct(), symbols_before.select(*both).distinct()
    moved = materialize(_not_in(now, then, both).unionByName(_not_in(then, now, both)), "moved")
    calls = calls.select(*pair).distinct()
    fresh, gone = _not_in(calls, calls_before, pair), _not_in(calls_before.select(*pair).distinct(), calls, pair)
    names, ids = moved.select(F.col("name").alias("callee")).distinct(), moved.select(F.col("id").alias("from_id")).distinct()
    again = materialize(fresh.unionByName(calls.join(names, "callee", "left_semi").select(*pair)).unionByName(calls.join(ids, "from_id", "left_semi").select(*pair)).distinct(), "again")
    gone = materialize(gone, "gone")
    # callers' languages, and all symbols of the names in question
    asked = again.select(F.col("callee").alias("name")).distinct()
    near = symbols.join(asked, "name", "left_semi").select(*both).unionByName(symbols.join(again.select(F.col("from_id").alias("id")).distinct(), "id", "left_semi").select(*both)).distinct()
    part = link(again, near)
    done = again.unionByName(gone).select("from_id", F.col("callee").alias("name"))
    callers = materialize(_not_in(old.callers, done, ["from_id", "name"]).unionByName(part.callers), "callers")
    touched = done.select("name").unionByName(moved.select("name")).distinct()
    wanted = callers.where("n > 0").join(touched, "name", "left_semi").select("name", "scope").distinct()
    own = symbols.join(touched, "name", "left_semi").select("name", "id", F.explode(F.array("lang", F.lit(ANYWHERE))).alias("scope"))
    candidates = old.candidates.join(touched, "name", "left_anti").select("name", "scope", "id").unionByName(own.join(wanted, ["name", "scope"], "left_semi").select("name", "scope", "id"))
    return Calls(callers, candidates)


def expand(calls: Calls) -> DataFrame:
    """(from_id, to_id, kind, confidence): the edges themselves."""
    inside = calls.callers.where("n > 0").join(calls.candidates, ["name", "scope"]).select("from_id", F.col("id").alias("to_id"), "confidence")
    outside = calls.callers.where("n = 0").select("from_id", F.concat(F.lit(linking.EXTERNAL), "name").alias("to_id"), "confidence")
    return inside.unionByName(outside).select("from_id", "to_id", F.lit("calls").alias("kind"), "confidence")


def fan_counts(calls: Calls) -> DataFrame:
    """(id, fanin, fanout) of the edges, which are counted, not made."""
    out = calls.callers.groupBy(F.col("from_id").alias("id")).agg(F.sum(F.greatest("n", F.lit(1))).cast("long").alias("o"))
    asked = calls.callers.where("n > 0").groupBy("name", "scope").agg(F.count("*").alias("c"))
    inward = calls.candidates.join(asked, ["name", "scope"]).groupBy("id").agg(F.sum("c").cast("long").alias("i"))
    external = calls.callers.where("n = 0").groupBy(F.concat(F.lit(linking.EXTERNAL), "name").alias("id")).agg(F.count("*").alias("i"))
    ends = out.select("id", F.lit(0).cast("long").alias("i"), "o").unionByName(inward.unionByName(external).withColumn("o", F.lit(0).cast("long")))
    return ends.groupBy("id").agg(F.sum("i").alias("fanin"), F.sum("o").alias("fanout"))


def stats(calls: Calls, once: bool = True) -> DataFrame:
    """(resolution, confidence, n): linked rows, a call with several candidates being several, which are counted, not made.

    ``once``: no two symbols have one id; else calls of what is external are made distinct first.
    """
    callers = calls.callers if once else calls.callers.where("n > 0").unionByName(calls.callers.where("n = 0").distinct())
    resolution = F.when(F.col("n") == 0, "external").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return callers.groupBy(resolution.alias("resolution"), "confidence").agg(F.sum(F.greatest("n", F.lit(1))).cast("long").alias("n"))


def _level(calls: Calls, frontier: DataFrame, reverse: bool) -> DataFrame:
    """(b, new_conf): the nodes one call away from ``frontier`` (id, path_conf), with the best product."""
    best = F.max(F.col("path_conf") * F.col("confidence")).alias("v")
    names = calls.callers.select("from_id", "name", "scope", "n", "confidence")
    if not reverse:
        met = frontier.join(names, F.col("id") == F.col("from_id")).groupBy("name", "scope", "n").agg(best)
        inside = met.where("n > 0").join(calls.candidates.withColumnRenamed("id", "b"), ["name", "scope"]).select("b", "v")
        outside = met.where("n = 0").select(F.concat(F.lit(linking.EXTERNAL), "name").alias("b"), "v")
    else:
        held = frontier.join(calls.candidates, "id").groupBy("name", "scope").agg(F.max("path_conf").alias("path_conf"))
        inside = held.join(names.where("n > 0"), ["name", "scope"]).select(F.col("from_id").alias("b"), (F.col("path_conf") * F.col("confidence")).alias("v"))
        out = names.where("n = 0").withColumn("id", F.concat(F.lit(linking.EXTERNAL), "name"))
        outside = frontier.join(out, "id").select(F.col("from_id").alias("b"), (F.col("path_conf") * F.col("confidence")).alias("v"))
    return inside.unionByName(outside).groupBy("b").agg(F.max("v").alias("new_conf"))


def reachable(calls: Calls, start: str, depth: int = 3, min_confidence: float = 0.0, reverse: bool = False) -> DataFrame:
    """(id, depth, path_conf), as :func:`graph.reachable` gives it for the edges."""
    spark = calls.callers.sparkSession
    known = levels = spark.range(1).select(F.lit(start).alias("id"), F.lit(0).alias("depth"), F.lit(1.0).alias("path_conf"))
    for level in range(1, depth + 1):
        found = _level(calls, known.select("id", "path_conf"), reverse).where(F.col("new_conf") >= min_confidence)
        old = levels.groupBy("id").agg(F.max("path_conf").alias("old_conf"))
        better = found.join(old, F.col("b") == F.col("id"), "left").where("old_conf is null or new_conf > old_conf")
        known = materialize(better.select(F.col("b").alias("id"), F.lit(level).alias("depth"), F.col("new_conf").alias("path_conf")), "frontier")
        if known.isEmpty():
            discard(known)
            break
        levels = levels.unionByName(known)
    return levels.groupBy("id").agg(F.min("depth").alias("depth"), F.max("path_conf").alias("path_conf"))
