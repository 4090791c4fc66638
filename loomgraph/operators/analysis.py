"""Percentiles, smells, signals, risk, explanations, overviews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars


#: Ranges of distinct values for exact percentiles.
PARTS = 64


@dataclass(frozen=True)
class Thresholds:
    hotspot_high: float = 0.7
    hotspot_medium: float = 0.5
    complexity_high: int = 10
    fanin_high: int = 8


def nearest_rank(df: DataFrame, value: str, percents: list[float]) -> DataFrame:
    """(percent, value): the value at place round(percent / 100 * (n - 1)), halves up.

    Exact, whatever the number of distinct values: these are dealt to ``PARTS`` ranges
    at sampled borders, the counts of whole ranges say which range holds a place, and
    running counts are made within ranges.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    borders = counts.agg(F.percentile_approx("v", [k / PARTS for k in range(1, PARTS)], 100 * PARTS).alias("borders"))  # one row
    ranged = counts.crossJoin(F.broadcast(borders)).select("v", "n", F.size(F.filter("borders", lambda b: b < F.col("v"))).alias("part"))
    parts = ranged.groupBy("part").agg(F.sum("n").alias("n"))  # PARTS rows at most
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    upto = ranged.select("v", "part", F.sum("n").over(Window.partitionBy("part").orderBy("v")).alias("within")).join(F.broadcast(before), "part")
    at = upto.select("v", (F.col("before") + F.col("within")).alias("upto"), "total", F.explode(F.array(*map(F.lit, percents))).alias("percent"))
    return at.where(F.col("upto") > F.round(F.col("percent") / 100 * (F.col("total") - 1))).groupBy("percent").agg(F.min("v").alias("value"))


def _bar(df: DataFrame, value: str, percent: float, name: str) -> DataFrame:
    return F.broadcast(nearest_rank(df, value, [percent]).select(F.col("value").alias(name)))  # one row


def shotgun(cochange: DataFrame, strength: float = 0.5, partners: int = 4) -> DataFrame:
    strong = cochange.where((F.col("strength") >= strength) | (F.col("strength_rev") >= strength))
    sides = strong.select(F.col("file_a").alias("path")).unionAll(strong.select("file_b"))
    return sides.groupBy("path").agg(F.count("*").alias("partners")).where(F.col("partners") >= partners)


def god_file(stats: DataFrame, percent: float = 95.0) -> DataFrame:
    rows = stats.crossJoin(_bar(stats, "loc", percent, "p_loc")).crossJoin(_bar(stats, "churn", percent, "p_churn"))
    return rows.where("loc >= p_loc and churn >= p_churn").select("path", "loc", "churn")


def stale_core(stats: DataFrame, days: int = 730, percent: float = 90.0) -> DataFrame:
    return stats.crossJoin(_bar(stats, "churn", percent, "p_churn")).where((F.col("age_days") >= days) & (F.col("churn") >= F.col("p_churn"))).select("path", "age_days", "churn")


def tangled_pair(cochange: DataFrame, strength: float = 0.8) -> DataFrame:
    return cochange.where((F.col("strength") >= strength) & (F.col("strength_rev") >= strength)).select("file_a", "file_b", "strength", "strength_rev")


def semantic_rules(t: Thresholds = Thresholds()) -> dict[str, Column]:
    """Conditions on symbols with patterns, pattern counts and fan counts."""
    has = lambda p: F.array_contains("patterns", p)
    return {
        "lock_across_await": has("lock") & has("await"),
        "sync_in_async": has("block_on"),
        "alloc_in_hotspot": (F.coalesce(F.col("counts")["alloc"], F.lit(0)) > 2) & (F.col("hotspot") > t.hotspot_high),
        "high_complexity_bottleneck": (F.col("complexity") > t.complexity_high) & (F.col("fanin") > t.fanin_high) & (F.col("hotspot") > t.hotspot_medium),
        "spawn_in_tight_loop": has("spawn") & has("loop"),
        "unbalanced_fanout": (F.col("fanout") > 8) & (F.col("fanin") < 2) & (F.col("churn") < 3),
    }


def semantic(symbols: DataFrame, kind: str, t: Thresholds = Thresholds()) -> DataFrame:
    return symbols.where(F.size("patterns") > 0).where(semantic_rules(t)[kind]).select("id", "path", "name")


def findings(symbols: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(kind, id, path) of all semantic smells in one pass."""
    kinds = F.array_compact(F.array(*(F.when(rule, kind) for kind, rule in semantic_rules(t).items())))
    return symbols.where(F.size("patterns") > 0).select(F.explode(kinds).alias("kind"), "id", "path")


def custom(symbols: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, severity, id): all of a rule's patterns are present. ``rules``: (name, patterns, severity), any number of them.

    A rule is filed under its rarest pattern and meets the symbols that have that one,
    which are then looked at for the others. A rule without patterns holds for every symbol with some.
    """
    some = symbols.where(F.size("patterns") > 0).select("id", "patterns")
    held = some.select("id", "patterns", F.explode(F.concat(F.array_distinct("patterns"), F.array(F.lit("")))).alias("filed"))
    counts = some.select(F.explode(F.array_distinct("patterns")).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    asked = rules.where("patterns is not null").select(F.col("name").alias("rule"), F.array_distinct("patterns").alias("wanted"), "severity").withColumn("rule_row", F.monotonically_increasing_id())
    each = asked.select("rule", "wanted", "severity", "rule_row", F.explode_outer("wanted").alias("pattern")).join(counts, "pattern", "left")
    # an equality needs a value: rules without patterns are filed under the empty string
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pattern", F.lit("")).alias("pattern")))
    filed = each.groupBy("rule_row", "rule", "severity", "wanted").agg(rarest.alias("r")).where("r.n > 0 or size(wanted) = 0").select("rule", "severity", "wanted", F.col("r.pattern").alias("filed"))
    return held.join(filed, "filed").where(F.size(F.array_except("wanted", "patterns")) == 0).select("rule", "severity", "id")


def custom_counts(symbols: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, n): symbols for which a rule holds, where some do. Sets of patterns meet sets that rules want, each once, not symbols and rules."""
    as_set = F.array_sort(F.array_distinct("patterns"))
    sets = symbols.select(as_set.alias("patterns")).groupBy("patterns").agg(F.count("*").alias("n")).select(F.struct("patterns", "n").alias("id"), "patterns")
    named = rules.where("patterns is not null").select(F.col("name").alias("named"), as_set.alias("wanted"))
    wanted = named.select(F.col("wanted").alias("name"), F.col("wanted").alias("patterns"), F.lit("").alias("severity")).distinct()
    counts = custom(sets, wanted).groupBy(F.col("rule").alias("wanted")).agg(F.sum("id.n").alias("n"))
    return named.join(counts, "wanted").groupBy(F.col("named").alias("rule")).agg(F.sum("n").alias("n"))


def recommend(cochange: DataFrame, strength: float = 0.4) -> DataFrame:
    """(tool, path): what to run on files that change together with security-related ones."""
    rows = cochange.where((F.col("strength") >= strength) | (F.col("strength_rev") >= strength)).withColumn("a", scalars.is_security_path(F.col("file_a"))).withColumn("b", scalars.is_security_path(F.col("file_b"))).where("a or b")
    rows = rows.select(F.when(F.col("a"), F.col("file_a")).otherwise(F.col("file_b")).alias("secure"), F.when(F.col("a"), F.col("file_b")).otherwise(F.col("file_a")).alias("other"))
    manifest = rows.where(F.col("other").endswith("Cargo.toml") | F.col("other").endswith("Cargo.lock")).select(F.lit("cargo audit").alias("tool"), F.col("secure").alias("path"))
    both = rows.select(F.lit("semgrep").alias("tool"), F.explode(F.array("secure", "other")).alias("path"))
    return manifest.unionByName(both).distinct()


def top_by_kind(found: DataFrame, n: int = 3) -> DataFrame:
    return found.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("path", "id"))).where(F.col("n") <= n)


def symbol_weights(symbols: DataFrame) -> DataFrame:
    """loc, churn, hotspot and fanin weights, each 0 to 1."""
    most = F.broadcast(symbols.agg(*(F.greatest(F.max(c), F.lit(1)).alias(f"m_{c}") for c in ("loc", "churn", "fanin"))))  # one row
    return symbols.crossJoin(most).select("id", *((F.col(c) / F.col(f"m_{c}")).alias(f"w_{c}") for c in ("loc", "churn", "fanin")), F.col("hotspot").alias("w_hotspot"))


def file_weights(stats: DataFrame) -> DataFrame:
    most = F.broadcast(stats.agg(*(F.greatest(F.max(c), F.lit(1)).alias(f"m_{c}") for c in ("loc", "churn"))))  # one row
    return stats.crossJoin(most).select("path", *((F.col(c) / F.col(f"m_{c}")).alias(f"w_{c}") for c in ("loc", "churn")), F.col("hotspot").alias("w_hotspot"))


def map_files(symbols: DataFrame, weights: DataFrame, weight: str = "w_churn") -> DataFrame:
    """(path, n_symbols, weight): a file weighs what its weightiest symbol weighs."""
    return symbols.select("id", "path").join(weights, "id").groupBy("path").agg(F.count("*").alias("n_symbols"), F.max(weight).alias("weight"))


def explain(symbols: DataFrame) -> DataFrame:
    """Words for a symbol's numbers."""
    return symbols.select(
        "id",
        scalars.steps(F.col("hotspot"), "cold", ((0.2, "lukewarm"), (0.5, "warm"), (0.8, "very hot"))).alias("heat"),
        scalars.steps(F.col("complexity"), "low", ((5, "moderate"), (10, "high"), (20, "very high")), strict=True).alias("complexity_note"),
        scalars.steps(F.col("fanin"), "unused", ((1, "one place"), (2, "a few places"), (6, "many places"))).alias("fanin_note"),
        scalars.steps(F.col("fanout"), "leaf", ((1, "a few"), (4, "moderate"), (9, "many"))).alias("fanout_note"),
        scalars.risk_level(F.col("hotspot"), F.col("complexity"), F.col("fanin"), F.col("patterns")).alias("risk"),
    )


def missed_partners(cochange: DataFrame, changed: DataFrame, strength: float = 0.5, support: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, partner, strength): files that usually change with a changed one and didn't. ``keys`` tell several sets of changed files apart."""
    rows = cochange.where(F.col("support") >= support).withColumn("s", F.greatest("strength", "strength_rev")).where(F.col("s") >= strength)
    sides = rows.select(F.col("file_a").alias("path"), F.col("file_b").alias("partner"), "s").unionAll(rows.select("file_b", "file_a", "s"))
    changed = changed.select(*keys, "path").distinct()
    return sides.join(changed, "path").join(changed.withColumnRenamed("path", "partner"), [*keys, "partner"], "left_anti").groupBy(*keys, "partner").agg(F.max("s").alias("strength"))


def missed_callers(calls: DataFrame, symbols: DataFrame, edges: DataFrame, least: float = 0.6) -> DataFrame:
    """(from_id, to_id): callers that name a symbol, but have no edge of ``least`` confidence to it."""
    named = calls.join(symbols.select(F.col("name").alias("callee"), F.col("id").alias("to_id")), "callee").select("from_id", "to_id").distinct()
    return named.join(edges.where(F.col("confidence") >= least), ["from_id", "to_id"], "left_anti")


def precision(edges: DataFrame, truth: DataFrame, least: float = 0.7) -> DataFrame:
    """(found, correct, wanted): edges of ``least`` confidence, those of them that ``truth`` (from_id, to_id) has, and all that it has."""
    sure = edges.where(F.col("confidence") >= least).select("from_id", "to_id")
    found = sure.agg(F.count("*").alias("found")).crossJoin(sure.intersect(truth.select("from_id", "to_id")).agg(F.count("*").alias("correct")))
    return found.crossJoin(truth.agg(F.count("*").alias("wanted")))  # one row each


def reviews(symbols: DataFrame, files: DataFrame, cochange: DataFrame, strength: float = 0.5, support: int = 5) -> DataFrame:
    """(pr, n_high, n_missed, verdict) for changed ``files`` (pr, path)."""
    risk = scalars.high_risk(F.col("hotspot"), F.col("complexity"), F.col("fanin"), F.col("patterns"))
    per_file = symbols.groupBy("path").agg(F.count_if(risk).alias("n_high"), F.bool_or(scalars.dangerous(F.col("patterns"))).alias("danger"))
    high = files.join(per_file, "path", "left").groupBy("pr").agg(F.coalesce(F.sum("n_high"), F.lit(0)).alias("n_high"), F.coalesce(F.bool_or("danger"), F.lit(False)).alias("danger"))
    missed = missed_partners(cochange, files, strength, support, ("pr",)).groupBy("pr").agg(F.count("*").alias("n_missed"))
    both = high.join(missed, "pr", "left").withColumn("n_missed", F.coalesce("n_missed", F.lit(0)))
    return both.select("pr", "n_high", "n_missed", verdict(F.col("n_high"), F.col("n_missed"), F.col("danger")).alias("verdict"))


def verdict(n_high: Column, n_missed: Column, any_dangerous: Column) -> Column:
    return F.when(any_dangerous | (n_high > 5), "HIGH").when((n_high > 0) | (n_missed > 3), "MEDIUM").otherwise("LOW")


def signals(frames: DataFrame, externals: DataFrame) -> DataFrame:
    """(kind, severity, id) along a call path: ``frames`` has step, id, path, complexity, hotspot, patterns."""
    has = lambda p: F.array_contains("patterns", p)
    whole = frames.agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"), F.max_by("id", "step").alias("last"))  # one row
    rules = (("lock_await", "high", has("lock") & has("await")), ("blocking_async", "high", has("block_on")), ("unbounded_loop", "medium", has("loop")), ("high_complexity", "medium", F.col("complexity") > 10), ("hot_symbol", "medium", F.col("hotspot") > 0.7))
    each = frames.select(F.explode(F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for k, s, c in rules)))).alias("x"), "id").select("x.kind", "x.severity", "id")
    none = F.lit(None).cast("string").alias("id")
    depth = whole.where("n > 0").select(F.lit("path_depth").alias("kind"), F.when(F.col("n") > 5, "medium").otherwise("info").alias("severity"), none)
    cross = whole.where("files > 1").select(F.lit("cross_file_boundary").alias("kind"), F.lit("info").alias("severity"), none)
    outside = whole.join(externals.select(F.col("from_id").alias("last")).distinct(), "last").select(F.lit("external_boundary").alias("kind"), F.lit("info").alias("severity"), F.col("last").alias("id"))
    return depth.unionByName(cross).unionByName(each).unionByName(outside)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: the last writer of each key wins."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("__n = 1").drop("__n")
