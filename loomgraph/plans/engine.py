"""The engine over a real repository: index it, then ask."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.operators import analysis, factored, graph, linking, mining, spans
from loomgraph.render import trees
from loomgraph.runtime import discard, materialize
from loomgraph.sources import config, diffs, extract, files
from loomgraph.sources.git import Repository
from loomgraph.sources.store import Store


#: Rows of a report that come to the driver.
MOST_ROWS = 10_000


class TargetNotFoundError(LookupError):
    pass


class AmbiguousTargetError(LookupError):
    def __init__(self, target: str, candidates: list[str]):
        super().__init__(f"{target} is ambiguous: {', '.join(candidates)}")
        self.candidates = candidates


class Engine:
    def __init__(self, spark: SparkSession, root: str | Path, place: str | None = None):
        self.spark, self.root = spark, Path(root).resolve()
        self.store, self.repository = Store(spark, root, place), Repository(spark, root)

    # ------------------------------------------------------------- indexing

    def index(self, full: bool = False, git: bool = True, as_of: str | None = None, extractors: dict | None = None, grammar_path: str | None = None) -> dict[str, int]:
        """Mine, extract, link, attribute. Without ``full``, files with unchanged contents keep what was extracted from them, and new commits are added to what was mined. ``grammar_path``: a folder of packs in place of ours."""
        as_of = as_of or datetime.now(UTC).date().isoformat()
        extractors = extract.packs_from(grammar_path) if grammar_path else extractors
        self.store.ignore()
        had = self.store.exists() and not full
        sources = files.read_sources(self.spark, self.root)
        fresh, kept = sources, None
        if had:
            stored = self.store.read("parsed")
            fresh = files.changed_files(sources, stored)
            kept = stored.join(sources.select("path", "file_hash"), ["path", "file_hash"], "left_semi")
        parsed = extract.extract(fresh, extractors).join(fresh.select("path", "file_hash"), "path")
        if kept is not None:
            parsed = parsed.unionByName(kept.select(*parsed.columns))
        self.store.write("parsed", parsed)
        parsed = self.store.read("parsed")
        self.store.write("files", parsed.select("path", "lang", "loc", "file_hash"))
        meta = {"schema_version": "1"}
        hunks = self.spark.createDataFrame([], "sha string, path string, new_start long, new_len int, old_len int")
        if git:
            meta["last_sha"] = self.repository.head()
            before = self.store.meta().get("last_sha") if had else None
            self._mine(as_of, before if before and self.repository.is_ancestor(before) else None)
            hunks = self.store.read("hunks")
        symbols = self._symbols(parsed)
        calls = self._calls(parsed, symbols)
        edges = self._link(calls, symbols, had and self.store.has("callers"))
        imports = linking.import_edges(parsed.select("path", F.explode("imports").alias("import")))
        self.store.write("edges", edges.unionByName(linking.contains_edges(symbols)).unionByName(imports))
        captures = parsed.select("path", F.explode("patterns").alias("p")).select("path", "p.kind", "p.line")
        attributed = spans.attribute(captures, symbols)
        churn = spans.span_hotspot(symbols, spans.span_churn(symbols, hunks)).drop("path")
        rows = symbols.join(churn, "id").join(attributed, "id", "left").withColumn("patterns", F.coalesce("patterns", F.array().cast("array<string>")))
        self.store.write_all({"symbols": rows.withColumn("age_days", F.lit(0)), "meta": self.spark.createDataFrame(list(meta.items()), "key string, value string")})
        stats = extract.extract_stats(parsed).first().asDict()
        return stats | {"edges": self.store.read("edges").count()}

    def _mine(self, as_of: str, since: str | None) -> None:
        """Mine all history, or only the commits after ``since``, whose counts are added to the stored ones."""
        commits, listed = self.repository.history(since)
        kept = mining.kept_files(listed)
        last, pairs = mining.last_commit(kept, commits), mining.pair_support(kept)
        hunks = diffs.hunks_from_log(self.repository.patches(since))
        if since is not None:
            last = mining.merge_incremental(self.store.read("git_stats"), last)
            pairs = self.store.read("cochange").select("file_a", "file_b", "support").unionByName(pairs).groupBy("file_a", "file_b").agg(F.sum("support").alias("support"))
            hunks = self.store.read("hunks").unionByName(hunks)
        most = F.broadcast(last.agg(F.max("churn").alias("most")))  # one row
        stats = last.withColumn("age_days", mining.age_days(F.col("last_commit_ts"), as_of)).crossJoin(most).withColumn("hotspot", mining.hotspot(F.col("churn"), F.col("most"), F.col("age_days"))).drop("most")
        stats = stats.select("path", "churn", "age_days", "last_commit_sha", "last_commit_ts", "hotspot")
        self.store.write_all({"git_stats": stats, "cochange": mining.with_strength(pairs, last.select("path", "churn")), "hunks": hunks})

    @staticmethod
    def _symbols(parsed: DataFrame) -> DataFrame:
        """One symbol for each definition; of equal (path, name, kind) the first in the file."""
        rows = parsed.select("path", "lang", F.explode("defs").alias("d")).select("path", "lang", "d.*")
        rows = rows.withColumn("id", scalars.stable_id(F.col("path"), F.col("name"), F.col("kind"))).withColumn("seq", -F.col("span_start"))
        rows = analysis.latest(rows, ["id"], "seq").drop("seq")
        return rows.withColumn("qualified", F.concat("path", F.lit(":"), "name")).withColumn("loc", F.col("span_end") - F.col("span_start") + 1)

    @staticmethod
    def _calls(parsed: DataFrame, symbols: DataFrame) -> DataFrame:
        calls = parsed.select("path", F.explode("calls").alias("c")).select("path", "c.callee", "c.line").distinct()
        return spans.enclosing(calls, symbols, ["path", "line", "callee"]).select(F.col("id").alias("from_id"), "callee").distinct()

    def _link(self, calls: DataFrame, symbols: DataFrame, again: bool) -> DataFrame:
        """Call edges; with ``again`` only what changed since the stored ones is linked."""
        read = self.store.read
        own = materialize(symbols.select("id", "name", "lang"), "linked-symbols")
        raw = materialize(calls, "linked-calls")
        linked = factored.relink(factored.Calls(read("callers"), read("candidates")), raw, own, read("linked_calls"), read("linked_symbols")) if again else factored.link(raw, own)
        self.store.write_all({"callers": linked.callers, "candidates": linked.candidates, "linked_calls": raw, "linked_symbols": own})
        discard(own)
        discard(raw)
        return factored.expand(factored.Calls(read("callers"), read("candidates")))

    # -------------------------------------------------------------- queries

    def symbols(self) -> DataFrame:
        return linking.with_fans(self.store.read("symbols"), linking.fan_counts(self.calls()))

    def calls(self) -> DataFrame:
        return self.store.read("edges").where("kind = 'calls'")

    def file_stats(self) -> DataFrame:
        return self.store.read("files").select("path", "lang", "loc").join(self.store.read("git_stats"), "path")

    def resolve(self, target: str) -> dict:
        """The one symbol that a name, file:name or file:line stands for."""
        rows = self.symbols()
        found = spans.resolve_targets(self.spark.createDataFrame([(target,)], "target string"), rows).first()
        if not found["n"]:
            raise TargetNotFoundError(target)
        if found["n"] > 1:
            name = target.rsplit(":", 1)[-1]
            near = rows.where((F.col("name") == name) | (F.col("name") == target) | (F.col("qualified") == target)).select("qualified", "kind").distinct().orderBy("qualified").limit(50)
            raise AmbiguousTargetError(target, [f"{r['qualified']}  ({r['kind']})" for r in near.collect()])
        return rows.where(F.col("id") == found["id"]).first().asDict()

    def paths(self, target: str, depth: int = 3, min_confidence: float = 0.0) -> DataFrame:
        return graph.reachable(self.calls(), self.resolve(target)["id"], depth, min_confidence, unique=True)

    def callers(self, target: str, depth: int = 3) -> DataFrame:
        return graph.reachable(self.calls(), self.resolve(target)["id"], depth, reverse=True, unique=True)

    def path_to(self, target: str, end: str, depth: int = 3, min_confidence: float = 0.0) -> DataFrame:
        return graph.shortest_path(self.calls(), self.resolve(target)["id"], self.resolve(end)["id"], depth, min_confidence, unique=True)

    def signals(self, target: str, end: str, depth: int = 3) -> DataFrame:
        steps = self.path_to(target, end, depth)
        return analysis.signals(steps.join(self.symbols(), "id"), linking.external_callees(self.calls()))

    def tree(self, target: str, depth: int = 3, min_confidence: float = 0.0, reverse: bool = False, weight: str = "none", most: int = MOST_ROWS) -> trees.Node:
        """The depth-first tree below a symbol: its first ``most`` rows in preorder."""
        start, symbols = self.resolve(target), self.symbols()
        rows = graph.tree(self.calls(), symbols.select("id", "qualified"), start["id"], depth, min_confidence, reverse, unique=True).where(F.col("number") < most)
        info = symbols.select("id", "name", "qualified", "path", "span_start", "span_end")
        if weight != "none":
            info = info.join(analysis.symbol_weights(symbols).select("id", F.col(f"w_{weight}").alias("weight")), "id")
        return trees.from_rows(rows.join(info, "id", "left").orderBy("number").collect())  # at most ``most`` rows

    def best_paths(self, target: str, end: str, k: int = 20, depth: int = 3, min_confidence: float = 0.0) -> DataFrame:
        """The ``k`` best ways from one symbol to another."""
        return graph.best_paths(self.calls(), self.resolve(target)["id"], self.resolve(end)["id"], k, depth, min_confidence, unique=True)

    def beyond(self, target: str, depth: int, reverse: bool = False) -> int:
        """Nodes that one more level would add."""
        start = self.resolve(target)["id"]
        known = self.symbols().select("id")
        count = lambda d: graph.reachable(self.calls(), start, d, reverse=reverse, unique=True).join(known, "id", "left_semi").count()
        return count(depth + 1) - count(depth)

    def external_edges(self) -> int:
        return self.calls().where(F.col("to_id").startswith(linking.EXTERNAL)).count()

    def hotspots(self, n: int = 20, include_tests: bool = False) -> DataFrame:
        rows = mining.hotspots(self.file_stats(), n, include_tests)
        return rows.withColumn("heat", scalars.heat_label(F.col("hotspot"))).withColumn("age", scalars.age_label(F.col("age_days")))

    def coupled(self, target: str, strength: float = 0.3, support: int = 5) -> DataFrame:
        path = target if not self.store.read("files").where(F.col("path") == target).isEmpty() else self.resolve(target)["path"]
        return mining.coupled(self.store.read("cochange"), path, strength, support)

    def age(self) -> DataFrame:
        return self.file_stats().select("path", "age_days").orderBy(F.desc("age_days"), "path")

    def map(self, n: int = 50, weight: str = "churn") -> DataFrame:
        rows = analysis.map_files(self.symbols(), analysis.symbol_weights(self.symbols()), f"w_{weight}")
        return rows.orderBy(F.desc("weight"), "path").limit(n)

    def smells(self, support: int = 5) -> DataFrame:
        """(section, kind, subject, detail)."""
        stats, pairs, symbols = self.file_stats(), self.store.read("cochange").where(F.col("support") >= support), self.symbols()
        limits, rules = config.thresholds(self.store.folder), config.custom_rules(self.store.folder)
        row = lambda df, section, kind, subject, detail: df.select(F.lit(section).alias("section"), kind.alias("kind"), subject.alias("subject"), detail.cast("string").alias("detail"))
        out = row(analysis.shotgun(pairs), "structural", F.lit("shotgun"), F.col("path"), F.col("partners"))
        out = out.unionByName(row(analysis.god_file(stats), "structural", F.lit("god_file"), F.col("path"), F.col("loc")))
        out = out.unionByName(row(analysis.stale_core(stats), "structural", F.lit("stale_core"), F.col("path"), F.col("age_days")))
        out = out.unionByName(row(analysis.tangled_pair(pairs), "structural", F.lit("tangled_pair"), F.col("file_a"), F.col("file_b")))
        out = out.unionByName(row(analysis.findings(symbols, limits).join(symbols.select("id", "qualified"), "id"), "semantic", F.col("kind"), F.col("qualified"), F.col("path")))
        if rules:
            custom = analysis.custom(symbols, self.spark.createDataFrame(rules, "name string, patterns array<string>, severity string"))
            out = out.unionByName(row(custom.join(symbols.select("id", "qualified"), "id"), "custom", F.col("rule"), F.col("qualified"), F.col("severity")))
        return out.unionByName(row(analysis.recommend(pairs), "recommendation", F.col("tool"), F.col("path"), F.lit("")))

    def explain(self, target: str, support: int = 5) -> dict:
        symbol = self.resolve(target)
        notes = analysis.explain(self.symbols().where(F.col("id") == symbol["id"])).first().asDict()
        partners = [r.asDict() for r in mining.coupled(self.store.read("cochange"), symbol["path"], 0.0, support).limit(5).collect()]
        return symbol | notes | {"cochange": partners}

    def _changes(self, *revisions: str) -> DataFrame:
        return spans.diff_ranges(diffs.hunks_from_diff(self.repository.diff(*revisions)))

    def diff(self, *revisions: str, untouched: str | None = None) -> DataFrame:
        """Marks and weights of the symbols of changed files; default: HEAD against the working tree."""
        changes, symbols = self._changes(*(revisions or ("HEAD",))), self.symbols()
        marks = spans.diff_marks(symbols, changes, untouched)
        return marks.join(spans.diff_weight(marks, changes), "id").join(symbols.select("id", "name", "qualified"), "id")

    def branch(self, name: str, base: str = "main") -> DataFrame:
        return self.diff(self.repository.merge_base(base, name), name, untouched="~")

    def explain_pr(self, name: str, base: str = "main", strength: float = 0.5, support: int = 5) -> dict:
        start = self.repository.merge_base(base, name)
        changed = self.repository.changed(start, name)
        paths = self.spark.createDataFrame([(p,) for p in changed], "path string")
        own = self.symbols().join(paths, "path", "left_semi")
        high = own.where(scalars.high_risk(F.col("hotspot"), F.col("complexity"), F.col("fanin"), F.col("patterns"))).select("qualified", "hotspot", "complexity", "fanin").limit(MOST_ROWS).collect()
        missed = analysis.missed_partners(self.store.read("cochange"), paths, strength, support).orderBy(F.desc("strength"), "partner").limit(MOST_ROWS).collect()
        patterns = own.select(F.explode("patterns").alias("p")).groupBy("p").count().orderBy(F.desc("count"), "p").collect()
        dangerous = not own.where(scalars.dangerous(F.col("patterns"))).isEmpty()
        verdict = "HIGH" if dangerous or len(high) > 5 else "MEDIUM" if high or len(missed) > 3 else "LOW"
        return {"changed": changed, "symbols": own.count(), "high_risk": [r.asDict() for r in high], "missed": [r.asDict() for r in missed], "patterns": {r["p"]: r["count"] for r in patterns}, "verdict": verdict}
