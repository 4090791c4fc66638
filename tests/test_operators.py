"""Operators on small literal tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.operators import analysis, graph, linking, mining, spans
from loomgraph.sources import diffs


def values(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_test_paths(spark):
    yes = ["tests/a.rs", "src/tests/b.rs", "a/__tests__/x.js", "spec/x.rb", "x/mocks/m.go", "a_test.go", "b_test.rs", "c.test.ts", "d.spec.js", "FooTest.java", "e_spec.rb", "src\\test\\x.py"]
    no = ["src/main.rs", "protest.rs", "mocks/m.go", "__tests__/x.js", "contest/a.go", "test.rs"]
    df = spark.createDataFrame([(p,) for p in yes + no], "p string").select("p", scalars.is_test_path(F.col("p")).alias("t"))
    assert {r["p"] for r in df.where("t").collect()} == set(yes)


def test_languages_and_labels(spark):
    df = spark.createDataFrame([("a/b.rs",), ("x.tsx",), (".hidden",), ("Makefile",), ("a.yml",), ("a.RS",)], "p string")
    assert [r[0] for r in df.select(scalars.lang_from_path(F.col("p"))).collect()] == ["rust", "typescript", "unknown", "unknown", "yaml", "unknown"]
    ages = spark.createDataFrame([(0,), (1,), (13,), (14,), (59,), (60,), (729,), (730,)], "d int").select(scalars.age_label(F.col("d")))
    assert [r[0] for r in ages.collect()] == ["today", "1 day", "13 days", "2 wks", "8 wks", "2 mo", "24 mo", "2 yr"]
    heat = spark.createDataFrame([(0.8,), (0.6,), (0.4,), (0.2,), (0.05,), (0.04,)], "h double").select(scalars.heat_label(F.col("h")))
    assert [r[0] for r in heat.collect()] == ["🔥 very hot", "🔥 hot", "warm", "mild", "cool", "cold"]
    target = spark.createDataFrame([("src/a.rs:f",), ("a.go:42",), ("mod::f",), ("plain",)], "t string").select(scalars.target_file(F.col("t")), scalars.target_name(F.col("t")))
    assert [tuple(r) for r in target.collect()] == [("src/a.rs", "f"), ("a.go", "42"), (None, "mod::f"), (None, "plain")]


@pytest.mark.parametrize(("hot", "cx", "fanin", "patterns", "want"), [(0.9, 20, 9, [], "HIGH"), (0.9, 20, 0, [], "MEDIUM"), (0.9, 1, 9, [], "MEDIUM"), (0.1, 20, 9, [], "MEDIUM"), (0.1, 1, 0, [], "LOW"), (0.0, 0, 0, ["await", "lock"], "HIGH"), (0.6, 10, 5, [], "LOW")])
def test_risk(spark, hot, cx, fanin, patterns, want):
    df = spark.createDataFrame([(hot, cx, fanin, patterns)], "h double, c int, f int, p array<string>")
    assert df.select(scalars.risk_level(F.col("h"), F.col("c"), F.col("f"), F.col("p"))).first()[0] == want


def test_mining(spark):
    files = spark.createDataFrame([(s, p, "python") for s in range(1, 8) for p in (["a.py", "b.py"] if s < 3 else ["a.py"])] + [(9, f"x{i}.py", "python") for i in range(60)] + [(10, "n.yaml", "yaml")], "sha long, path string, lang string")
    kept = mining.kept_files(files)
    assert values(mining.file_churn(kept)) == [("a.py", 7), ("b.py", 2)]
    pairs = mining.with_strength(mining.pair_support(kept), mining.file_churn(kept))
    assert values(pairs) == [("a.py", "b.py", 2, 1.0, 1.0)]
    commits = spark.sql("select id as sha, timestamp'2024-01-01' + make_interval(0,0,0,cast(id as int)) as ts from range(1, 11)")
    stats = mining.git_stats(kept, commits, "2024-01-10")
    assert [(r["path"], r["churn"], r["age_days"], r["last_commit_sha"]) for r in stats.orderBy("path").collect()] == [("a.py", 7, 2, 7), ("b.py", 2, 7, 2)]
    assert mining.git_stats(kept.where("false"), commits, "2024-01-10").count() == 0
    parts = [mining.last_commit(kept.where(f"sha % 2 = {k}"), commits) for k in (0, 1)]
    assert values(mining.merge_incremental(*parts)) == values(mining.last_commit(kept, commits).select("path", "churn", "last_commit_sha", "last_commit_ts"))


def symbol_table(spark, rows):
    return spark.createDataFrame(rows, "id string, name string, lang string")


def test_linking(spark):
    symbols = symbol_table(spark, [("a", "caller", "rust"), ("b", "one", "rust"), ("c", "other", "go"), ("d", "twin", "rust"), ("e", "twin", "rust"), ("f", "far", "go"), ("g", "far", "java")])
    calls = spark.createDataFrame([("a", n) for n in ("one", "other", "twin", "far", "nowhere")] + [("ghost", "one")], "from_id string, callee string")
    got = values(linking.link(calls, symbols), "from_id", "to_id", "confidence")
    assert got == sorted([("a", "b", 0.7), ("a", "c", 0.5), ("a", "d", 0.3), ("a", "e", 0.3), ("a", "external:nowhere", 0.0), ("a", "f", 0.2), ("a", "g", 0.2), ("ghost", "b", 0.5)])
    fans = {r["id"]: (r["fanin"], r["fanout"]) for r in linking.fan_counts(linking.merge_edges(linking.link(calls, symbols))).collect()}
    assert fans["a"] == (0, 7) and fans["b"] == (2, 0) and fans["external:nowhere"] == (1, 0)


def edge_table(spark, rows):
    return spark.createDataFrame([(a, b, "calls", c) for a, b, c in rows], "from_id string, to_id string, kind string, confidence double")


def test_traversal(spark):
    edges = edge_table(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 0.2), ("c", "a", 1.0), ("c", "d", 0.5), ("x", "y", 1.0)])
    assert values(graph.reachable(edges, "a", 1)) == [("a", 0, 1.0), ("b", 1, 1.0), ("c", 1, 0.2)]
    assert values(graph.reachable(edges, "a", 3)) == [("a", 0, 1.0), ("b", 1, 1.0), ("c", 1, 1.0), ("d", 2, 0.5)]
    assert values(graph.reachable(edges, "a", 3, 0.6)) == [("a", 0, 1.0), ("b", 1, 1.0), ("c", 2, 1.0)]
    assert values(graph.reachable(edges, "d", 1, reverse=True)) == [("c", 1, 0.5), ("d", 0, 1.0)]


@pytest.mark.parametrize(("end", "depth", "conf", "want"), [("a", 3, 0.0, ["a"]), ("b", 3, 0.0, ["a", "b"]), ("d", 3, 0.0, ["a", "b", "d"]), ("z", 3, 0.0, []), ("e", 2, 0.0, []), ("e", 3, 0.0, ["a", "b", "d", "e"]), ("d", 3, 0.6, [])])
def test_shortest_path(spark, end, depth, conf, want):
    edges = edge_table(spark, [("a", "b", 1.0), ("a", "c", 1.0), ("c", "d", 0.5), ("b", "d", 0.5), ("d", "e", 1.0)])
    assert [r["id"] for r in graph.shortest_path(edges, "a", end, depth, conf).orderBy("step").collect()] == want


def test_spans(spark):
    symbols = spark.createDataFrame([("o", "f", 1, 100), ("i", "f", 10, 20), ("g", "g", 1, 5)], "id string, path string, span_start int, span_end int")
    points = spark.createDataFrame([("f", 15), ("f", 70), ("f", 100), ("f", 101), ("g", 6)], "path string, line int")
    assert values(spans.enclosing(points, symbols, ["path", "line"])) == [("f", 15, "i"), ("f", 70, "o"), ("f", 100, "o")]
    hunks = spark.createDataFrame([(1, "f", 12, 200), (1, "f", 13, 1), (2, "f", 64, 0), (3, "f", 101, 5)], "sha long, path string, new_start int, new_len int")
    churn = spans.span_churn(symbols, hunks)
    assert values(churn) == [("g", 0), ("i", 1), ("o", 2)]
    captures = spark.createDataFrame([("f", 15, "lock"), ("f", 16, "lock"), ("f", 90, "await")], "path string, line int, kind string")
    assert values(spans.attribute(captures, symbols).select("id", "patterns")) == [("i", ["lock"]), ("o", ["await", "lock"])]


def test_diffs(spark):
    text = ["b/src/a.rs\n@@ -10,3 +10,4 @@ fn\n+x\n@@ -20,1 +21,0 @@", "b/lib.go\n@@ -3,1 +3,1 @@\n@@ -7,0 +8,1 @@\n@@ -1 +1 @@"]
    lines = spark.createDataFrame([(t,) for t in text], "section string")
    found = spans.diff_lines(diffs.hunks_from_diff(lines))
    assert values(found) == sorted([("src/a.rs", n, False) for n in range(10, 14)] + [("lib.go", 1, False), ("lib.go", 3, False), ("lib.go", 8, True)])
    symbols = spark.createDataFrame([("m", "lib.go", 2, 4), ("p", "lib.go", 8, 9), ("u", "lib.go", 20, 30), ("n", "none.go", 1, 9)], "id string, path string, span_start int, span_end int")
    assert values(spans.diff_marks(symbols, found).select("id", "mark")) == [("m", "~"), ("p", "+"), ("u", None)]
    assert dict(values(spans.diff_marks(symbols, found, "~").select("id", "mark")))["u"] == "~"


def test_smells(spark):
    stats = spark.createDataFrame([(f"f{i}", 10 * i + 1, i + 1, 10, 0.1) for i in range(20)] + [("god", 5000, 500, 800, 0.9)], "path string, loc int, churn long, age_days int, hotspot double")
    assert values(analysis.god_file(stats), "path") == [("f19",), ("god",)]
    assert values(analysis.stale_core(stats), "path") == [("god",)]
    pairs = spark.createDataFrame([("hub", f"s{i}", 5, 0.8, 0.8) for i in range(5)], "file_a string, file_b string, support long, strength double, strength_rev double")
    assert values(analysis.shotgun(pairs)) == [("hub", 5)]
    assert analysis.tangled_pair(pairs).count() == 5
    assert values(analysis.missed_partners(pairs, spark.createDataFrame([("hub",), ("s0",)], "path string")), "partner") == [(f"s{i}",) for i in range(1, 5)]
    secure = spark.createDataFrame([("src/auth.rs", "Cargo.toml", 5, 0.9, 0.9)], "file_a string, file_b string, support long, strength double, strength_rev double")
    assert values(analysis.recommend(secure)) == [("cargo audit", "src/auth.rs"), ("semgrep", "Cargo.toml"), ("semgrep", "src/auth.rs")]


def test_semantic_and_custom(spark):
    rows = [("a", ["await", "lock"], {"await": 1, "lock": 1}), ("b", ["loop", "spawn"], {}), ("c", [], {}), ("d", ["alloc"], {"alloc": 3})]
    symbols = spark.createDataFrame([(i, "f", i, p, c, 0.8, 20, 9, 9, 1) for i, p, c in rows], "id string, path string, name string, patterns array<string>, counts map<string,int>, hotspot double, complexity int, fanin int, fanout int, churn int")
    got = {k: [r["id"] for r in analysis.semantic(symbols, k).orderBy("id").collect()] for k in analysis.semantic_rules()}
    assert got["lock_across_await"] == ["a"] and got["spawn_in_tight_loop"] == ["b"] and got["alloc_in_hotspot"] == ["d"] and got["high_complexity_bottleneck"] == ["a", "b", "d"] and got["sync_in_async"] == [] == got["unbalanced_fanout"]
    rules = spark.createDataFrame([("both", ["lock", "await"], "high"), ("half", ["lock", "spawn"], "low")], "name string, patterns array<string>, severity string")
    assert values(analysis.custom(symbols, rules)) == [("both", "high", "a")]


def test_percentile(spark):
    df = spark.createDataFrame([(i,) for i in range(12)], "v int")
    assert {r["percent"]: r["value"] for r in analysis.nearest_rank(df, "v", [0.0, 50.0, 95.0, 100.0]).collect()} == {0.0: 0, 50.0: 6, 95.0: 10, 100.0: 11}
    assert analysis.nearest_rank(df.where("false"), "v", [50.0]).count() == 0


def test_log_of_patches(spark):
    a, b = "a" * 40, "b" * 40
    log = [f"{a}\n\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +3 @@ f\n+++ not a file\n+y\ndiff --git a/y b/y\n--- a/y\n+++ b/y\n@@ -0,0 +1,9 @@\n", f"{b}\n", ""]
    df = spark.createDataFrame([(t,) for t in log], "commit string")
    assert values(diffs.hunks_from_log(df), "sha", "path", "new_start", "new_len", "old_len") == [(a, "x", 3, 1, 2), (a, "y", 1, 9, 0)]
    named = spark.createDataFrame([("",), (f"{a} 5 {b}\n\nx.py\ny.py\n",), (f"{b} 4 \n\nz.py\n",)], "commit string")
    assert values(diffs.changed_files(named)) == [(a, 5, 1, ["x.py", "y.py"]), (b, 4, 0, ["z.py"])]


def test_several_diffs_at_once(spark):
    symbols = spark.createDataFrame([("s", "f", 1, 5), ("t", "f", 6, 9), ("u", "g", 1, 2)], "id string, path string, span_start int, span_end int")
    hunks = spark.createDataFrame([(1, "f", 2, 2, 0), (1, "f", 3, 1, 1), (2, "f", 7, 1, 4), (2, "g", 5, 0, 3)], "pr int, path string, new_start int, new_len int, old_len int")
    lines = spans.diff_lines(hunks, ("pr",))
    assert values(lines) == [(1, "f", 2, True), (1, "f", 3, True), (2, "f", 7, False)]
    marks = spans.diff_marks(symbols, lines, None, ("pr",), hunks)
    assert sorted((r["pr"], r["id"], r["touched"], r["mark"]) for r in marks.collect()) == [(1, "s", 2, "+"), (1, "t", 0, None), (2, "s", 0, None), (2, "t", 1, "~"), (2, "u", 0, None)]
    assert values(spans.diff_weight(marks, lines, ("pr",)).where("weight > 0")) == [(1, "s", 1.0), (2, "t", 1.0)]


def test_targets(spark):
    rows = [("a", "f", "x/m.py", 1, 10), ("b", "f", "y/m.py", 1, 10), ("c", "g", "x/m.py", 3, 4), ("d", "h", "x/m.py", 20, 30)]
    symbols = spark.createDataFrame([(i, n, p, f"{p}:{n}", s, e) for i, n, p, s, e in rows], "id string, name string, path string, qualified string, span_start int, span_end int")
    asked = ["f", "x/m.py:f", "z/q.py:f", "x/m.py:3", "x/m.py:9", "x/m.py:50", "h", "x/m.py:h", "nothing"]
    got = {r["target"]: (r["id"], r["n"]) for r in spans.resolve_targets(spark.createDataFrame([(t,) for t in asked], "target string"), symbols).collect()}
    assert got == {"f": ("a", 2), "x/m.py:f": ("a", 1), "z/q.py:f": ("a", 2), "x/m.py:3": ("c", 1), "x/m.py:9": ("a", 1), "x/m.py:50": (None, 0), "h": ("d", 1), "x/m.py:h": ("d", 1), "nothing": (None, 0)}


def test_missed_and_precise(spark):
    edges = edge_table(spark, [("a", "b", 0.7), ("a", "c", 0.3), ("x", "b", 0.7)])
    truth = spark.createDataFrame([("a", "b"), ("a", "c")], "from_id string, to_id string")
    assert values(analysis.precision(edges, truth)) == [(2, 1, 2)]
    calls = spark.createDataFrame([("a", "n"), ("q", "n")], "from_id string, callee string")
    assert values(analysis.missed_callers(calls, spark.createDataFrame([("b", "n")], "id string, name string"), edges)) == [("q", "b")]


def test_percentiles_of_many_values(spark):
    df = spark.range(5000).selectExpr("cast(id * id % 4999 as double) / 7 as v")
    rows = sorted(r["v"] for r in df.collect())
    got = {r["percent"]: r["value"] for r in analysis.nearest_rank(df, "v", [0.0, 12.5, 50.0, 95.0, 100.0]).collect()}
    assert got == {p: rows[int(p / 100 * 4999 + 0.5)] for p in got} and len(got) == 5
