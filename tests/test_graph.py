"""Trees, best paths, patterns and baskets against plain loops on random inputs."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import analysis, baskets, graph, patterns, spans
from loomgraph.render import trees
from loomgraph.runtime import shared_dir
from loomgraph.sources import diffs, extract


def plain_tree(root, qualified, edges, depth, least, externals):
    """Depth first: a node is expanded once, where it is first met above ``depth``; rows as (number, depth, id, parent, parent number, confidence)."""
    rows, seen = [], set()

    def grow(at, level, product, confidence, parent):
        me = len(rows)
        rows.append((me, level, at, *parent, confidence))
        if level >= depth or at in seen:
            return
        seen.add(at)
        for to, c in sorted(edges.get(at, ()), key=lambda e: (qualified[e[0]], e[0])):
            if product * c >= least:
                grow(to, level + 1, product * c, c, (at, me))
        for name in sorted(externals.get(at, ())):
            rows.append((len(rows), level + 1, f"external:{name}", at, me, 0.0))

    grow(root, 0, 1.0, 1.0, (None, None))
    return rows


def random_calls(seed, n=12, m=40):
    rng = random.Random(seed)
    ids = [f"s{i:02d}" for i in range(n)]
    edges = {(rng.choice(ids), rng.choice(ids)): rng.choice([0.7, 0.3, 0.5, 0.2]) for _ in range(m)}
    outside = {(rng.choice(ids), x) for x in "pq" for _ in range(4)}
    return ids, edges, outside, {i: f"f{rng.randrange(3)}:{i}" for i in ids}


def call_frame(spark, edges, outside=()):
    rows = [(a, b, "calls", c) for (a, b), c in edges.items()] + [(a, f"external:{x}", "calls", 0.0) for a, x in outside] + [("s00", "s01", "contains", 1.0)]
    return spark.createDataFrame(rows, "from_id string, to_id string, kind string, confidence double")


@pytest.mark.parametrize(("seed", "depth", "least", "reverse"), [(1, 3, 0.0, False), (2, 6, 0.0, False), (3, 5, 0.05, False), (4, 4, 0.0, True)])
def test_trees_are_those_of_a_loop(spark, seed, depth, least, reverse):
    ids, edges, outside, qualified = random_calls(seed)
    symbols = spark.createDataFrame(list(qualified.items()), "id string, qualified string")
    below, beyond = defaultdict(list), defaultdict(list)
    for (a, b), c in edges.items():
        below[b if reverse else a].append((a if reverse else b, c))
    if not reverse:
        for a, x in outside:
            beyond[a].append(x)
    want = plain_tree("s00", qualified, below, depth, least, beyond)
    got = graph.tree(call_frame(spark, edges, outside), symbols, "s00", depth, least, reverse, unique=True)
    rows = got.orderBy("number").collect()
    assert [tuple(r)[:6] for r in rows] == want
    known = symbols.withColumns({"name": F.col("id"), "path": F.lit("f"), "span_start": F.lit(1), "span_end": F.lit(2)})
    root = trees.from_rows(got.join(known, "id", "left").orderBy("number").collect())
    flat = []

    def flatten(node, level):
        flat.append((level, node.id, node.external))
        for c in node.children:
            flatten(c, level + 1)

    flatten(root, 0)
    assert flat == [(r[1], r[2], r[2].startswith("external:")) for r in want]


def test_a_tree_of_a_leaf(spark):
    calls = call_frame(spark, {("a", "b"): 0.5})
    symbols = spark.createDataFrame([("a", "a"), ("b", None)], "id string, qualified string")
    assert [tuple(r) for r in graph.tree(calls, symbols, "b").collect()] == [(0, 0, "b", None, None, 1.0, 1.0)]
    assert [r["id"] for r in graph.tree(calls, symbols, "a").orderBy("number").collect()] == ["a", "b"]


@pytest.mark.parametrize(("seed", "k", "depth", "least", "keep"), [(1, 20, 4, 0.0, None), (2, 7, 5, 0.0, 1), (3, 3, 3, 0.02, None), (4, 1000, 4, 0.0, None)])
def test_best_paths_are_those_of_a_loop(spark, seed, k, depth, least, keep):
    ids, edges, _, _ = random_calls(seed, n=9, m=80)
    found = []

    def walk(path, c):
        if path[-1] == "s05":
            found.append((round(-c, 9), len(path), path, c))
        elif len(path) <= depth:
            for (a, b), w in edges.items():
                if a == path[-1] and b not in path and c * w >= least:
                    walk([*path, b], c * w)

    walk(["s00"], 1.0)
    got = graph.best_paths(call_frame(spark, edges), "s00", "s05", k, depth, least, keep=keep).orderBy("rank").collect()
    assert [(r["rank"], list(r["path"])) for r in got] == [(i, x[2]) for i, x in enumerate(sorted(found)[:k], 1)]
    assert len(found) > 3


def test_no_paths(spark):
    calls = call_frame(spark, {("a", "b"): 0.5, ("c", "d"): 0.5})
    assert graph.best_paths(calls, "a", "d").collect() == [] == graph.best_paths(calls, "a", "a").collect()
    assert [r["path"] for r in graph.best_paths(calls, "a", "b").collect()] == [["a", "b"]]


def tables_left(spark):
    fs, path, _ = __import__("loomgraph.runtime", fromlist=["filesystem"]).filesystem(spark, shared_dir(spark))
    return {str(x.getPath().getName()) for x in fs.listStatus(path)} if fs.exists(path) else set()


def test_traversals_leave_only_what_their_result_reads(spark):
    ids, edges, outside, qualified = random_calls(5)
    calls = call_frame(spark, edges, outside)
    before = tables_left(spark)
    graph.best_paths(calls, "s00", "s05", 3, 4).collect()
    assert tables_left(spark) == before
    graph.tree(calls, spark.createDataFrame(list(qualified.items()), "id string, qualified string"), "s00", 3, unique=True).collect()
    assert {x.split("-")[0] for x in tables_left(spark) - before} <= {"frontier", "numbered"}


# --- patterns


@pytest.mark.parametrize("seed", [1, 2])
def test_patterns_are_those_of_loops(spark, seed):
    rng = random.Random(seed)
    calls = {(rng.randrange(12), rng.randrange(12)) for _ in range(45)}
    held = {(f"f{rng.randrange(3)}", i) for i in range(12)}
    relations = {"calls": spark.createDataFrame(sorted(calls) * 2, "a long, b long"), "held": spark.createDataFrame(sorted(held), "a string, b long")}
    step = patterns.Step
    rows = lambda df: sorted(map(tuple, df.collect()))

    chain = patterns.match([step("x", "y"), step("y", "z")], relations)
    assert rows(chain) == sorted((a, b, d) for (a, b), (c, d) in itertools.product(calls, calls) if b == c)

    ring = patterns.match([step("f", "x", "held"), step("x", "y"), step("y", "z"), step("f", "z", "held")], relations)
    assert rows(ring) == sorted((f, a, b, d) for (a, b), (c, d) in itertools.product(calls, calls) if b == c for f in {h for h, i in held if i == a} & {h for h, i in held if i == d})

    reach = {n: set(calls) if n == 1 else None for n in (1,)}
    for n in (2, 3):
        reach[n] = {(a, d) for (a, b), (c, d) in itertools.product(reach[n - 1], calls) if b == c}
    ends = spark.createDataFrame([(3,), (4,), (5,)], "id long")
    far = patterns.match([step("x", "y", "calls", 2, 3)], relations, {"y": ends})
    assert rows(far) == sorted(p for p in reach[2] | reach[3] if p[1] in (3, 4, 5))
    both = patterns.match([step("x", "y", "calls", 1, 3), step("y", "y")], relations, {"x": ends})
    assert rows(both) == sorted(p for p in reach[1] | reach[2] | reach[3] if p[0] in (3, 4, 5) and (p[1], p[1]) in calls)

    want = sorted((a, b, c) for a, b, c in itertools.permutations(range(12), 3) if {(a, b), (b, c), (c, a)} <= calls and a < b and a < c)
    assert rows(patterns.triangles(relations["calls"])) == want and want
    assert rows(patterns.match([step("x", "y"), step("y", "z"), step("z", "x")], relations).where("x < y and x < z and y <> z")) == want


def test_patterns_of_nothing_and_in_pieces(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert patterns.match([patterns.Step("x", "y"), patterns.Step("y", "z")], {"calls": none}).collect() == []
    assert patterns.triangles(none).collect() == []
    with pytest.raises(ValueError, match="falls apart"):
        patterns.match([patterns.Step("x", "y"), patterns.Step("u", "v")], {"calls": none})


def test_a_hub_makes_no_wedges(spark):
    """3,000 callers and callees of one node would be 9 million two-step walks."""
    edges = [(0, i) for i in range(1, 3001)] + [(i, 0) for i in range(3001, 6001)] + [(1, 3001), (0, 3001)]
    got = patterns.triangles(spark.createDataFrame(edges, "a long, b long"))
    assert [tuple(r) for r in got.collect()] == [(0, 1, 3001)]


# --- baskets


@pytest.mark.parametrize(("block", "sieve"), [(256, 1 << 20), (3, 7)])
def test_pairs_that_many_baskets_have(spark, block, sieve):
    rng = random.Random(3)
    rows = [(b, f"i{min(rng.randrange(30), rng.randrange(30))}") for b in range(60) for _ in range(rng.randrange(1, 15))] + [(1, "i0"), (1, "i0"), (None, "i1"), (2, None)]
    by = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            by[b].add(i)
    counts = Counter(p for items in by.values() for p in itertools.combinations(sorted(items), 2))
    got = baskets.pair_support(spark.createDataFrame(rows, "basket long, item string"), 5, block, sieve)
    assert sorted(map(tuple, got.collect())) == sorted((a, b, n) for (a, b), n in counts.items() if n >= 5)


def test_a_large_basket_is_cut_into_chunks(spark):
    rows = spark.range(2000).selectExpr("1 as basket", "id as item").unionByName(spark.range(3).selectExpr("2 as basket", "id as item"))
    cut = baskets.frequent_rows(rows.unionAll(rows.withColumn("basket", F.lit(3))), 1, block=100)
    assert cut.where("basket = 1").agg(F.max("chunks")).first()[0] == 20
    assert baskets.pairs(cut.where("basket = 1")).count() == 2000 * 1999 // 2


# --- rules, diffs


def test_many_rules(spark):
    rng = random.Random(2)
    kinds = [f"k{i}" for i in range(12)]
    symbols = [(f"s{i}", rng.sample(kinds, rng.randrange(6))) for i in range(60)]
    rules = [(f"r{i}", [rng.choice([*kinds, "none"]) for _ in range(rng.randrange(4))], "low") for i in range(300)] + [("same", ["k1"], "low"), ("same", ["k1"], "low"), ("null", None, "low")]
    got = analysis.custom(spark.createDataFrame(symbols, "id string, patterns array<string>"), spark.createDataFrame(rules, "name string, patterns array<string>, severity string"))
    assert Counter(map(tuple, got.collect())) == Counter((n, s, i) for n, p, s in rules if p is not None for i, have in symbols if have and set(p) <= set(have))


def test_ranges_of_a_diff_are_its_lines(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(2), f"f{rng.randrange(3)}", rng.randrange(1, 60), rng.choice([0, 1, 2, 9]), rng.choice([0, 1])) for _ in range(80)]
    hunks = spark.createDataFrame(rows, "pr int, path string, new_start int, new_len int, old_len int")
    symbols = spark.createDataFrame([(f"s{i}", f"f{i % 3}", 3 * i + 1, 3 * i + 1 + i % 7) for i in range(30)], "id string, path string, span_start int, span_end int")
    lines, ranges = spans.diff_lines(hunks, ("pr",)), spans.diff_ranges(hunks, ("pr",))
    told = lambda c: spans.diff_marks(symbols, c, None, ("pr",))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(told(ranges)) == rows(told(lines))
    assert rows(spans.diff_weight(told(ranges), ranges, ("pr",))) == rows(spans.diff_weight(told(lines), lines, ("pr",)))
    assert not any("sequence" in x for x in told(ranges)._jdf.queryExecution().analyzed().toString().split("\n") if "new_len" in x)


def test_added_lines_that_look_like_headers(spark):
    a = "a" * 40
    log = f"{a}\n\ndiff --git a/f.md b/f.md\n--- a/f.md\n+++ b/f.md\n@@ -1 +1,2 @@\n--- x\n+++ b/evil.md\n+@@ -1 +1 @@\n@@ -9,0 +11 @@\n+y\ndiff --git a/g b h b/g b h\nnew file mode 100644\n--- /dev/null\n+++ b/g b h\t\n@@ -0,0 +1 @@\n+diff --git a/z b/z\n"
    got = diffs.hunks_from_log(spark.createDataFrame([(log,)], "commit string")).collect()
    assert sorted(map(tuple, got)) == [(a, "f.md", 1, 2, 1), (a, "f.md", 11, 1, 0), (a, "g b h", 1, 1, 0)]
    sections = log.split("\ndiff --git ")[1:]
    got = diffs.hunks_from_diff(spark.createDataFrame([(x,) for x in sections], "section string")).collect()
    assert sorted(map(tuple, got)) == [("f.md", 1, 2, 1), ("f.md", 11, 1, 0), ("g b h", 1, 1, 0)]


def test_appended_patterns_keep_the_rest_of_a_pack():
    code = "impl Thing {\n    fn act(&self) {\n        let s = \"call(1)\";\n        special_thing();\n    }\n}\n"
    plain, more = extract.EXTRACTORS["rust"](code), extract.extended({"rust": (("special", r"special_thing"),)})["rust"](code)
    assert (plain.defs, plain.calls, plain.imports) == (more.defs, more.calls, more.imports)
    assert [p for p in more.patterns if p not in plain.patterns]


def test_the_index_follows_the_folder(spark, tmp_path):
    from loomgraph.plans import queries

    def write(n):
        part = [(i, f"p{i % 5}", "Brand#4", "STANDARD", 5, 10.0) for i in range(n)]
        spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
        items = [(i // 3, i % n, i % 3 + 1) for i in range(3 * n)]
        spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
        spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([], "conv_id long, turn long, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")

    edges = lambda: queries.QUERIES["edges_merged"](spark, str(tmp_path)).count()
    write(6)
    first = edges()
    assert edges() == first
    write(30)
    assert edges() > first
