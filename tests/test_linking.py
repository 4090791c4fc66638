"""Factored call edges and imports against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import factored, graph, imports, linking
from loomgraph.plans import adapter


def random_program(seed, n=40):
    rng = random.Random(seed)
    paths = ["src/net/http.py", "src/net/__init__.py", "src/util/text.py", "lib/util/text.py", "pkg/db/open.go", "pkg/db/close.go", "src/main.rs", "src/net/http.rs"]
    lang = lambda p: {"py": "python", "go": "go", "rs": "rust"}[p.rsplit(".", 1)[1]]
    symbols = []
    for i in range(n):
        p = rng.choice(paths)
        symbols.append((f"s{i:02d}", f"n{rng.randrange(9)}", p, lang(p)))
    calls = [(rng.choice([s[0] for s in symbols] + ["stranger"]), f"n{rng.randrange(12)}") for _ in range(90)]
    told = [(p, x) for p in paths for x in rng.sample(["net.http", "util/text", "crate::net::http::n1", "github.com/x/pkg/db", "os", "lib.util.text", "../util/text.py", ".http", "src.net"], 3)]
    return symbols, calls, told


@pytest.mark.parametrize("seed", [1, 2])
def test_factored_edges_are_the_edges(spark, seed):
    symbols, calls, _ = random_program(seed)
    own = spark.createDataFrame([(a, b, d) for a, b, _, d in symbols], "id string, name string, lang string")
    raw = spark.createDataFrame(calls, "from_id string, callee string").distinct()
    edges = linking.merge_edges(linking.link(raw, own))
    few = factored.link(raw, own)
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)
    assert rows(factored.expand(few), "from_id", "to_id", "confidence") == rows(edges, "from_id", "to_id", "confidence")
    assert rows(factored.fan_counts(few), "id", "fanin", "fanout") == rows(linking.fan_counts(edges), "id", "fanin", "fanout")
    for start, back, least in (("s00", False, 0.0), ("s03", True, 0.0), ("s05", False, 0.2), ("external:n10", True, 0.0)):
        got, want = factored.reachable(few, start, 3, least, back), graph.reachable(edges, start, 3, least, back)
        near = lambda df: [(a, b, round(c, 9)) for a, b, c in rows(df, "id", "depth", "path_conf")]
        assert near(got) == near(want)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_relinking_what_changed_gives_the_full_build(spark, seed):
    """Random symbols and calls come, go and change language."""
    rng = random.Random(seed)
    frames = lambda s, c: (spark.createDataFrame(c, "from_id string, callee string"), spark.createDataFrame([(a, b, d) for a, b, _, d in s], "id string, name string, lang string"))
    symbols, calls, _ = random_program(seed)
    state, old = frames(symbols, calls), None
    old = factored.link(*state)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for _ in range(2):
        symbols = [(a, b, p, rng.choice(["go", "rust"]) if rng.random() < 0.1 else x) for a, b, p, x in symbols if rng.random() > 0.1]
        symbols += [(f"t{rng.randrange(1000)}", f"n{rng.randrange(11)}", "p", "python")]
        calls = [c for c in calls if rng.random() > 0.1] + [(rng.choice(symbols)[0], f"n{rng.randrange(12)}") for _ in range(6)]
        after = frames(symbols, calls)
        new = factored.relink(old, *after, *state)
        want = factored.link(*after)
        assert rows(new.callers.select(*want.callers.columns)) == rows(want.callers)
        assert rows(new.candidates.select(*want.candidates.columns)) == rows(want.candidates)
        state, old = after, new


def test_nothing_is_linked_again_without_a_change(spark):
    symbols, calls, _ = random_program(5)
    state = spark.createDataFrame(calls, "from_id string, callee string"), spark.createDataFrame([(a, b, d) for a, b, _, d in symbols], "id string, name string, lang string")
    old = factored.link(*state)
    marked = factored.Calls(old.callers.withColumn("confidence", F.lit(-1.0)), old.candidates)
    assert factored.relink(marked, *state, *state).callers.where("confidence >= 0").count() == 0


def test_a_hot_name_is_no_product(spark):
    """10,000 callers and 10,000 symbols of one name: 100 million edges, 20,000 rows."""
    n = 10_000
    symbols = spark.range(n).select(F.concat(F.lit("s"), "id").alias("id"), F.lit("get").alias("name"), F.lit("go").alias("lang"))
    raw = spark.range(n).select(F.concat(F.lit("s"), "id").alias("from_id"), F.lit("get").alias("callee"))
    few = factored.link(raw, symbols)
    assert few.callers.count() + few.candidates.count() == 2 * n
    counts = factored.fan_counts(few).agg(F.min("fanin"), F.max("fanin"), F.min("fanout"), F.max("fanout")).first()
    assert tuple(counts) == (n, n, n, n)
    assert factored.reachable(few, "s1", 2).count() == n == factored.reachable(few, "s1", 2, reverse=True).count()


def plain_scopes(path):
    words = path.rsplit(".", 1)[0].split("/")
    folder = words[:-1]
    own = folder if words[-1] in imports.WHOLE_FOLDER else words
    return {"/".join(w[i:]) for w in (own, folder) for i in range(len(w))}


def plain_import(text, scopes):
    import re

    if "/" in text:
        text = re.sub(imports.ENDINGS, "", text)
    words = [w for w in re.split(r"/|::|\.(?!\.)|\\", text) if w not in imports.NO_FOLDER]
    best = None
    for at, w in enumerate((words, words[:-1])):
        for i in range(len(w)):
            if "/".join(w[i:]) in scopes:
                best = max(best or (0, 0, ""), (len(w) - i, -at, "/".join(w[i:])))
    return best and best[2]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_imports_narrow_candidates_as_in_a_loop(spark, seed):
    symbols, calls, told = random_program(seed)
    own = spark.createDataFrame(symbols, "id string, name string, path string, lang string")
    every = set().union(*(plain_scopes(s[2]) for s in symbols))
    visible = defaultdict(set)
    for p, x in told:
        if scope := plain_import(x, every):
            visible[p].add(scope)
    got = imports.import_scopes(spark.createDataFrame(told, "path string, import string"), imports.file_scopes(own))
    assert {(r["path"], r["scope"]) for r in got.collect()} == {(p, s) for p, x in visible.items() for s in x}

    by_id, want = {s[0]: s for s in symbols}, []
    for caller, name in set(calls):
        _, _, path, lang = by_id.get(caller, (None,) * 4)
        named = [s for s in symbols if s[1] == name]
        places = [
            ("file", [s for s in named if s[2] == path], imports.FILE),
            ("import", [s for s in named if s[3] == lang and visible[path] & plain_scopes(s[2])], imports.IMPORT),
            ("language", [s for s in named if s[3] == lang], imports.LANGUAGE),
            ("any", named, imports.ANYWHERE),
        ]
        scope, found, degrees = next((p for p in places if p[1]), ("external", None, None))
        if found is None:
            want.append((caller, f"external:{name}", 0.0, scope, "no symbol of that name"))
        for s in found or ():
            reason = f"several candidates: {scope}" if len(found) > 1 else "another language" if scope == "any" else None
            want.append((caller, s[0], degrees[len(found) > 1], scope, reason))
    linked = imports.link(spark.createDataFrame(calls, "from_id string, callee string"), own, spark.createDataFrame(told, "path string, import string"))
    assert sorted(map(tuple, linked.select("from_id", "to_id", "confidence", "scope", "reason").collect()), key=repr) == sorted(want, key=repr)
    assert {w[3] for w in want} >= {"file", "import", "language", "external"}


def test_linking_nothing(spark):
    none = spark.createDataFrame([], "id string, name string, path string, lang string")
    raw = spark.createDataFrame([("a", "f")], "from_id string, callee string")
    told = spark.createDataFrame([("p", None)], "path string, import string")
    assert [tuple(r)[1:4] for r in imports.link(raw, none, told).collect()] == [("external:f", "calls", 0.0)]
    assert factored.expand(factored.link(raw.where("false"), none)).collect() == []


def test_imports_of_line_items_alike_do_not_go_by_the_order_of_rows(spark, tmp_path):
    """Two first line items of one part: the one with flag R goes first, so its file imports itself."""
    parts = [(1, "a", "Brand#9", "STANDARD", 100.0, 5), (2, "b", "Brand#8", "SMALL", 100.0, 5)]
    items = [(7, 1, 1, "N"), (7, 1, 1, "R"), (7, 2, 2, "N")]
    for at, rows in enumerate((items, items[::-1])):
        folder = str(tmp_path / str(at))
        spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double, p_size int").write.parquet(f"{folder}/part.parquet")
        spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
        got = adapter.Tables(spark, folder).imports.collect()
        assert [tuple(r) for r in got] == [("src/Brand#9/standard.rs", "crate::src::Brand#9::standard")]
