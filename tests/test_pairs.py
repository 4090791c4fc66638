"""Queries on many calls of one name: no table has a row for each call and candidate."""

from __future__ import annotations

from pathlib import Path

import pyarrow.parquet as pq
import pytest

from loomgraph.plans.queries import QUERIES

N = 300


def star(spark, folder, parts):
    """Parts, and orders of two line items: part k calls part k + 1."""
    n = len(parts)
    tables = {
        "part": (parts, "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double, p_size int"),
        "lineitem": ([(k, line, (k + line) % n, float(line + 4), "N") for k in range(n) for line in (0, 1)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string"),
        "orders": ([(k, k % 50, "F") for k in range(n)], "o_orderkey long, day int, o_orderstatus string"),
        "documents": ([(k, "that thing with this") for k in range(n)], "doc_id long, text string"),
        "conversations": ([(k, 1, "from the motion") for k in range(n)], "conv_id long, turn int, text string"),
        "customer": ([(k,) for k in range(n)], "c_custkey long"),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.selectExpr("o_orderkey", "timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(day) AS o_orderdate", "o_orderstatus")
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """All parts have one name and one file: 90,000 edges."""
    return star(spark, tmp_path_factory.mktemp("hot"), [(k, "get", "Brand#4", "MEDIUM", 100.0 + k, 5) for k in range(N)])


@pytest.fixture
def written(monkeypatch, tmp_path):
    """Rows of the largest table that was written to the shared folder."""
    monkeypatch.setattr("loomgraph.runtime.shared_dir", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr("loomgraph.plans.adapter._INDEX", {})
    yield lambda: max((sum(pq.read_metadata(f).num_rows for f in d.glob("*.parquet")) for d in Path(tmp_path).iterdir()), default=0)


#: Queries by the number of their finding.
COUNTED = {
    "F2": "callees",
    "F4": "explain_symbol",
    "F5": "external_callees",
    "F6": "fan_counts",
    "F7": "index_counts",
    "F9": "map_files",
    "F11": "pattern_summary",
    "F12": "precision_gate",
    "F14": "smell_alloc_hotspot",
    "F15": "smell_bottleneck",
    "F16": "smell_by_file",
    "F17": "smell_by_kind",
    "F18": "smell_custom",
    "F19": "smell_fanout",
    "F20": "smell_findings",
    "F21": "symbol_weights",
    "F24": "callers_1hop",
}


@pytest.mark.parametrize("name", COUNTED.values())
def test_no_table_of_pairs(spark, hot, written, name):
    QUERIES[name](spark, hot).collect()
    assert written() <= 10 * N


def test_linked_rows_are_counted(spark, hot, written):
    """90,000 rows in one class, from 300 callers, without a join that makes them."""
    got = QUERIES["link_stats"](spark, hot)
    assert [tuple(r) for r in got.collect()] == [("ambiguous", 0.3, N * N)]
    assert 0 < written() <= 10 * N
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_external_calls_of_a_repeated_id_count_once(spark):
    from loomgraph.operators import factored

    own = spark.createDataFrame([("a", "f", "go"), ("a", "f", "rust")], "id string, name string, lang string")
    calls = factored.link(spark.createDataFrame([("a", "nowhere")], "from_id string, callee string"), own)
    assert [tuple(r) for r in factored.stats(calls, once=False).collect()] == [("external", 0.0, 1)]


def test_rules_meet_sets_of_patterns(spark):
    """3,000 rules and 3,000 symbols that all of them hold for: counted without a row for each pair."""
    from pyspark.sql import functions as F

    from loomgraph.operators import analysis

    n = 3000
    symbols = spark.range(n).select(F.col("id").cast("string").alias("id"), F.array(F.lit("lock"), F.lit("loop")).alias("patterns"))
    rules = spark.range(n).select(F.col("id").cast("string").alias("name"), F.array(F.lit("loop"), F.lit("lock")).alias("patterns"), F.lit("low").alias("severity"))
    extra = rules.limit(1).select(F.lit("none").alias("name"), F.array(F.lit("spawn")).alias("patterns"), "severity").unionByName(rules.limit(1).select(F.lit("any").alias("name"), F.array().cast("array<string>").alias("patterns"), "severity"))
    got = analysis.custom_counts(symbols, rules.unionByName(extra))
    assert {(r["rule"], r["n"]) for r in got.collect()} == {(str(k), n) for k in range(n)} | {("any", n)}


@pytest.mark.parametrize("name", ["diff_lines", "diff_marks", "branch_marks", "diff_weight"])
def test_rows_of_a_diff_meet_no_shuffle(spark, hot, name):
    """Lines, and symbols of changed files, become rows after the last shuffle of what is grouped, not before."""
    plan = QUERIES[name](spark, hot)._jdf.queryExecution().optimizedPlan().toString()
    made = plan.index("Generate explode")
    assert made < min(plan.index(x) for x in ("Aggregate", "Window") if x in plan) or name == "diff_weight" and made < plan.index("Window")


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_and_marks_of_diffs_as_in_a_loop(spark, seed):
    """Two keys, overlapping hunks, diffs without a key, files that are not told."""
    import random

    from loomgraph.operators import spans

    rng = random.Random(seed)
    hunks = [(rng.choice([1, 2, None]), rng.choice("ab"), rng.choice("fgh"), rng.randrange(1, 40), rng.randrange(4), rng.randrange(2)) for _ in range(40)]
    symbols = [(f"s{k}", rng.choice("fgh"), a, a + rng.randrange(6)) for k, a in enumerate(rng.sample(range(1, 40), 12))]
    told = sorted({(h[0], h[1], h[2]) for h in hunks if rng.random() < 0.8}, key=repr)
    lines = {}
    for pr, side, path, start, n, old in hunks:
        for line in range(start, start + n):
            lines[pr, side, path, line] = lines.get((pr, side, path, line), False) or old == 0
    frame = spark.createDataFrame(hunks, "pr int, side string, path string, new_start long, new_len long, old_len long")
    own = spark.createDataFrame(symbols, "id string, path string, span_start long, span_end long")
    got = spans.diff_lines(frame, ("pr", "side")).collect()
    assert {tuple(r)[:4]: r["pure"] for r in got} == lines and len(got) == len(lines)
    want = set()
    for pr, side, path in told:
        for id_, own_path, a, b in symbols:
            if own_path == path:
                hit = [lines[pr, side, path, x] for x in range(a, b + 1) if (pr, side, path, x) in lines and pr is not None]
                want.add((pr, side, id_, path, len(hit), sum(hit)))
    files = spark.createDataFrame(told, "pr int, side string, path string")
    marks = spans.diff_marks(own, spans.diff_ranges(frame, ("pr", "side")), None, ("pr", "side"), files).drop("mark").collect()
    assert set(map(tuple, marks)) == want and len(marks) == len(want)


@pytest.mark.parametrize("most", [0, 1000])
def test_round_trips_as_in_a_loop(spark, written, most):
    """By broadcast and by shuffle; 60 symbols of three names in two files, no table of edges."""
    from loomgraph.operators import factored, patterns

    symbols = [(f"s{k}", f"n{k % 3}", "go", "fg"[k % 2]) for k in range(60)]
    said = [(f"s{k}", f"n{(k + j) % 3}") for k in range(0, 60, 2) for j in (0, 1)]
    own = spark.createDataFrame(symbols, "id string, name string, lang string, file string")
    calls = factored.link(spark.createDataFrame(said, "from_id string, callee string"), own)
    edges = [(a, s[0]) for a, name in said for s in symbols if s[1] == name]
    file = {s[0]: s[3] for s in symbols}
    onto = {}
    for a, b in edges:
        onto.setdefault(a, []).append(b)
    want = sorted((file[a], a, b, c) for a, b in edges for c in onto.get(b, ()) if file[c] == file[a])
    got = patterns.round_trips(calls, own.select("file", "id"), 0.3, most)
    assert sorted(map(tuple, got.collect())) == want
    assert written() <= 200 < len(edges)
