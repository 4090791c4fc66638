"""All queries of the engine over a folder of tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import analysis as A
from loomgraph.operators import baskets as B
from loomgraph.operators import factored as C
from loomgraph.operators import graph as G
from loomgraph.operators import imports as I
from loomgraph.operators import linking as L
from loomgraph.operators import mining as M
from loomgraph.operators import patterns as P
from loomgraph.operators import spans as X
from loomgraph.plans.adapter import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Cut-offs that select something on these tables.
STRENGTH, SUPPORT, STALE_DAYS, START, DEPTH, LEAST_CONF = 0.04, 5, 3, "555", 3, 0.2
BEST = 20
STAT = "path, lang, loc, churn, age_days, last_commit_sha, round(hotspot, 6) AS hotspot"
PAIR = "file_a, file_b, support, round(strength, 6) AS strength, round(strength_rev, 6) AS strength_rev"


def query(name: str, oracle: str | None = None) -> Callable:
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if oracle:
            ORACLES[name] = with_tables(oracle)
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def one_of(name: str, values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# ---------------------------------------------------------------- scalars

_LANG = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{v}'" for e, v in S.EXTENSIONS.items()) + " ELSE 'unknown' END"
_TEST = " OR ".join([f"contains(path, '{x}')" for x in S.TEST_INFIXES] + [f"starts_with(path, '{x}')" for x in S.TEST_PREFIXES] + [f"ends_with(path, '{x}')" for x in S.TEST_SUFFIXES])


@query("lang_from_path", f"SELECT path, {_LANG} AS lang FROM (SELECT DISTINCT path, regexp_extract(path, '[^/]\\.([^./]+)$', 1) AS ext FROM symbols0)")
def _(t):
    return t.symbols0.select("path").distinct().withColumn("lang", S.lang_from_path(F.col("path")))


@query("source_files", "SELECT path, lang, loc FROM files WHERE lang NOT IN ('hcl', 'yaml', 'unknown')")
def _(t):
    return t.files.where(S.is_source(F.col("lang")))


@query("is_test_path", f"SELECT path, ({_TEST}) AS is_test FROM files")
def _(t):
    return t.files.select("path", S.is_test_path(F.col("path")).alias("is_test"))


@query("text_loc", "SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS loc FROM documents")
def _(t):
    return t.read("documents").select("doc_id", S.text_loc(F.col("text")).cast("bigint").alias("loc"))


@query("file_fingerprint", "SELECT doc_id, sha256(text) AS file_hash FROM documents")
def _(t):
    return t.read("documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))


@query("stable_id", "SELECT id, md5(concat_ws(chr(1), path, name, kind)) AS stable_id FROM symbols0")
def _(t):
    return t.symbols0.select("id", S.stable_id(F.col("path"), F.col("name"), F.col("kind")).alias("stable_id"))


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def _(t):
    return t.read("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("target_parse", "SELECT id, CASE WHEN id::INT % 2 = 0 THEN path END AS target_file, name AS target_name FROM symbols0")
def _(t):
    target = F.when(F.col("id").cast("int") % 2 == 0, F.concat("path", F.lit(":"), "name")).otherwise(F.col("name"))
    return t.symbols0.withColumn("target", target).select("id", S.target_file(F.col("target")).alias("target_file"), S.target_name(F.col("target")).alias("target_name"))


@query("safe_ids", "SELECT id, left(regexp_replace(path || ':' || name, '[^\\pL\\pN_]', '_', 'g'), 30) AS safe_id FROM symbols0")
def _(t):
    return t.symbols0.select("id", S.safe_id(F.concat("path", F.lit(":"), "name")).alias("safe_id"))


@query("weight_bar", "SELECT path, repeat('█', least(round(hotspot * 6), 6)::INT) || repeat(' ', 6 - least(round(hotspot * 6), 6)::INT) AS bar FROM git_stats")
def _(t):
    return t.git_stats.select("path", S.weight_bar(F.col("hotspot")).alias("bar"))


@query("heat_labels", "SELECT path, CASE WHEN hotspot >= 0.8 THEN '🔥 very hot' WHEN hotspot >= 0.6 THEN '🔥 hot' WHEN hotspot >= 0.4 THEN 'warm' WHEN hotspot >= 0.2 THEN 'mild' WHEN hotspot >= 0.05 THEN 'cool' ELSE 'cold' END AS heat FROM git_stats")
def _(t):
    return t.git_stats.select("path", S.heat_label(F.col("hotspot")).alias("heat"))


@query("age_labels", "SELECT sha, CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN '1 day' WHEN d < 14 THEN d || ' days' WHEN d < 60 THEN d // 7 || ' wks' WHEN d < 730 THEN d // 30 || ' mo' ELSE d // 365 || ' yr' END AS age FROM (SELECT sha, greatest(date_diff('day', ts::DATE, DATE '2001-08-02'), 0) AS d FROM commits)")
def _(t):
    return t.commits.select("sha", S.age_label(M.age_days(F.col("ts"), "2001-08-02")).alias("age"))


@query("hunk_parse", "SELECT sha, new_start, new_len, old_len, count(*) AS n FROM hunks GROUP BY ALL")
def _(t):
    from loomgraph.sources.diffs import parse_hunk

    header = F.concat(F.lit("@@ -1,"), "old_len", F.lit(" +"), "new_start", F.when(F.col("new_len") == 1, "").otherwise(F.concat(F.lit(","), "new_len")), F.lit(" @@ fn x"))
    return t.hunks.select("sha", parse_hunk(header).alias("h")).select("sha", "h.new_start", "h.new_len", "h.old_len").groupBy("sha", "new_start", "new_len", "old_len").agg(F.count("*").alias("n"))


# ----------------------------------------------------------------- mining


@query("commits_scan", "SELECT sha, ts, n_parents FROM commits WHERE n_parents <= 1")
def _(t):
    return M.without_merges(t.commits)


@query("commit_files", "SELECT sha, path, lang FROM commit_files0")
def _(t):
    return t.commit_files0


@query("mass_commit_filter", "SELECT sha, path, lang FROM commit_files")
def _(t):
    return t.commit_files


@query("file_churn", "SELECT path, count(DISTINCT sha) AS churn FROM commit_files GROUP BY path")
def _(t):
    return M.file_churn(t.commit_files)


@query("file_last_commit", "SELECT path, last_commit_sha, last_commit_ts FROM last_commits")
def _(t):
    return M.last_commit(t.commit_files, t.commits).drop("churn")


@query("hotspot_score", "SELECT path, round(hotspot, 6) AS hotspot FROM git_stats")
def _(t):
    return rounded(t.git_stats.select("path", "hotspot"), "hotspot")


@query("git_stats", "SELECT path, churn, age_days, last_commit_sha, last_commit_ts, round(hotspot, 6) AS hotspot FROM git_stats")
def _(t):
    return rounded(t.git_stats, "hotspot")


@query("file_stats", f"SELECT {STAT} FROM file_stats")
def _(t):
    return rounded(t.file_stats, "hotspot").drop("last_commit_ts")


@query("hotspots_top", f"SELECT {STAT} FROM file_stats WHERE NOT ({_TEST}) ORDER BY hotspot DESC, churn DESC, path LIMIT 20")
def _(t):
    return rounded(M.hotspots(t.file_stats, 20), "hotspot").drop("last_commit_ts")


@query("hotspots_with_tests", f"SELECT {STAT} FROM file_stats ORDER BY file_stats.hotspot DESC, churn DESC, path LIMIT 20")
def _(t):
    return rounded(M.hotspots(t.file_stats, 20, include_tests=True), "hotspot").drop("last_commit_ts")


@query("age_view", "SELECT path, age_days FROM file_stats")
def _(t):
    return t.file_stats.select("path", "age_days").orderBy(F.desc("age_days"), "path")


@query("map_pkg_churn", "SELECT path, churn, loc FROM file_stats")
def _(t):
    return t.file_stats.select("path", "churn", "loc").orderBy(F.desc("churn"), "path")


@query("map_rollup", "SELECT split_part(path, '/', 1) AS dir, split_part(path, '/', 2) AS pkg, sum(churn)::BIGINT AS churn, sum(loc)::BIGINT AS loc FROM file_stats GROUP BY ROLLUP (split_part(path, '/', 1), split_part(path, '/', 2))")
def _(t):
    parts = F.split("path", "/")
    return t.file_stats.select(parts[0].alias("dir"), parts[1].alias("pkg"), "churn", "loc").rollup("dir", "pkg").agg(F.sum("churn").alias("churn"), F.sum("loc").alias("loc"))


@query("cochange_pairs", "SELECT file_a, file_b, support FROM pairs")
def _(t):
    return M.pair_support(t.commit_files)


@query("cochange_strength", f"SELECT {PAIR} FROM cochange")
def _(t):
    return rounded(t.cochange, "strength", "strength_rev")


@query("cochange_all", f"SELECT {PAIR} FROM cochange WHERE support >= {SUPPORT}")
def _(t):
    return rounded(t.cochange.where(F.col("support") >= SUPPORT), "strength", "strength_rev")


@query("coupled", f"SELECT CASE WHEN file_a = f THEN file_b ELSE file_a END AS partner, support, round(strength, 6) AS strength, round(strength_rev, 6) AS strength_rev FROM cochange, (SELECT 'src/Brand#10/medium.go' AS f) WHERE f IN (file_a, file_b) AND support >= {SUPPORT} AND (strength >= 0.03 OR strength_rev >= 0.03)")
def _(t):
    return rounded(M.coupled(t.cochange, "src/Brand#10/medium.go", 0.03, SUPPORT), "strength", "strength_rev")


@query("incremental_merge", "SELECT path, churn, last_commit_sha, last_commit_ts FROM last_commits")
def _(t):
    half = [t.commit_files.where(F.col("sha") % 2 == k) for k in (0, 1)]
    return M.merge_incremental(*(M.last_commit(h, t.commits) for h in half))


@query("incremental_changed_files", "SELECT doc_id, sha256(text) AS file_hash FROM documents WHERE doc_id % 10 = 0")
def _(t):
    from loomgraph.sources.files import changed_files

    now = t.read("documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("file_hash"))
    stored = now.withColumn("file_hash", F.when(F.col("path") % 10 == 0, F.lit("stale")).otherwise(F.col("file_hash")))
    return changed_files(now, stored).withColumnRenamed("path", "doc_id")


@query("upsert_files", "SELECT path, lang, CASE WHEN lang = 'go' THEN loc + 1 ELSE loc END AS loc FROM files")
def _(t):
    new = t.files.where("lang = 'go'").withColumn("loc", F.col("loc") + 1).withColumn("seq", F.lit(2))
    return A.latest(t.files.withColumn("seq", F.lit(1)).unionByName(new), ["path"], "seq").drop("seq")


# ---------------------------------------------------------------- symbols


@query("symbols_base", "SELECT id, kind, name, path || ':' || name AS qualified, path, span_start, span_end, lang, loc, complexity FROM indexed")
def _(t):
    return t.indexed.select("id", "kind", "name", F.concat("path", F.lit(":"), "name").alias("qualified"), "path", "span_start", "span_end", "lang", "loc", "complexity")


@query("all_symbols", "SELECT i.id, i.name, i.path, f.loc AS file_loc FROM indexed i JOIN files f USING (path)")
def _(t):
    return t.indexed.select("id", "name", "path").join(t.files.select("path", F.col("loc").alias("file_loc")), "path")


@query("symbols_by_name", "SELECT id, name, path FROM indexed WHERE name = 'red widget Brand#17' OR path || ':' || name = 'src/Brand#4/small.java:blue bolt Brand#4'")
def _(t):
    qualified = F.concat("path", F.lit(":"), "name")
    return t.indexed.where((F.col("name") == "red widget Brand#17") | (qualified == "src/Brand#4/small.java:blue bolt Brand#4")).select("id", "name", "path")


@query("symbol_by_id", f"SELECT id, name, path, span_start, span_end FROM indexed WHERE id = '{START}'")
def _(t):
    return t.indexed.where(F.col("id") == START).select("id", "name", "path", "span_start", "span_end")


@query("symbols_for_file", "SELECT id, name, span_start, span_end FROM indexed WHERE path = 'src/Brand#10/medium.go'")
def _(t):
    return t.indexed.where(F.col("path") == "src/Brand#10/medium.go").select("id", "name", "span_start", "span_end").orderBy("span_start")


@query("symbol_at_line", "SELECT path, line, arg_min(id, (span_end - span_start, span_start, id)) AS id FROM (SELECT DISTINCT path, new_start AS line FROM hunks) h JOIN indexed i USING (path) WHERE line BETWEEN span_start AND span_end GROUP BY ALL")
def _(t):
    points = t.hunks.select("path", F.col("new_start").alias("line")).distinct()
    return X.enclosing(points, t.indexed, ["path", "line"])


@query("enclosing_def", "SELECT capture, path, line, arg_min(id, (span_end - span_start, span_start, id)) AS id FROM (SELECT DISTINCT capture, path, line FROM captures) c JOIN indexed i USING (path) WHERE line BETWEEN span_start AND span_end GROUP BY ALL")
def _(t):
    return X.enclosing(t.captures.select("capture", "path", "line").distinct(), t.indexed, ["capture", "path", "line"])


_TARGETS = "SELECT DISTINCT CASE id::INT % 3 WHEN 0 THEN name WHEN 1 THEN path || ':' || name ELSE path || ':' || span_start END AS target FROM symbols0"


@query(
    "resolve_target",
    f"""WITH t AS (SELECT target, regexp_extract(target, '^(.*):[^:]*$', 1) AS file, regexp_extract(target, ':([^:]*)$', 1) AS part FROM ({_TARGETS})),
p AS (SELECT target, CASE WHEN file <> '' THEN file END AS file, CASE WHEN file <> '' THEN part ELSE target END AS name, regexp_matches(part, '^[0-9]+$') AS is_line FROM t),
c AS (SELECT target, id, path || ':' || s.name AS qualified, coalesce(path = file, false) AS inside FROM p JOIN indexed s ON s.name = p.name OR path || ':' || s.name = target WHERE NOT is_line),
b AS (SELECT target, inside, count(DISTINCT qualified) AS n, arg_min(id, (qualified, id)) AS id FROM c GROUP BY ALL),
f AS (SELECT target, arg_max(id, inside) AS id, arg_max(n, inside) AS n FROM b GROUP BY target
      UNION ALL SELECT target, arg_min(id, (span_end - span_start, span_start, id)), 1 FROM (SELECT * FROM p WHERE is_line) q JOIN indexed s ON s.path = q.file AND q.name::INT BETWEEN span_start AND span_end GROUP BY target)
SELECT p.target, id, coalesce(n, 0)::BIGINT AS n FROM p LEFT JOIN f USING (target)""",
)
def _(t):
    id_ = F.col("id").cast("int") % 3
    target = F.when(id_ == 0, F.col("name")).when(id_ == 1, F.concat("path", F.lit(":"), "name")).otherwise(F.concat("path", F.lit(":"), F.col("span_start").cast("string")))
    return X.resolve_targets(t.symbols0.select(target.alias("target")), t.indexed.withColumn("qualified", F.concat("path", F.lit(":"), "name")))


@query("contains_edges", "SELECT 'file:' || path AS from_id, id AS to_id, 'contains' AS kind, 1.0::DOUBLE AS confidence FROM indexed")
def _(t):
    return L.contains_edges(t.indexed)


@query("import_edges", "SELECT DISTINCT md5(path) AS from_id, 'import:' || lang AS to_id, 'imports' AS kind, 1.0::DOUBLE AS confidence FROM indexed")
def _(t):
    return L.import_edges(t.indexed.select("path", F.col("lang").alias("import")))


@query("unresolved_edges", "SELECT from_id, 'unresolved:' || callee AS to_id, 'calls' AS kind, 0.3::DOUBLE AS confidence FROM raw_calls")
def _(t):
    return L.unresolved_edges(t.raw_calls)


@query("pattern_captures", "SELECT capture, path, line, kind FROM captures")
def _(t):
    return t.captures


@query("pattern_attribution", "SELECT id, array_to_string(patterns, ',') AS patterns FROM patterned")
def _(t):
    return X.attribute(t.captures, t.indexed).select("id", F.array_join("patterns", ",").alias("patterns"))


@query("symbols_with_patterns", "SELECT id, name, array_to_string(patterns, ',') AS patterns FROM symbols WHERE len(patterns) > 0")
def _(t):
    return t.symbols.where(F.size("patterns") > 0).select("id", "name", F.array_join("patterns", ",").alias("patterns"))


@query("symbol_churn", "SELECT id, churn FROM span_churn")
def _(t):
    return X.span_churn(t.indexed, t.hunks)


@query("symbol_hotspot", "SELECT id, churn, round(hotspot, 6) AS hotspot FROM symbols")
def _(t):
    return rounded(X.span_hotspot(t.indexed, X.span_churn(t.indexed, t.hunks)), "hotspot").drop("path")


@query("symbols_enriched", "SELECT id, qualified, churn, round(hotspot, 6) AS hotspot, array_to_string(patterns, ',') AS patterns, fanin, fanout FROM symbols")
def _(t):
    return rounded(t.symbols.select("id", "qualified", "churn", "hotspot", F.array_join("patterns", ",").alias("patterns"), "fanin", "fanout"), "hotspot")


# ------------------------------------------------------------------ graph


@query("link_calls", "SELECT from_id, to_id, confidence::DOUBLE AS confidence, resolution FROM linked WHERE resolution <> 'external'")
def _(t):
    return t.linked.where("resolution <> 'external'").drop("kind")


@query("link_external", "SELECT from_id, to_id FROM linked WHERE resolution = 'external'")
def _(t):
    return t.linked.where("resolution = 'external'").select("from_id", "to_id")


@query("link_stats", "SELECT resolution, confidence::DOUBLE AS confidence, count(*) AS n FROM linked GROUP BY ALL")
def _(t):
    return C.stats(t.factored, t.by_name)


@query("edges_merged", "SELECT from_id, to_id, kind, confidence FROM edges")
def _(t):
    return t.edges


@query("callees", f"SELECT s.id, s.name, e.confidence FROM edges e JOIN indexed s ON s.id = e.to_id WHERE e.from_id = '{START}' AND e.confidence >= 0.3")
def _(t):
    return L.neighbours(t.edges, t.indexed, START, 0.3)


@query("callers_1hop", f"SELECT s.id, s.name, e.confidence FROM edges e JOIN indexed s ON s.id = e.from_id WHERE e.to_id = '{START}' AND e.confidence >= 0.3")
def _(t):
    return L.neighbours(t.edges, t.indexed, START, 0.3, reverse=True)


@query("external_callees", "SELECT from_id, substr(to_id, 10) AS name FROM edges WHERE starts_with(to_id, 'external:')")
def _(t):
    return L.external_callees(t.edges)


@query("fan_counts", "SELECT id, fanin, fanout FROM fans")
def _(t):
    return t.fans


def _walk(depth: int, conf: float, a: str = "from_id", b: str = "to_id") -> str:
    return with_tables("SELECT 1 FROM edges").rsplit(" SELECT 1 FROM edges", 1)[0] + f""", walk AS (SELECT '{START}' AS id, 0 AS depth, 1.0::DOUBLE AS conf
UNION ALL SELECT id, depth, max(conf) AS conf FROM (SELECT {b} AS id, depth + 1 AS depth, conf * confidence AS conf FROM walk JOIN edges ON {a} = walk.id WHERE depth < {depth} AND conf * confidence >= {conf}) GROUP BY ALL)
SELECT id, min(depth) AS depth, round(max(conf), 6) AS path_conf FROM walk GROUP BY id"""


@query("paths_reachable")
def _(t):
    return rounded(t.reachable(START, DEPTH), "path_conf")


@query("paths_min_conf")
def _(t):
    return rounded(t.reachable(START, DEPTH, LEAST_CONF), "path_conf")


@query("callers_reachable")
def _(t):
    return rounded(t.reachable(START, DEPTH, reverse=True), "path_conf")


ORACLES |= {"paths_reachable": _walk(DEPTH, 0), "paths_min_conf": _walk(DEPTH, LEAST_CONF), "callers_reachable": _walk(DEPTH, 0, "to_id", "from_id")}
#: The end of the path: the largest id two steps away and no less.
END = "999"
_PATH = with_tables("SELECT 1 FROM edges, symbols").rsplit(" SELECT 1 FROM edges, symbols", 1)[0] + f""", step AS (SELECT '{START}' AS id, ['{START}'] AS path, 1.0::DOUBLE AS conf, 0 AS depth
UNION ALL SELECT to_id, list_append(path, to_id), conf * confidence, depth + 1 FROM step JOIN edges ON from_id = step.id WHERE depth < 2),
best AS (SELECT list_append(path, to_id) AS path, conf * confidence AS conf FROM step JOIN edges ON from_id = step.id WHERE to_id = '{END}' ORDER BY depth, path LIMIT 1),
frames AS (SELECT (i - 1)::INT AS step, path[i] AS id, conf FROM (SELECT path, conf, unnest(range(1, len(path) + 1)) AS i FROM best))"""
ORACLES["shortest_path"] = _PATH + " SELECT step, id, round(conf, 6) AS path_conf FROM frames"


@query("shortest_path")
def _(t):
    return rounded(G.shortest_path(t.edges, START, END, unique=True), "path_conf")


_ALL = with_tables("SELECT 1 FROM edges").rsplit(" SELECT 1 FROM edges", 1)[0] + f""", step AS (SELECT '{START}' AS id, ['{START}'] AS path, 1.0::DOUBLE AS conf
UNION ALL SELECT to_id, list_append(path, to_id), conf * confidence FROM step JOIN edges ON from_id = step.id WHERE len(path) <= {DEPTH} AND step.id <> '{END}' AND NOT list_contains(path, to_id))"""
ORACLES["paths_best"] = _ALL + f""" SELECT (row_number() OVER (ORDER BY round(-conf, 9), len(path), path))::INT AS rank, array_to_string(path, '>') AS path, round(conf, 6) AS path_conf
FROM step WHERE id = '{END}' QUALIFY row_number() OVER (ORDER BY round(-conf, 9), len(path), path) <= {BEST}"""


@query("paths_best")
def _(t):
    return rounded(G.best_paths(t.edges, START, END, BEST, DEPTH, unique=True), "path_conf").withColumn("path", F.array_join("path", ">"))


# depth-first order depends on all that came before, which SQL says only row by row; tests compare these with a loop
@query("paths_tree")
def _(t):
    return rounded(G.tree(t.edges, t.symbols.select("id", "qualified"), START, DEPTH, unique=True), "path_conf")


@query("callers_tree")
def _(t):
    return rounded(G.tree(t.edges, t.symbols.select("id", "qualified"), START, DEPTH, reverse=True, unique=True), "path_conf")


@query("import_scopes", "SELECT path, import, scope FROM imports JOIN (SELECT import, scope FROM import_sides WHERE scope IN (SELECT scope FROM file_scopes) QUALIFY row_number() OVER (PARTITION BY import ORDER BY length DESC, side) = 1) USING (import)")
def _(t):
    return I.import_scopes(t.imports, I.file_scopes(t.indexed))


@query("link_scoped", "SELECT from_id, to_id, confidence::DOUBLE AS confidence, scope, reason FROM scoped")
def _(t):
    return t.scoped.select("from_id", "to_id", "confidence", "scope", "reason")


@query("scoped_precision", "SELECT (SELECT count(*) FROM scoped WHERE confidence >= 0.7) AS found, (SELECT count(*) FROM scoped e JOIN true_calls t ON t.from_id = e.from_id AND t.to_id = e.to_id WHERE e.confidence >= 0.7) AS correct, (SELECT count(*) FROM true_calls) AS wanted")
def _(t):
    return A.precision(t.scoped, t.true_calls)


@query("fan_counts_factored", "SELECT id, fanin, fanout FROM fans")
def _(t):
    return C.fan_counts(t.factored)


@query("link_factored", "SELECT from_id, to_id, kind, confidence FROM edges")
def _(t):
    return C.expand(t.factored)


@query("link_incremental", "SELECT from_id, to_id, kind, confidence FROM edges")
def _(t):
    """From the symbols and calls of three languages to those of all."""
    calls, symbols = t.raw_calls, t.indexed.select("id", "name", "lang")
    then = symbols.where("lang in ('go', 'rust', 'python')")
    said = calls.join(then.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return C.expand(C.relink(C.link(said, then), calls, symbols, said, then))


for _name, _conf, _back in (("paths_reachable", 0.0, False), ("paths_min_conf", LEAST_CONF, False), ("callers_reachable", 0.0, True)):
    query(f"{_name}_factored")(lambda t, c=_conf, r=_back: rounded(C.reachable(t.factored, START, DEPTH, c, r), "path_conf"))
    ORACLES[f"{_name}_factored"] = ORACLES[_name]


_TOUCHED = "SELECT DISTINCT h.sha, s.id FROM hunks h JOIN indexed s ON s.path = h.path AND h.new_start <= s.span_end AND h.new_start + greatest(h.new_len - 1, 0) >= s.span_start"


@query(
    "symbol_cochange",
    f"""WITH touched AS ({_TOUCHED}), n AS (SELECT id, count(*) AS n FROM touched GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS support FROM touched a JOIN touched b ON a.sha = b.sha AND a.id < b.id GROUP BY ALL HAVING count(*) >= {SUPPORT})
SELECT a, b, support, round(support / least(x.n, y.n), 6) AS strength FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b""",
)
def _(t):
    return rounded(B.symbol_cochange(t.indexed, t.hunks, SUPPORT), "strength")


def _sure(t: Tables) -> DataFrame:
    """Calls that are sure, as a relation of patterns."""
    return t.edges.where("confidence >= 0.3").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))


_SURE = "c AS (SELECT DISTINCT from_id AS a, to_id AS b FROM edges WHERE confidence >= 0.3)"


@query("pattern_triangles", f"WITH {_SURE} SELECT x.a AS x, x.b AS y, y.b AS z FROM c x JOIN c y ON y.a = x.b JOIN c z ON z.a = y.b AND z.b = x.a WHERE x.a < x.b AND x.a < y.b AND x.b <> y.b")
def _(t):
    return P.triangles(_sure(t))


@query("pattern_callers_of_hot", f"WITH {_SURE}, hot AS (SELECT id FROM symbols WHERE hotspot >= 0.95) SELECT a AS caller, b AS hot FROM c WHERE b IN (SELECT id FROM hot) UNION SELECT x.a, y.b FROM c x JOIN c y ON y.a = x.b WHERE y.b IN (SELECT id FROM hot)")
def _(t):
    return P.match([P.Step("caller", "hot", "calls", 1, 2)], {"calls": _sure(t)}, {"hot": t.symbols.where("hotspot >= 0.95").select("id")})


#: Calls that leave a file and come back to it: four steps in a ring.
@query(
    "pattern_round_trip",
    f"WITH {_SURE} SELECT f.path AS file, f.id AS caller, x.b AS between, y.b AS callee FROM c x JOIN c y ON y.a = x.b JOIN indexed f ON f.id = x.a JOIN indexed g ON g.id = y.b AND g.path = f.path",
)
def _(t):
    if t.by_name:
        return P.round_trips(t.factored, t.indexed.select(F.col("path").alias("file"), "id"), 0.3)
    held = t.indexed.select(F.col("path").alias("a"), F.col("id").alias("b"))
    steps = [P.Step("file", "caller", "contains"), P.Step("caller", "between"), P.Step("between", "callee"), P.Step("file", "callee", "contains")]
    return P.match(steps, {"calls": _sure(t), "contains": held})


#: One rule for each customer, of two or three patterns.
_KINDS = "['alloc', 'await', 'block_on', 'chan', 'lock', 'loop', 'spawn', 'timer']"
_RULES = f"SELECT c_custkey::VARCHAR AS name, list_distinct([{_KINDS}[c_custkey % 8 + 1], {_KINDS}[c_custkey // 8 % 8 + 1], {_KINDS}[c_custkey // 64 % 8 + 1]]) AS patterns FROM customer"


@query("smell_custom_many", f"WITH r AS ({_RULES}) SELECT r.name AS rule, count(*) AS n FROM r JOIN symbols s ON list_has_all(s.patterns, r.patterns) WHERE len(s.patterns) > 0 GROUP BY r.name")
def _(t):
    kinds = F.array(*(F.lit(x) for x in ("alloc", "await", "block_on", "chan", "lock", "loop", "spawn", "timer")))
    key = F.col("c_custkey")
    kind = lambda n: F.get(kinds, (F.floor(key / n) % 8).cast("int"))
    rules = t.read("customer").select(key.cast("string").alias("name"), F.array_distinct(F.array(kind(1), kind(8), kind(64))).alias("patterns"), F.lit("low").alias("severity"))
    return A.custom_counts(t.symbols, rules)


_FRAMES = "(SELECT f.step, s.* FROM frames f JOIN symbols s USING (id))"
ORACLES["path_signals"] = _PATH + f""" SELECT 'path_depth' AS kind, CASE WHEN count(*) > 5 THEN 'medium' ELSE 'info' END AS severity, NULL::VARCHAR AS id FROM {_FRAMES} HAVING count(*) > 0
UNION ALL SELECT 'cross_file_boundary', 'info', NULL FROM {_FRAMES} HAVING count(DISTINCT path) > 1
UNION ALL SELECT 'lock_await', 'high', id FROM {_FRAMES} WHERE list_contains(patterns, 'lock') AND list_contains(patterns, 'await')
UNION ALL SELECT 'blocking_async', 'high', id FROM {_FRAMES} WHERE list_contains(patterns, 'block_on')
UNION ALL SELECT 'unbounded_loop', 'medium', id FROM {_FRAMES} WHERE list_contains(patterns, 'loop')
UNION ALL SELECT 'high_complexity', 'medium', id FROM {_FRAMES} WHERE complexity > 10
UNION ALL SELECT 'hot_symbol', 'medium', id FROM {_FRAMES} WHERE hotspot > 0.7
UNION ALL SELECT 'external_boundary', 'info', id FROM (SELECT id FROM {_FRAMES} ORDER BY step DESC LIMIT 1) WHERE id IN (SELECT from_id FROM edges WHERE starts_with(to_id, 'external:'))"""


@query("path_signals")
def _(t):
    return A.signals(G.shortest_path(t.edges, START, END, unique=True).join(t.symbols, "id"), L.external_callees(t.edges))


ORACLES["folded_lines"] = _PATH + f""" SELECT string_agg(name, ';' ORDER BY step) || ' ' || greatest(round(arg_max(churn, step) / (SELECT greatest(max(churn), 1) FROM symbols) * 1000), 1)::BIGINT AS line FROM {_FRAMES} HAVING count(*) > 0"""


@query("folded_lines")
def _(t):
    frames = G.shortest_path(t.edges, START, END, unique=True).join(t.symbols.select("id", "name"), "id").join(A.symbol_weights(t.symbols).select("id", "w_churn"), "id")
    whole = frames.agg(F.sort_array(F.collect_list(F.struct("step", "name"))).alias("names"), F.max_by("w_churn", "step").alias("w")).where(F.size("names") > 0)
    return whole.select(F.concat(F.array_join(F.transform("names", lambda x: x["name"]), ";"), F.lit(" "), S.folded_count(F.col("w")).cast("string")).alias("line"))


@query("graph_edges", "SELECT DISTINCT left(regexp_replace(from_id, '[^\\pL\\pN_]', '_', 'g'), 30) AS a, left(regexp_replace(to_id, '[^\\pL\\pN_]', '_', 'g'), 30) AS b FROM edges WHERE confidence >= 0.5")
def _(t):
    return t.edges.where("confidence >= 0.5").select(S.safe_id(F.col("from_id")).alias("a"), S.safe_id(F.col("to_id")).alias("b")).distinct()


@query("index_counts", "SELECT (SELECT count(*) FROM indexed) AS symbols, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM edges WHERE starts_with(to_id, 'external:')) AS external_edges")
def _(t):
    external = t.edges.where(F.col("to_id").startswith(L.EXTERNAL)).agg(F.count("*").alias("external_edges"))
    return t.indexed.agg(F.count("*").alias("symbols")).crossJoin(t.files.agg(F.count("*").alias("files"))).crossJoin(external)


@query("precision_gate", "SELECT (SELECT count(*) FROM edges WHERE confidence >= 0.7) AS found, (SELECT count(*) FROM edges e JOIN true_calls t ON t.from_id = e.from_id AND t.to_id = e.to_id WHERE e.confidence >= 0.7) AS correct, (SELECT count(*) FROM true_calls) AS wanted")
def _(t):
    return A.precision(t.edges, t.true_calls)


@query("missed_callers", "SELECT DISTINCT c.from_id, s.id AS to_id FROM raw_calls c JOIN indexed s ON s.name = c.callee EXCEPT SELECT from_id, to_id FROM edges WHERE confidence >= 0.6")
def _(t):
    return A.missed_callers(t.raw_calls, t.indexed, t.edges)


@query("eval_callers")
def _(t):
    return t.reachable(START, DEPTH, reverse=True).join(t.indexed, "id").select("path").distinct()


ORACLES["eval_callers"] = ORACLES["callers_reachable"].replace("SELECT id, min(depth) AS depth, round(max(conf), 6) AS path_conf FROM walk GROUP BY id", "SELECT DISTINCT path FROM walk JOIN symbols0 USING (id) WHERE symbols0.loc <= 40 AND symbols0.lang <> 'hcl'")


# --------------------------------------------------------------- analysis

_RANK = "(SELECT list(v ORDER BY v)[(round({p} / 100.0 * (count(*) - 1)) + 1)::BIGINT] FROM (SELECT {c} AS v FROM file_stats))"


def rank_sql(column: str, percent: float) -> str:
    return _RANK.format(c=column, p=percent)


@query("percentile_nearest", " UNION ALL ".join(f"SELECT {p}::DOUBLE AS percent, {rank_sql('churn', p)} AS value" for p in (50.0, 90.0, 95.0)))
def _(t):
    return A.nearest_rank(t.file_stats, "churn", [50.0, 90.0, 95.0])


@query("symbol_weights", "SELECT id, round(loc / greatest(max(loc) OVER (), 1), 6) AS w_loc, round(churn / greatest(max(churn) OVER (), 1), 6) AS w_churn, round(fanin / greatest(max(fanin) OVER (), 1), 6) AS w_fanin, round(hotspot, 6) AS w_hotspot FROM symbols")
def _(t):
    return rounded(A.symbol_weights(t.symbols), "w_loc", "w_churn", "w_fanin", "w_hotspot")


@query("file_weights", "SELECT path, round(loc / greatest(max(loc) OVER (), 1), 6) AS w_loc, round(churn / greatest(max(churn) OVER (), 1), 6) AS w_churn, round(hotspot, 6) AS w_hotspot FROM file_stats")
def _(t):
    return rounded(A.file_weights(t.file_stats), "w_loc", "w_churn", "w_hotspot")


_MAP = "SELECT path, count(*) AS n_symbols, round(max(w), 6) AS weight FROM (SELECT path, churn / greatest(max(churn) OVER (), 1) AS w FROM symbols) GROUP BY path"


@query("map_files", _MAP)
def _(t):
    return rounded(A.map_files(t.symbols, A.symbol_weights(t.symbols)), "weight")


@query("map_top", f"SELECT * FROM ({_MAP}) ORDER BY weight DESC, path LIMIT 50")
def _(t):
    return rounded(A.map_files(t.symbols, A.symbol_weights(t.symbols)), "weight").orderBy(F.desc("weight"), "path").limit(50)


@query("smell_shotgun", f"SELECT path, count(*) AS partners FROM (SELECT file_a AS path FROM cochange WHERE strength >= {STRENGTH} OR strength_rev >= {STRENGTH} UNION ALL SELECT file_b FROM cochange WHERE strength >= {STRENGTH} OR strength_rev >= {STRENGTH}) GROUP BY path HAVING count(*) >= 4")
def _(t):
    return A.shotgun(t.cochange, STRENGTH)


@query("smell_god_file", f"SELECT path, loc, churn FROM file_stats WHERE loc >= {rank_sql('loc', 80.0)} AND churn >= {rank_sql('churn', 80.0)}")
def _(t):
    return A.god_file(t.file_stats, 80.0)


@query("smell_stale_core", f"SELECT path, age_days, churn FROM file_stats WHERE age_days >= {STALE_DAYS} AND churn >= {rank_sql('churn', 90.0)}")
def _(t):
    return A.stale_core(t.file_stats, STALE_DAYS)


@query("smell_tangled_pair", f"SELECT file_a, file_b, round(strength, 6) AS strength, round(strength_rev, 6) AS strength_rev FROM cochange WHERE strength >= {STRENGTH} AND strength_rev >= {STRENGTH}")
def _(t):
    return rounded(A.tangled_pair(t.cochange, STRENGTH), "strength", "strength_rev")


RULE_SQL = {
    "lock_across_await": "list_contains(patterns, 'lock') AND list_contains(patterns, 'await')",
    "sync_in_async": "list_contains(patterns, 'block_on')",
    "alloc_in_hotspot": "n_alloc > 2 AND hotspot > 0.7",
    "high_complexity_bottleneck": "complexity > 10 AND fanin > 8 AND hotspot > 0.5",
    "spawn_in_tight_loop": "list_contains(patterns, 'spawn') AND list_contains(patterns, 'loop')",
    "unbalanced_fanout": "fanout > 8 AND fanin < 2 AND churn < 3",
}
KEYS = {"smell_lock_await": "lock_across_await", "smell_sync_async": "sync_in_async", "smell_alloc_hotspot": "alloc_in_hotspot", "smell_bottleneck": "high_complexity_bottleneck", "smell_spawn_loop": "spawn_in_tight_loop", "smell_fanout": "unbalanced_fanout"}
for _key, _kind in KEYS.items():
    query(_key, f"SELECT id, path, name FROM symbols WHERE len(patterns) > 0 AND {RULE_SQL[_kind]}")(lambda t, kind=_kind: A.semantic(t.symbols, kind))

_FOUND = " UNION ALL ".join(f"SELECT '{k}' AS kind, id, path FROM symbols WHERE len(patterns) > 0 AND {r}" for k, r in RULE_SQL.items())


@query("smell_findings", _FOUND)
def _(t):
    return A.findings(t.symbols)


@query("smell_by_kind", f"SELECT kind, id, path, n::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path, id) AS n FROM ({_FOUND})) WHERE n <= 3")
def _(t):
    return A.top_by_kind(A.findings(t.symbols))


@query("smell_by_file", f"SELECT path, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n FROM ({_FOUND}) GROUP BY path")
def _(t):
    return A.findings(t.symbols).groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.count("*").alias("n"))


@query("smell_custom", "SELECT r.name AS rule, severity, id FROM symbols s, rules r WHERE len(s.patterns) > 0 AND list_has_all(s.patterns, r.patterns)")
def _(t):
    return A.custom(t.symbols, t.rules)


_SEC = "(" + " OR ".join(f"contains(lower({{p}}), '{w}')" for w in S.SECURITY_WORDS) + ")"
_RENAMED = "SELECT regexp_replace(file_a, 'small', 'session') AS file_a, regexp_replace(file_b, 'small', 'session') AS file_b, strength, strength_rev FROM cochange"


@query(
    "smell_recommend",
    f"WITH r AS (SELECT *, {_SEC.format(p='file_a')} AS a, {_SEC.format(p='file_b')} AS b FROM ({_RENAMED}) WHERE strength >= {STRENGTH} OR strength_rev >= {STRENGTH}), w AS (SELECT CASE WHEN a THEN file_a ELSE file_b END AS secure, CASE WHEN a THEN file_b ELSE file_a END AS other FROM r WHERE a OR b) SELECT DISTINCT 'semgrep' AS tool, unnest([secure, other]) AS path FROM w",
)
def _(t):
    renamed = t.cochange.withColumns({c: F.regexp_replace(c, "small", "session") for c in ("file_a", "file_b")})
    return A.recommend(renamed, STRENGTH)


_SIGNS = "((hotspot > 0.6)::INT + (complexity > 10)::INT + (fanin > 5)::INT)"
_DANGER = "(list_contains(patterns, 'lock') AND list_contains(patterns, 'await'))"
_RISK = f"CASE WHEN {_DANGER} OR {_SIGNS} = 3 THEN 'HIGH' WHEN {_SIGNS} = 2 THEN 'MEDIUM' ELSE 'LOW' END"
_HIGH = f"({_DANGER} OR (hotspot > 0.5 AND complexity > 8) OR (hotspot > 0.7 AND complexity > 3) OR (fanin > 8 AND complexity > 3))"


@query("risk_levels", f"SELECT id, {_RISK} AS risk FROM symbols")
def _(t):
    return t.symbols.select("id", S.risk_level(F.col("hotspot"), F.col("complexity"), F.col("fanin"), F.col("patterns")).alias("risk"))


@query(
    "explain_symbol",
    f"SELECT id, CASE WHEN hotspot >= 0.8 THEN 'very hot' WHEN hotspot >= 0.5 THEN 'warm' WHEN hotspot >= 0.2 THEN 'lukewarm' ELSE 'cold' END AS heat, CASE WHEN complexity > 20 THEN 'very high' WHEN complexity > 10 THEN 'high' WHEN complexity > 5 THEN 'moderate' ELSE 'low' END AS complexity_note, CASE WHEN fanin >= 6 THEN 'many places' WHEN fanin >= 2 THEN 'a few places' WHEN fanin = 1 THEN 'one place' ELSE 'unused' END AS fanin_note, CASE WHEN fanout >= 9 THEN 'many' WHEN fanout >= 4 THEN 'moderate' WHEN fanout >= 1 THEN 'a few' ELSE 'leaf' END AS fanout_note, {_RISK} AS risk FROM symbols",
)
def _(t):
    return A.explain(t.symbols)


PR = ("pr",)


@query("changed_files", "SELECT pr, path FROM pr_files")
def _(t):
    return t.pr_files


@query("diff_lines", "SELECT pr, path, line, pure FROM pr_lines")
def _(t):
    return X.diff_lines(t.pr_hunks, PR)


_MARK = "CASE WHEN touched = 0 THEN {none} WHEN pure = touched THEN '+' ELSE '~' END AS mark"


def _marks(t: Tables, untouched: str | None = None) -> DataFrame:
    return X.diff_marks(t.indexed, X.diff_ranges(t.pr_hunks, PR), untouched, PR, t.pr_files)


@query("diff_marks", f"SELECT pr, id, path, touched, pure, {_MARK.format(none='NULL')} FROM marked")
def _(t):
    return _marks(t)


@query("branch_marks", "SELECT pr, id, path, touched, pure, " + _MARK.format(none="'~'") + " FROM marked")
def _(t):
    return _marks(t, "~")


@query("diff_weight", "SELECT m.pr, id, round(touched / coalesce(n, 1), 6) AS weight FROM marked m LEFT JOIN (SELECT pr, count(*) AS n FROM pr_lines GROUP BY pr) l ON l.pr = m.pr")
def _(t):
    return rounded(X.diff_weight(_marks(t), X.diff_ranges(t.pr_hunks, PR), PR), "weight")


@query("explain_pr_symbols", "SELECT pr, id, name, path FROM indexed JOIN pr_files USING (path)")
def _(t):
    return t.indexed.join(t.pr_files, "path").select("pr", "id", "name", "path")


@query("explain_pr_high_risk", f"SELECT pr, id, path FROM symbols JOIN pr_files USING (path) WHERE {_HIGH}")
def _(t):
    return t.symbols.where(S.high_risk(F.col("hotspot"), F.col("complexity"), F.col("fanin"), F.col("patterns"))).join(t.pr_files, "path").select("pr", "id", "path")


_MISSED = f"SELECT f.pr, partner, max(s) AS s FROM (SELECT file_a AS path, file_b AS partner, greatest(strength, strength_rev) AS s, support FROM cochange UNION ALL SELECT file_b, file_a, greatest(strength, strength_rev), support FROM cochange) c JOIN pr_files f USING (path) WHERE support >= {SUPPORT} AND s >= {STRENGTH} AND NOT EXISTS (SELECT 1 FROM pr_files g WHERE g.pr = f.pr AND g.path = partner) GROUP BY ALL"


@query("explain_pr_missed", f"SELECT pr, partner, round(s, 6) AS strength FROM ({_MISSED})")
def _(t):
    return rounded(A.missed_partners(t.cochange, t.pr_files, STRENGTH, SUPPORT, PR), "strength")


@query(
    "explain_pr_verdict",
    f"""SELECT pr, n_high, n_missed, CASE WHEN danger OR n_high > 5 THEN 'HIGH' WHEN n_high > 0 OR n_missed > 3 THEN 'MEDIUM' ELSE 'LOW' END AS verdict FROM (
SELECT f.pr, coalesce(sum(r.n_high), 0)::BIGINT AS n_high, coalesce(bool_or(danger), false) AS danger, coalesce(any_value(m.n), 0)::BIGINT AS n_missed FROM pr_files f
LEFT JOIN (SELECT path, count(*) FILTER ({_HIGH}) AS n_high, bool_or({_DANGER}) AS danger FROM symbols GROUP BY path) r USING (path)
LEFT JOIN (SELECT pr, count(*) AS n FROM ({_MISSED}) GROUP BY pr) m ON m.pr = f.pr GROUP BY f.pr)""",
)
def _(t):
    return A.reviews(t.symbols, t.pr_files, t.cochange, STRENGTH, SUPPORT)


@query("pattern_summary", "SELECT pr, pattern, sum(n)::BIGINT AS n FROM (SELECT path, captured.kind AS pattern, count(*) AS n FROM captured JOIN indexed USING (id) GROUP BY ALL) JOIN pr_files USING (path) GROUP BY ALL")
def _(t):
    per_file = t.symbols.select("path", F.explode("patterns").alias("pattern")).groupBy("path", "pattern").agg(F.count("*").alias("n"))
    return per_file.join(t.pr_files, "path").groupBy("pr", "pattern").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------- extraction

#: A small program in each language around a symbol: its name in @, its number in %; and what is in it: definitions
#: (name, kind, first and last line, complexity), the names it calls with their lines, imports, patterns with their lines.
PROGRAMS: dict[str, tuple[str, str, list[tuple], list[tuple], list[str], list[tuple]]] = {
    "rust": ("rs", "use std::sync::Mutex;\n\nstruct S@ {\n    n: u32,\n}\n\nimpl S@ {\n    fn go@(&self) -> u32 {\n        let u = \"http://x\"; helper_%();\n        for i in 0..3 {\n            self.m.lock();\n        }\n        7\n    }\n}\n\nfn free@() {\n    // lost_%()\n    task::spawn(x);\n}\n", [("S@", "type", 3, 5, 0), ("go@", "method", 8, 14, 3), ("free@", "function", 17, 20, 0)], [("helper_%", 9), ("lock", 11), ("spawn", 19)], ["std::sync"], [("loop", 10), ("lock", 11), ("spawn", 19)]),
    "go": ("go", "package m\n\nimport \"sync\"\n\ntype T@ struct {\n}\n\nfunc (t *T@) Do@() {\n\tt.mu.Lock()\n\tif true {\n\t\tgo helper_%()\n\t}\n}\n", [("T@", "type", 5, 6, 0), ("Do@", "method", 8, 13, 2)], [("Lock", 9), ("helper_%", 11)], ["sync"], [("lock", 9), ("spawn", 11)]),
    "python": ("py", "import os.path\n\n\nclass C@:\n    async def run@(self, x):\n        for i in x:\n            await helper_%(i)\n        return \"lost_%()\"\n", [("C@", "type", 4, 8, 4), ("run@", "method", 5, 8, 4)], [("helper_%", 7)], ["os.path"], [("loop", 6), ("await", 7)]),
    "typescript": ("ts", "import { a } from 'mod-%';\n\nexport enum E@ { A, B }\n\nexport class K@ {\n  run@(x: number) {\n    const u = 'http://x'; helper_%(x);\n    while (x) {\n      x--;\n    }\n  }\n}\n\nexport const f@ = async (x) => {\n  await other_%(x);\n};\n", [("E@", "type", 3, 3, 0), ("K@", "type", 5, 12, 3), ("run@", "method", 6, 11, 3), ("f@", "function", 14, 16, 0)], [("helper_%", 7), ("other_%", 15)], ["mod-%"], [("loop", 8), ("await", 15)]),
    "javascript": ("js", "const m = require('mod-%');\n\nfunction f@(x) {\n  setTimeout(x, 5);\n  if (x) {\n    helper_%(`lost_%()`);\n  }\n}\n", [("f@", "function", 3, 8, 2)], [("require", 1), ("setTimeout", 4), ("helper_%", 6)], ["mod-%"], [("timer", 4)]),
    "java": ("java", "import java.util.List;\n\nclass J@ {\n  void run@(int x) {\n    for (int i = 0; i < x; i++) {\n      helper_%(\"lost_%()\");\n    }\n  }\n}\n", [("J@", "type", 3, 9, 3), ("run@", "method", 4, 8, 3)], [("helper_%", 6)], ["java.util.List"], [("loop", 5)]),
    "ruby": ("rb", "require 'set'\n\nmodule M@\n  class R@\n    def go@(x)\n      while x\n        helper_%(x)\n      end\n    end\n  end\nend\n", [("M@", "type", 3, 11, 4), ("R@", "type", 4, 10, 4), ("go@", "method", 5, 9, 4)], [("helper_%", 7)], ["set"], [("loop", 6)]),
    "c": ("c", "#include <stdio.h>\n\nint proto@(int a);\n\nstruct s@ {\n  int n;\n};\n\nint f@(int a) {\n  /* lost_%() */\n  if (a) {\n    return helper_%(malloc(a));\n  }\n  return 0;\n}\n", [("proto@", "function", 3, 3, 0), ("s@", "type", 5, 7, 0), ("f@", "function", 9, 15, 2)], [("helper_%", 12), ("malloc", 12)], ["stdio.h"], [("alloc", 12)]),
    "cpp": ("cpp", "#include <mutex>\n\nnamespace n@ {\nclass C@ {\n};\n\nint f@(int a) {\n  std::lock_guard<std::mutex> g(m);\n  return helper_%(new int);\n}\n}\n", [("n@", "type", 3, 11, 0), ("C@", "type", 4, 5, 0), ("f@", "method", 7, 10, 0)], [("g", 8), ("helper_%", 9)], ["mutex"], [("lock", 8), ("alloc", 9)]),
    "bash": ("sh", "source lib-%.sh\n\nrun@() {\n  if true; then\n    helper_% x\n  fi\n}\n", [("run@", "function", 3, 7, 2)], [("helper_%", 5)], ["lib-%.sh"], []),
}
LANGS = tuple(PROGRAMS)


def _sources(t: Tables) -> DataFrame:
    """One small program for each part, in ten languages by turns."""
    number = (F.col("id").cast("int") % len(LANGS)) + 1
    fill = lambda text: F.replace(F.replace(text, F.lit("@"), F.concat(F.lit("_"), "id")), F.lit("%"), F.col("id"))
    pick = lambda k: F.element_at(F.array(*(F.lit(PROGRAMS[x][k] if k is not None else x) for x in LANGS)), number)
    return t.symbols0.select(F.concat(F.lit("gen/"), "id", F.lit("."), pick(0)).alias("path"), pick(None).alias("lang"), fill(pick(1)).alias("text"))


def _stated(k: int, names: str) -> str:
    """What the programs hold, part by part: SQL of the stated rows."""
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v + "'"
    rows = ", ".join(f"({i}, '{PROGRAMS[x][0]}', {', '.join(quoted(v) for v in (row if isinstance(row, tuple) else (row,)))})" for i, x in enumerate(LANGS) for row in PROGRAMS[x][k])
    return f"(SELECT 'gen/' || id || '.' || ext AS path, id, v.* FROM symbols0 JOIN (VALUES {rows}) v(lang_no, ext, {names}) ON id::INT % {len(LANGS)} = lang_no)"


_FILL = "replace(replace({c}, '@', '_' || id), '%', id)"


def _extracted(t: Tables) -> DataFrame:
    from loomgraph.sources.extract import extract

    return extract(_sources(t))


@query("extract_defs", f"SELECT path, {_FILL.format(c='name')} AS name, kind, a::INT AS span_start, b::INT AS span_end, complexity::INT AS complexity FROM {_stated(2, 'name, kind, a, b, complexity')}")
def _(t):
    return _extracted(t).select("path", F.explode("defs").alias("d")).select("path", "d.*")


@query("extract_calls", f"SELECT path, {_FILL.format(c='callee')} AS callee, line::INT AS line FROM {_stated(3, 'callee, line')}")
def _(t):
    return _extracted(t).select("path", F.explode("calls").alias("c")).select("path", "c.*")


@query("extract_imports", f"SELECT path, {_FILL.format(c='name')} AS \"import\" FROM {_stated(4, 'name')}")
def _(t):
    return _extracted(t).select("path", F.explode("imports").alias("import"))


@query("extract_patterns", f"SELECT path, kind, line::INT AS line FROM {_stated(5, 'kind, line')}")
def _(t):
    return _extracted(t).select("path", F.explode("patterns").alias("p")).select("path", "p.*")


@query("complexity_proxy", f"SELECT lang, sum(complexity)::BIGINT AS complexity, count(*) AS n FROM (SELECT ext AS lang, complexity FROM {_stated(2, 'name, kind, a, b, complexity')}) GROUP BY lang")
def _(t):
    found = _extracted(t).select(S.extension(F.col("path")).alias("lang"), F.explode("defs").alias("d"))
    return found.groupBy("lang").agg(F.sum("d.complexity").alias("complexity"), F.count("*").alias("n"))


@query("extract_stats", f"SELECT (SELECT count(*) FROM symbols0) AS files_processed, (SELECT count(*) FROM {_stated(2, 'name, kind, a, b, complexity')}) AS symbols_found, 0::BIGINT AS files_skipped")
def _(t):
    from loomgraph.sources.extract import extract_stats

    return extract_stats(_extracted(t))


@query("hunks_from_log", "SELECT DISTINCT path, lpad(lower(to_hex(sha)), 40, '0') AS sha, new_start, new_len, old_len FROM hunks")
def _(t):
    from loomgraph.sources.diffs import hunks_from_log

    log = t.hunks.groupBy("sha", "path").agg(F.sort_array(F.collect_set(F.struct("new_start", "new_len", "old_len"))).alias("h"))
    header = lambda h: F.concat(F.lit("@@ -1,"), h["old_len"].cast("string"), F.lit(" +"), h["new_start"].cast("string"), F.lit(","), h["new_len"].cast("string"), F.lit(" @@"))
    named = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n--- a/"), "path", F.lit("\n+++ b/"), "path")
    part = F.array_join(F.concat(F.array(named), F.transform("h", header)), "\n")
    text = log.groupBy("sha").agg(F.array_join(F.array_sort(F.collect_list(part)), "\n").alias("text"))
    return hunks_from_log(text.select(F.concat(F.lower(F.lpad(F.hex("sha"), 40, "0")), F.lit("\n"), "text").alias("commit")))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The hottest files with how many semantic smells each has."""
    t = Tables(spark, folder)
    smells = A.findings(t.symbols).groupBy("path").agg(F.count("*").alias("smells"))
    return rounded(M.hotspots(t.file_stats, 20), "hotspot").join(smells, "path", "left").withColumn("smells", F.coalesce("smells", F.lit(0))).orderBy(F.desc("hotspot"), "path")
