"""A star schema read as a repository: parts are symbols, orders commits, line items changes.

Each logical table is one SQL text. It runs in Spark, and (with the few words
that differ between the engines) in the engine that checks the results. Lines of
documents and conversations that keyword expressions match are pattern captures of
the part with the same number. The changes of one week are a pull request.

What queries share is an index: calls by name and symbols are derived once for a
session and a folder, written to the shared folder, and read by every query after
while the folder's files are the same by path, length and time of change. Edges, a row
for each call and candidate, are made from calls by name where a query reads them and are never stored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.operators import factored, graph, imports, linking, mining, spans
from loomgraph.runtime import filesystem, materialize, ship
from loomgraph.sources import extract

#: Tables of the index by session, folder, what the folder's files are, and name.
_INDEX: dict[tuple[str, str, str, str], str] = {}
#: What the index is derived from.
INPUTS = ("part", "lineitem", "documents", "conversations")

AS_OF = "2001-08-02"
MASS_COMMIT = 8
INDEXED_LOC = 40
#: Tables of at most so many parts, some 100 bytes each, are broadcast; larger ones are joined by shuffle.
BROADCAST_PARTS = 2_000_000

SYMBOLS0 = """
SELECT id, name, kind, lang, path, span_end - loc + 1 AS span_start, span_end, loc, complexity FROM (
  SELECT *, CAST(sum(loc) OVER (PARTITION BY path ORDER BY part ROWS UNBOUNDED PRECEDING) AS BIGINT) AS span_end FROM (
    SELECT p_partkey AS part, CAST(p_partkey AS STRING) AS id, concat(p_name, ' ', p_brand) AS name,
      CASE p_partkey % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'method' ELSE 'type' END AS kind,
      CASE p_type WHEN 'MEDIUM' THEN 'go' WHEN 'STANDARD' THEN 'rust' WHEN 'LARGE' THEN 'python' WHEN 'PROMO' THEN 'typescript' WHEN 'SMALL' THEN 'java' ELSE 'hcl' END AS lang,
      concat(CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'tests' ELSE 'src' END, '/', p_brand, '/', lower(p_type), '.',
        CASE p_type WHEN 'MEDIUM' THEN 'go' WHEN 'STANDARD' THEN 'rs' WHEN 'LARGE' THEN 'py' WHEN 'PROMO' THEN 'ts' WHEN 'SMALL' THEN 'java' ELSE 'tf' END) AS path,
      p_size AS loc, CAST(floor(p_retailprice) AS INT) % 25 AS complexity
    FROM {part}) a) b"""
FILES = "SELECT path, lang, CAST(sum(loc) AS BIGINT) AS loc FROM {symbols0} GROUP BY path, lang"
COMMITS = "SELECT o_orderkey AS sha, o_orderdate AS ts, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS n_parents FROM {orders}"
COMMIT_FILES0 = "SELECT DISTINCT l_orderkey AS sha, path, lang FROM {lineitem} JOIN {symbols0} ON CAST(l_partkey AS STRING) = id"
HUNKS = """
SELECT l_orderkey AS sha, path, span_start + l_linenumber - 1 AS new_start, CAST(floor(l_quantity) AS INT) AS new_len, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS old_len
FROM {lineitem} JOIN {symbols0} ON CAST(l_partkey AS STRING) = id"""
RAW_CALLS = """
SELECT DISTINCT from_id, callee FROM (
  SELECT id AS from_id, lead(name) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS callee
  FROM {lineitem} JOIN {symbols0} ON CAST(l_partkey AS STRING) = id) a WHERE callee IS NOT NULL"""
INDEXED = f"SELECT * FROM {{symbols0}} WHERE loc <= {INDEXED_LOC} AND lang <> 'hcl'"
#: Keyword expressions of the patterns, over lines in lower case.
KEYWORDS = {"lock": "that", "await": "with", "block_on": "then", "spawn": "this", "loop": "from", "alloc": "tion|ing", "chan": "thing", "timer": "ones"}
WORD = "(^|[^a-z])({})([^a-z]|$)"
LINES = """
SELECT 'document' AS origin, CAST(doc_id AS STRING) AS id, k AS spot, lower(line) AS line FROM {documents} {each}
UNION ALL SELECT 'conversation', CAST(conv_id AS STRING), turn * 1000 + k, lower(line) FROM {conversations} {each}"""
EACH = "LATERAL VIEW posexplode(split(coalesce(text, ''), '\\n')) t AS k, line"
TRUE_CALLS = """
SELECT DISTINCT from_id, to_id FROM (
  SELECT id AS from_id, lead(id) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS to_id
  FROM {lineitem} JOIN {symbols0} ON CAST(l_partkey AS STRING) = id) a WHERE to_id IS NOT NULL"""
#: A file imports the modules of the files whose symbols stand second in an order that one of its own begins.
IMPORTS = """
SELECT DISTINCT path, concat('crate::', replace(substr(other, 1, length(other) - position('.' IN reverse(other))), '/', '::')) AS import FROM (
  SELECT path, l_linenumber, lead(path) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS other, l_returnflag
  FROM {lineitem} JOIN {symbols0} ON CAST(l_partkey AS STRING) = id) a WHERE other IS NOT NULL AND l_linenumber = 1 AND l_returnflag = 'R'"""
PR_HUNKS = "SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS pr, h.* FROM {hunks} h JOIN {orders} ON o_orderkey = sha"
RULES = """
SELECT 'deadlock_spawn' AS name, array('lock', 'spawn') AS patterns, 'high' AS severity UNION ALL SELECT 'alloc_loop', array('alloc', 'loop'), 'medium'"""


class Tables:
    """Logical tables over one folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        ship(spark)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _sql(self, text: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(text, **tables)

    @cached_property
    def symbols0(self) -> DataFrame:
        return self._sql(SYMBOLS0, part=self.read("part"))

    @cached_property
    def files(self) -> DataFrame:
        return self._sql(FILES, symbols0=self.symbols0)

    @cached_property
    def commits(self) -> DataFrame:
        return self._sql(COMMITS, orders=self.read("orders"))

    @cached_property
    def commit_files0(self) -> DataFrame:
        return self._sql(COMMIT_FILES0, lineitem=self.read("lineitem"), symbols0=self.symbols0)

    @cached_property
    def commit_files(self) -> DataFrame:
        return mining.kept_files(self.commit_files0, MASS_COMMIT)

    @cached_property
    def hunks(self) -> DataFrame:
        return self._sql(HUNKS, lineitem=self.read("lineitem"), symbols0=self.few(self.symbols0.select("id", "path", "span_start")))

    def following(self, text: str, told: str) -> DataFrame:
        """RAW_CALLS or TRUE_CALLS over line items that have met (part, told): they are dealt by order, then by caller, where they are made distinct."""
        parts = self.few(self.symbols0.select(F.col("id").cast("long").alias("l_partkey"), told))
        items = self.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, "l_partkey")
        spark_text = text.replace("SELECT DISTINCT from_id", "SELECT CAST(from_id AS STRING) AS from_id").replace("SELECT id AS from_id", "SELECT l_partkey AS from_id")
        return self._sql(spark_text.replace("JOIN {symbols0} ON CAST(l_partkey AS STRING) = id", ""), lineitem=items).repartition("from_id").distinct()

    def few(self, parts: DataFrame) -> DataFrame:
        """A table by part, to be broadcast where parts are at most ``BROADCAST_PARTS``."""
        return F.broadcast(parts) if self.n_parts <= BROADCAST_PARTS else parts

    @cached_property
    def n_parts(self) -> int:
        return self.read("part").count()

    @cached_property
    def raw_calls(self) -> DataFrame:
        return self.following(RAW_CALLS, "name")

    @cached_property
    def indexed(self) -> DataFrame:
        return self._sql(INDEXED, symbols0=self.symbols0)

    @cached_property
    def true_calls(self) -> DataFrame:
        """What calls stand for, which the linker doesn't see."""
        return self.following(TRUE_CALLS, "id")

    @cached_property
    def imports(self) -> DataFrame:
        # line items alike in number and part may differ in their flag: which goes first is settled here, the SQL leaves it open
        return self._sql(IMPORTS.replace("l_partkey)", "l_partkey, l_returnflag DESC)"), lineitem=self.read("lineitem"), symbols0=self.symbols0)

    @cached_property
    def scoped(self) -> DataFrame:
        """Scoped edges, made where they are read, as ``edges``; the calls come from the index."""
        return imports.link(self.factored.callers.select("from_id", F.col("name").alias("callee")), self.indexed, self.imports)

    @cached_property
    def factored(self) -> factored.Calls:
        callers = self.stored("callers", lambda: factored.asking(self.raw_calls, self.indexed))
        return factored.Calls(callers, self.stored("candidates", lambda: factored.asked(callers, self.indexed)))

    @cached_property
    def captures(self) -> DataFrame:
        """(capture, path, line, kind): lines fall on the lines of their symbol in turn."""
        lines = self._sql(LINES.format(documents="{documents}", conversations="{conversations}", each=EACH), documents=self.read("documents"), conversations=self.read("conversations"))
        found = extract.match_lines(lines, {k: WORD.format(v) for k, v in KEYWORDS.items()}).join(self.symbols0.select("id", "path", "span_start", "loc"), "id")
        return found.select(F.concat_ws(":", "origin", "id", "spot", "kind").alias("capture"), "path", (F.col("span_start") + F.col("spot") % F.col("loc")).alias("line"), "kind")

    @cached_property
    def rules(self) -> DataFrame:
        return self._sql(RULES)

    # what the engine derives from them

    @cached_property
    def git_stats(self) -> DataFrame:
        return mining.git_stats(self.commit_files, self.commits, AS_OF)

    @cached_property
    def file_stats(self) -> DataFrame:
        return self.files.join(self.git_stats, "path")

    @cached_property
    def cochange(self) -> DataFrame:
        return mining.with_strength(mining.pair_support(self.commit_files), mining.file_churn(self.commit_files))

    @cached_property
    def linked(self) -> DataFrame:
        return linking.link(self.raw_calls, self.indexed)

    @cached_property
    def state(self) -> str:
        """A digest of paths, lengths and times of the input files; their contents are not read."""
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{self.folder}/{x}.parquet" for x in INPUTS])
        return str(listed.agg(F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first())

    def stored(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.folder, self.state, name)
        if key in _INDEX:
            fs, path, _ = filesystem(self.spark, _INDEX[key])
            if fs.exists(path):
                return self.spark.read.parquet(_INDEX[key])
        out = materialize(make(), f"index-{name}")
        _INDEX[key] = out._table
        return out

    @cached_property
    def by_name(self) -> bool:
        """Whether no two symbols have one id: then calls by name make no edge twice."""
        return self.stored("repeated", lambda: self.indexed.groupBy("id").count().where("count > 1").select("id")).isEmpty()

    @cached_property
    def edges(self) -> DataFrame:
        """The edges, made where they are read: filters on ends and confidence reach the calls by name first."""
        made = factored.expand(self.factored)
        return made if self.by_name else linking.merge_edges(made)

    @cached_property
    def fans(self) -> DataFrame:
        return factored.fan_counts(self.factored) if self.by_name else linking.fan_counts(self.edges)

    def reachable(self, start: str, depth: int, least: float = 0.0, reverse: bool = False) -> DataFrame:
        if self.by_name:
            return factored.reachable(self.factored, start, depth, least, reverse)
        return graph.reachable(self.edges, start, depth, least, reverse, unique=True)

    @cached_property
    def symbols(self) -> DataFrame:
        return self.stored("symbols", self._symbols)

    def _symbols(self) -> DataFrame:
        """Indexed symbols with churn, hotspot, patterns, counts, fanin, fanout."""
        own = self.indexed.withColumn("qualified", F.concat("path", F.lit(":"), "name"))
        churn = spans.span_hotspot(own, spans.span_churn(self.few(own), self.hunks)).drop("path")
        found = spans.attribute(self.captures, own)
        out = own.join(churn, "id").join(found, "id", "left").withColumn("patterns", F.coalesce("patterns", F.array().cast("array<string>")))
        return linking.with_fans(out, self.fans)

    @cached_property
    def pr_hunks(self) -> DataFrame:
        return self._sql(PR_HUNKS, hunks=self.hunks, orders=self.read("orders"))

    @cached_property
    def pr_files(self) -> DataFrame:
        return self.pr_hunks.select("pr", "path").distinct()


def _cte() -> dict[str, str]:
    name = {k: k for k in ("part", "orders", "lineitem", "symbols0")}
    age = f"CAST(greatest(date_diff('day', CAST(last_commit_ts AS DATE), DATE '{AS_OF}'), 0) AS INT)"
    return {
        "symbols0": SYMBOLS0.format(**name),
        "files": FILES.format(**name),
        "commits": COMMITS.format(**name),
        "commit_files0": COMMIT_FILES0.format(**name),
        "commit_files": f"SELECT sha, path, lang FROM (SELECT *, count(*) OVER (PARTITION BY sha) AS n FROM commit_files0) WHERE n <= {MASS_COMMIT} AND lang NOT IN ('hcl', 'yaml', 'unknown')",
        "hunks": HUNKS.format(**name),
        "raw_calls": RAW_CALLS.format(**name),
        "indexed": INDEXED.format(**name),
        "true_calls": TRUE_CALLS.format(**name),
        "imports": IMPORTS.format(**name),
        "file_scopes": """
SELECT DISTINCT path, array_to_string(list_slice(w, i, len(w)), '/') AS scope FROM (
  SELECT path, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT path, string_split(regexp_replace(path, '\\.[^./]*$', ''), '/') AS w FROM files
    UNION ALL SELECT path, list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1) FROM files) x) y WHERE path IN (SELECT path FROM indexed)""",
        "import_sides": """
SELECT import, side, array_to_string(list_slice(w, i, len(w)), '/') AS scope, len(w) - i + 1 AS length FROM (SELECT import, side, w, unnest(range(1, len(w) + 1)) AS i FROM (
  SELECT import, side, CASE side WHEN 0 THEN w ELSE list_slice(w, 1, len(w) - 1) END AS w FROM (SELECT DISTINCT import, list_filter(string_split(import, '::'), lambda x: x <> 'crate') AS w FROM imports) a, (VALUES (0), (1)) t(side)) b) c""",
        "visible": "SELECT DISTINCT path, scope FROM imports JOIN (SELECT import, scope FROM import_sides WHERE scope IN (SELECT scope FROM file_scopes) QUALIFY row_number() OVER (PARTITION BY import ORDER BY length DESC, side) = 1) USING (import)",
        "located": "SELECT DISTINCT c.from_id, c.callee, k.path, k.lang FROM raw_calls c LEFT JOIN indexed k ON k.id = c.from_id",
        "candidates": """
SELECT l.from_id, l.callee, s.id AS to_id, CASE WHEN s.path = l.path THEN 0 WHEN s.lang = l.lang AND EXISTS (SELECT 1 FROM visible v JOIN file_scopes f USING (scope) WHERE v.path = l.path AND f.path = s.path) THEN 1 WHEN s.lang = l.lang THEN 2 ELSE 3 END AS place
FROM located l JOIN indexed s ON s.name = l.callee""",
        "scoped": """
SELECT from_id, to_id, 'calls' AS kind, CASE WHEN n = 1 THEN [1.0, 0.9, 0.7, 0.5][place + 1] ELSE [0.5, 0.5, 0.3, 0.2][place + 1] END AS confidence, ['file', 'import', 'language', 'any'][place + 1] AS scope,
  CASE WHEN n > 1 THEN 'several candidates: ' || ['file', 'import', 'language', 'any'][place + 1] WHEN place = 3 THEN 'another language' END AS reason
FROM (SELECT *, count(*) OVER (PARTITION BY from_id, callee) AS n FROM (SELECT * FROM candidates QUALIFY place = min(place) OVER (PARTITION BY from_id, callee)))
UNION ALL SELECT from_id, 'external:' || callee, 'calls', 0.0, 'external', 'no symbol of that name' FROM located WHERE callee NOT IN (SELECT name FROM indexed)""",
        "lines": LINES.format(documents="documents", conversations="conversations", each=", LATERAL (SELECT generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k, unnest(string_split(coalesce(text, ''), chr(10))) AS line)"),
        "captures": "SELECT concat_ws(':', origin, l.id, spot, l.kind) AS capture, path, span_start + spot % loc AS line, l.kind FROM ("
        + " UNION ALL ".join(f"SELECT *, '{k}' AS kind FROM lines WHERE regexp_matches(line, '{WORD.format(v)}')" for k, v in KEYWORDS.items())
        + ") l JOIN symbols0 s ON s.id = l.id",
        "rules": RULES.replace("array('lock', 'spawn')", "['lock', 'spawn']").replace("array('alloc', 'loop')", "['alloc', 'loop']"),
        "last_commits": "SELECT path, count(DISTINCT sha) AS churn, max_by(sha, (ts, sha)) AS last_commit_sha, max(ts) AS last_commit_ts FROM commit_files JOIN commits USING (sha) GROUP BY path",
        "git_stats": f"SELECT path, churn, last_commit_sha, last_commit_ts, {age} AS age_days, churn / (SELECT greatest(max(churn), 1) FROM last_commits) * exp(-0.003 * {age}) AS hotspot FROM last_commits",
        "file_stats": "SELECT f.path, f.lang, f.loc, g.churn, g.age_days, g.last_commit_sha, g.last_commit_ts, g.hotspot FROM files f JOIN git_stats g USING (path)",
        "pairs": "SELECT a.path AS file_a, b.path AS file_b, count(*) AS support FROM commit_files a JOIN commit_files b ON a.sha = b.sha AND a.path < b.path GROUP BY ALL",
        "cochange": "SELECT file_a, file_b, support, support / least(a.churn, b.churn) AS strength, support / b.churn AS strength_rev FROM pairs JOIN last_commits a ON a.path = file_a JOIN last_commits b ON b.path = file_b",
        "linked": """
SELECT c.from_id, s.id AS to_id, 'calls' AS kind, CASE WHEN n = 1 THEN 0.7 ELSE 0.3 END AS confidence, CASE WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution
FROM raw_calls c JOIN indexed k ON k.id = c.from_id JOIN (SELECT *, count(*) OVER (PARTITION BY name, lang) AS n FROM indexed) s ON s.name = c.callee AND s.lang = k.lang
UNION ALL
SELECT c.from_id, s.id, 'calls', CASE WHEN n = 1 THEN 0.5 ELSE 0.2 END, CASE WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END
FROM raw_calls c LEFT JOIN indexed k ON k.id = c.from_id JOIN (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM indexed) s ON s.name = c.callee
WHERE NOT EXISTS (SELECT 1 FROM indexed x WHERE x.name = c.callee AND x.lang = coalesce(k.lang, ''))
UNION ALL
SELECT from_id, 'external:' || callee, 'calls', 0.0, 'external' FROM raw_calls c WHERE NOT EXISTS (SELECT 1 FROM indexed x WHERE x.name = c.callee)""",
        "edges": "SELECT from_id, to_id, kind, max(confidence)::DOUBLE AS confidence FROM linked GROUP BY ALL",
        "fans": "SELECT id, sum(i)::BIGINT AS fanin, sum(o)::BIGINT AS fanout FROM (SELECT from_id AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT to_id, 1, 0 FROM edges) GROUP BY id",
        "span_churn": "SELECT s.id, s.path, count(DISTINCT h.sha) AS churn FROM indexed s LEFT JOIN hunks h ON h.path = s.path AND h.new_start <= s.span_end AND h.new_start + greatest(h.new_len - 1, 0) >= s.span_start GROUP BY ALL",
        "captured": "SELECT s.id, c.kind, count(*) AS n FROM indexed s JOIN captures c ON c.path = s.path AND c.line BETWEEN s.span_start AND s.span_end GROUP BY ALL",
        "patterned": "SELECT id, list(kind ORDER BY kind) AS patterns, coalesce(sum(n) FILTER (kind = 'alloc'), 0) AS n_alloc FROM captured GROUP BY id",
        "symbols": """
SELECT i.*, i.path || ':' || i.name AS qualified, c.churn, c.churn / greatest(max(c.churn) OVER (PARTITION BY i.path), 1) AS hotspot, coalesce(p.patterns, []) AS patterns, coalesce(p.n_alloc, 0) AS n_alloc,
  coalesce(f.fanin, 0) AS fanin, coalesce(f.fanout, 0) AS fanout
FROM indexed i JOIN span_churn c USING (id) LEFT JOIN patterned p USING (id) LEFT JOIN fans f USING (id)""",
        "pr_hunks": PR_HUNKS.format(hunks="hunks", orders="orders"),
        "pr_files": "SELECT DISTINCT pr, path FROM pr_hunks",
        "pr_lines": "SELECT pr, path, line, bool_or(pure) AS pure FROM (SELECT pr, path, old_len = 0 AS pure, unnest(range(new_start, new_start + new_len)) AS line FROM pr_hunks WHERE new_len > 0) GROUP BY ALL",
        "marked": """
SELECT f.pr, s.id, s.path, coalesce(touched, 0) AS touched, coalesce(pure, 0) AS pure FROM indexed s JOIN pr_files f USING (path) LEFT JOIN (
  SELECT l.pr, s.id, count(*) AS touched, count(*) FILTER (l.pure) AS pure FROM pr_lines l JOIN indexed s ON l.path = s.path AND l.line BETWEEN s.span_start AND s.span_end GROUP BY ALL) t ON t.pr = f.pr AND t.id = s.id""",
    }


CTES = _cte()


def with_tables(sql: str) -> str:
    """SQL with the logical tables that it mentions, in order."""
    import re

    needed: set[str] = set()

    def add(text: str) -> None:
        for word in set(re.findall(r"\w+", text)) & CTES.keys():
            if word not in needed:
                needed.add(word)
                add(CTES[word])

    add(sql)
    head = ", ".join(f"{k} AS ({v})" for k, v in CTES.items() if k in needed)
    if head and sql.startswith("WITH "):
        return f"WITH RECURSIVE {head}, {sql[5:]}"
    return (f"WITH RECURSIVE {head} " if head else "") + sql
