"""Joins of lines and line ranges with symbol spans.

Every join has the file as an equality key, and blocks of lines as a second one,
so that a file with very many symbols spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars

BLOCK = 64
#: Tasks over which the commits of one symbol are dealt.
SHARES = 8


def _blocks(df: DataFrame, start: str, end: str, block: int) -> DataFrame:
    first, last = (F.floor(F.col(c) / block) for c in (start, end))
    return df.where(F.col(start) <= F.col(end)).withColumn("__block", F.explode(F.sequence(first, last)))


def overlap(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs of ranges that share a line: left has path, l_start, l_end; right path, r_start, r_end. Each pair once."""
    pairs = _blocks(left, "l_start", "l_end", block).join(_blocks(right, "r_start", "r_end", block), ["path", "__block"])
    meets = (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end"))
    first = F.floor(F.greatest("l_start", "r_start") / block) == F.col("__block")
    return pairs.where(meets & first).drop("__block")


def span_churn(symbols: DataFrame, hunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, churn): commits with a hunk that overlaps the symbol; 0 without."""
    ranges = hunks.select("sha", "path", F.col("new_start").alias("l_start"), (F.col("new_start") + F.greatest(F.col("new_len") - 1, F.lit(0))).alias("l_end"))
    spans = symbols.select("id", "path", F.col("span_start").alias("r_start"), F.col("span_end").alias("r_end"))
    # pairs are dealt once, by symbol and share of the commits: a symbol of very many commits is no single task
    dealt = overlap(ranges, spans, block).select("id", "sha", F.pmod(F.xxhash64("sha"), F.lit(SHARES)).alias("share")).repartition("id", "share").distinct()
    touched = dealt.where("sha is not null").groupBy("id", "share").agg(F.count("*").alias("n")).groupBy("id").agg(F.sum("n").alias("churn"))
    return symbols.select("id").join(touched, "id", "left").select("id", F.coalesce("churn", F.lit(0)).alias("churn"))


def span_hotspot(symbols: DataFrame, churn: DataFrame) -> DataFrame:
    """(id, path, churn, hotspot): churn against the most churned symbol of the file."""
    rows = symbols.select("id", "path").join(churn, "id")
    most = F.greatest(F.max("churn").over(Window.partitionBy("path")), F.lit(1))
    return rows.withColumn("hotspot", F.col("churn") / most)


def enclosing(points: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """The narrowest span around each point (path, line): ties by start, then id. Points in no span are dropped."""
    lines = points.withColumn("l_start", F.col("line")).withColumn("l_end", F.col("line"))
    spans = symbols.select("path", "id", F.col("span_start").alias("r_start"), F.col("span_end").alias("r_end"))
    order = Window.partitionBy(*keys).orderBy(F.col("r_end") - F.col("r_start"), "r_start", "id")
    return overlap(lines, spans).withColumn("__n", F.row_number().over(order)).where("__n = 1").select(*keys, "id")


def attribute(captures: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, patterns, counts): kinds of captures inside each span, sorted, and how often each occurs."""
    lines = captures.select("path", "kind", F.col("line").alias("l_start"), F.col("line").alias("l_end"))
    spans = symbols.select("path", "id", F.col("span_start").alias("r_start"), F.col("span_end").alias("r_end"))
    each = overlap(lines, spans).groupBy("id", "kind").agg(F.count("*").alias("n"))
    return each.groupBy("id").agg(F.sort_array(F.collect_list("kind")).alias("patterns"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("counts"))


def diff_lines(hunks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, path, line, pure): lines of the new side; pure where some hunk that only adds covers it. Deletions have no lines. ``keys`` tell several diffs apart."""
    ends = F.array(F.struct(F.col("new_start").alias("at"), F.lit(1).alias("step")), F.struct((F.col("new_start") + F.col("new_len")).alias("at"), F.lit(-1).alias("step")))
    dealt = hunks.where("new_len > 0 and new_start is not null").select(*keys, "path", "new_start", "new_len", F.coalesce(F.col("old_len") == 0, F.lit(False)).cast("int").alias("only")).repartition(*keys, "path")
    steps = dealt.select(*keys, "path", "only", F.explode(ends).alias("e")).groupBy(*keys, "path", F.col("e.at").alias("at")).agg(F.sum("e.step").alias("every"), F.sum(F.col("e.step") * F.col("only")).alias("adding"))
    # between two ends no hunk begins or stops, so lines are made after the shuffle, from stretches of one kind
    order = Window.partitionBy(*keys, "path").orderBy("at")
    open_ = lambda c: F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = steps.select(*keys, "path", "at", F.lead("at").over(order).alias("stop"), open_("every").alias("every"), (open_("adding") > 0).alias("pure")).where("every > 0")
    return runs.select(*keys, "path", F.explode(F.sequence(F.col("at"), F.col("stop") - 1)).alias("line"), "pure")


def diff_ranges(hunks: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, path, pure, start, end): the lines of :func:`diff_lines` as ranges that don't touch; those with pure are the pure lines once more.

    Ranges are joined where a running maximum of ends reaches the next start; no line becomes a row.
    """
    sides = F.when(F.col("old_len") == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = hunks.where("new_len > 0").select(*keys, "path", F.explode(sides).alias("pure"), F.col("new_start").alias("start"), (F.col("new_start") + F.col("new_len") - 1).alias("end")).distinct()
    order = Window.partitionBy(*keys, "path", "pure").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(before + 1 >= F.col("start"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__run", run).groupBy(*keys, "path", "pure", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run")


def _as_ranges(lines: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Lines (keys, path, line, pure) as ranges of one line each."""
    sides = F.when(F.col("pure"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return lines.select(*keys, "path", F.explode(sides).alias("pure"), F.col("line").alias("start"), F.col("line").alias("end"))


def diff_marks(symbols: DataFrame, changes: DataFrame, untouched: str | None = None, keys: tuple[str, ...] = (), files: DataFrame | None = None) -> DataFrame:
    """(keys, id, path, touched, pure, mark): '+' all touched lines are added, '~' some changed, ``untouched`` for other symbols of changed files, which are ``files`` or those with lines.

    ``changes``: what :func:`diff_ranges` or :func:`diff_lines` gives.
    """
    ranges = changes if "start" in changes.columns else _as_ranges(changes, keys)
    left = ranges.select(*keys, "path", F.col("pure").alias("__pure"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    spans = symbols.select("path", "id", F.col("span_start").alias("r_start"), F.col("span_end").alias("r_end"))
    common = F.least("l_end", "r_end") - F.greatest("l_start", "r_start") + 1
    lines_of = lambda pure: F.sum(F.when(F.col("__pure") == pure, common).otherwise(0)).cast("long")
    changed = (ranges if files is None else files).select(*keys, "path").distinct()
    if not keys:
        hit = overlap(left, spans).groupBy("id").agg(lines_of(False).alias("touched"), lines_of(True).alias("pure"))
        out = symbols.select("id", "path").join(changed, "path").join(hit, "id", "left").select("id", "path", F.coalesce("touched", F.lit(0)).alias("touched"), F.coalesce("pure", F.lit(0)).alias("pure"))
    else:
        # what was touched is kept by symbol, the diffs of a file by file: the rows of both are made last and meet no shuffle
        key = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
        met = overlap(left, spans).select(*keys, "id", "__pure", "l_start", "l_end", "r_start", "r_end").repartition("id").groupBy(*keys, "id").agg(lines_of(False).alias("touched"), lines_of(True).alias("pure"))
        hit = met.dropna(subset=list(keys)).groupBy("id").agg(F.collect_list(F.struct(key.alias("k"), "touched", "pure")).alias("hits"))
        whose = changed.groupBy("path").agg(F.collect_list(key).alias("whose") if len(keys) > 1 else F.concat(F.collect_list(key), F.when(F.count_if(key.isNull()) > 0, F.array(F.lit(None))).otherwise(F.array())).alias("whose"))
        both = symbols.select("id", "path").join(hit, "id", "left").join(whose, "path").withColumn("hits", F.coalesce("hits", F.array()))
        touched = F.filter("hits", lambda h: F.array_contains("whose", h["k"]))
        others = F.transform(F.array_except("whose", F.transform("hits", lambda h: h["k"])), lambda k: F.struct(k.alias("k"), F.lit(0).cast("long").alias("touched"), F.lit(0).cast("long").alias("pure")))
        each = both.select("id", "path", F.explode(F.concat(touched, others)).alias("e"))
        out = each.select(*([F.col("e.k").alias(keys[0])] if len(keys) == 1 else [F.col(f"e.k.{k}").alias(k) for k in keys]), "id", "path", "e.touched", "e.pure")
    return out.withColumn("mark", F.when(F.col("touched") == 0, F.lit(untouched)).when(F.col("pure") == F.col("touched"), "+").otherwise("~"))


def diff_weight(marks: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, weight): touched lines against all lines of the diff."""
    ranges = changes if "start" in changes.columns else _as_ranges(changes, keys)
    lines = F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).cast("long")
    total = ranges.where("not pure").groupBy(*keys).agg(F.greatest(lines, F.lit(1)).alias("total"))
    both = marks.join(total, list(keys), "left") if keys else marks.crossJoin(F.broadcast(total))  # one row
    return both.select(*keys, "id", (F.col("touched") / F.coalesce("total", F.lit(1))).alias("weight"))


def resolve_targets(targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """(target, id, n): the symbol that a name, file:name or file:line stands for, and how many qualified names come into question.

    A line stands for the narrowest span around it. A name is looked up by itself and
    as a qualified one; a file narrows the candidates if it has some. ``id`` is the
    first of them by qualified name; n = 0 and no id: nothing was found.
    """
    target = F.col("target")
    asked = targets.select("target").distinct().select("target", scalars.target_file(target).alias("file"), scalars.target_name(target).alias("name"))
    is_line = F.col("file").isNotNull() & F.col("name").rlike("^[0-9]+$")
    points = asked.where(is_line).select("target", F.col("file").alias("path"), F.col("name").cast("int").alias("line"))
    at_line = enclosing(points, symbols, ["target"]).select("target", "id", F.lit(1).cast("long").alias("n"))
    named = asked.where(~is_line)
    by_name = named.join(symbols.select("name", "id", "path", "qualified"), "name").select("target", "file", "id", "path", "qualified")
    by_qualified = named.join(symbols.select(F.col("qualified").alias("target"), "id", "path"), "target").select("target", "file", "id", "path", F.col("target").alias("qualified"))
    inside = F.coalesce(F.col("path") == F.col("file"), F.lit(False))
    found = by_name.unionByName(by_qualified).groupBy("target", inside.alias("inside")).agg(F.count_distinct("qualified").alias("n"), F.min(F.struct("qualified", "id")).alias("first"))
    best = found.groupBy("target").agg(F.max(F.struct("inside", "n", "first")).alias("b")).select("target", F.col("b.first.id").alias("id"), F.col("b.n").alias("n"))
    return asked.select("target").join(at_line.unionByName(best), "target", "left").select("target", "id", F.coalesce("n", F.lit(0)).alias("n"))
