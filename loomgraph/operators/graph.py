"""Traversals of the call graph, level by level.

A level is one join of the frontier with the edges, one aggregation and one small table in
the shared folder; the frontiers together are what is known. Edges that are unique by
their ends are read as they are, others are made one table first. Loops end
with an empty frontier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.linking import EXTERNAL
from loomgraph.runtime import discard, materialize


def _calls(edges: DataFrame, reverse: bool, unique: bool) -> DataFrame:
    """(a, b, c): calls from a to b, each once."""
    a, b = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    calls = edges.where("kind = 'calls'")
    if unique:
        return calls.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col("confidence").alias("c"))
    return materialize(calls.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.max("confidence").alias("c")), "calls")


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def reachable(edges: DataFrame, start: str, depth: int = 3, min_confidence: float = 0.0, reverse: bool = False, unique: bool = False) -> DataFrame:
    """(id, depth, path_conf): nodes within ``depth`` edges, fewest edges, and the best product of confidences of a path; the start has 0 and 1.

    A node comes up again only with a better product. Paths below ``min_confidence`` end.
    ``unique``: ``edges`` have no two calls with the same ends.
    """
    spark, calls = edges.sparkSession, _calls(edges, reverse, unique)
    levels = [spark.range(1).select(F.lit(start).alias("id"), F.lit(0).alias("depth"), F.lit(1.0).alias("path_conf"))]
    for level in range(1, depth + 1):
        found = levels[-1].join(calls, F.col("id") == F.col("a")).groupBy("b").agg(F.max(F.col("path_conf") * F.col("c")).alias("new_conf")).where(F.col("new_conf") >= min_confidence)
        old = _all(levels).groupBy("id").agg(F.max("path_conf").alias("old_conf"))
        better = found.join(old, F.col("b") == F.col("id"), "left").where("old_conf is null or new_conf > old_conf")
        now = materialize(better.select(F.col("b").alias("id"), F.lit(level).alias("depth"), F.col("new_conf").alias("path_conf")), "frontier")
        if now.isEmpty():
            discard(now)
            break
        levels.append(now)
    if not unique:
        discard(calls)
    return _all(levels).groupBy("id").agg(F.min("depth").alias("depth"), F.max("path_conf").alias("path_conf"))


def shortest_path(edges: DataFrame, start: str, end: str, depth: int = 3, min_confidence: float = 0.0, unique: bool = False) -> DataFrame:
    """(step, id, path_conf): one path with fewest edges, of those the one with the smallest ids; no rows if there is none."""
    spark, calls = edges.sparkSession, _calls(edges, False, unique)
    levels = [spark.range(1).select(F.lit(start).alias("id"), F.array(F.lit(start)).alias("path"), F.lit(1.0).alias("path_conf"))]
    for _ in range(depth if start != end else 0):
        steps = levels[-1].join(calls, F.col("id") == F.col("a")).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"), (F.col("path_conf") * F.col("c")).alias("path_conf")).where(F.col("path_conf") >= min_confidence)
        fresh = steps.join(_all(levels).select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("path", "path_conf")).alias("p")).select("id", "p.path", "p.path_conf")
        levels.append(materialize(fresh, "frontier"))
        state = levels[-1].agg(F.count("*").alias("n"), F.count_if(F.col("id") == end).alias("there")).first()
        if state["there"] or not state["n"]:
            break
    for read in [*levels[1:-1], *([] if unique else [calls])]:
        discard(read)
    return levels[-1].where(F.col("id") == end).select(F.posexplode("path").alias("step", "id"), "path_conf")


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``number``, from 0, in this order: sorted by ranges, each of which counts on from those before it."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mark", F.monotonically_increasing_id())
    table = materialize(dealt, "numbered")
    part = F.shiftright("__mark", 33)
    sizes = table.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    begins = sizes.select(F.col("part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("begins"))
    out = table.withColumn("part", part).join(F.broadcast(begins), "part")
    return out.withColumn("number", F.col("begins") + F.col("__mark").bitwiseAND((1 << 33) - 1)).drop("__mark", "part", "begins")


def tree(edges: DataFrame, symbols: DataFrame, start: str, depth: int = 3, min_confidence: float = 0.0, reverse: bool = False, unique: bool = False) -> DataFrame:
    """(number, depth, id, parent, parent_number, confidence, path_conf): the depth-first tree below ``start``, in preorder from 0.

    Children of a node go by (qualified, id), names outside of ``symbols`` (id, qualified) come
    last by name, in forward trees. A node has children only where it is met first above
    ``depth``, and a child only while the product of confidences is at least ``min_confidence``.

    A place in the tree is the list of sort keys on the way to it, so preorder is the order
    of places. Which place of a node comes first depends on what is expanded before: starting
    with the root, the children of all expanded nodes are made and each node is
    expanded at its first place among them, until nothing changes. After every round at
    least one more node in preorder is right for good.
    """
    spark, calls = edges.sparkSession, _calls(edges, reverse, unique)
    near = reachable(edges, start, depth, min_confidence, reverse, unique).select(F.col("id").alias("a"))
    steps = calls.join(near, "a")
    names = symbols.select(F.col("id").alias("b"), F.concat(F.lit("0"), F.coalesce("qualified", F.lit(""))).alias("rank"))
    outside = F.lit(None).cast("string") if reverse else F.when(F.col("b").startswith(EXTERNAL), F.concat(F.lit("1"), "b"))
    steps = steps.join(names, "b", "left").withColumn("rank", F.coalesce("rank", outside)).where("rank is not null")
    steps = materialize(steps.select("a", "b", "c", "rank", F.col("rank").startswith("1").alias("external")), "steps")

    root = spark.range(1).select(F.lit(start).alias("id"), F.array().cast("array<string>").alias("place"), F.lit(0).alias("depth"), F.lit(1.0).alias("path_conf"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("parent"), F.lit(False).alias("external"))

    def met(expanded: DataFrame) -> DataFrame:
        """The root and the children of expanded nodes."""
        above = expanded.select(F.col("id").alias("a"), F.col("place").alias("p"), F.col("depth").alias("d"), F.col("path_conf").alias("pc"))
        below = above.join(steps, "a").select(F.col("b").alias("id"), F.concat("p", F.array("rank", "b")).alias("place"), (F.col("d") + 1).alias("depth"), (F.col("pc") * F.col("c")).alias("path_conf"), F.col("c").alias("confidence"), F.col("a").alias("parent"), "external")
        return root.unionByName(below.where(F.col("external") | (F.col("path_conf") >= min_confidence)))

    expanded, state = root, None
    while True:
        first = met(expanded).where((F.col("depth") < depth) & ~F.col("external")).groupBy("id").agg(F.min(F.struct("place", "depth", "path_conf", "confidence", "parent", "external")).alias("f")).select("id", "f.*")
        now = materialize(first, "expanded")
        if state is not None:
            discard(expanded)
        before, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("id", "place").cast("decimal(38,0)"))).first()
        expanded = now
        if state == before:
            break
    rows = numbered(met(expanded), "place")
    for read in (steps, expanded, *([] if unique else [calls])):
        discard(read)
    at = rows.select(F.col("place").alias("up"), F.col("number").alias("parent_number"))
    up = F.when(F.size("place") > 0, F.slice("place", 1, F.greatest(F.size("place") - 2, F.lit(0))))
    out = rows.withColumn("above", up).join(at, F.col("above") == F.col("up"), "left")
    return out.select("number", "depth", "id", "parent", "parent_number", "confidence", "path_conf")


def _distances(calls: DataFrame, start: str, end: str, depth: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Nodes by fewest edges from ``start``, and by fewest edges to ``end``, until both together make ``depth``: the smaller frontier goes on."""
    spark = calls.sparkSession
    sides = {}
    for side, at in (("ahead", start), ("back", end)):
        sides[side] = [spark.range(1).select(F.lit(at).alias("id"))]
    size = {"ahead": 1, "back": 1}
    while len(sides["ahead"]) + len(sides["back"]) - 2 < depth:
        side = min(size, key=lambda x: size[x])
        a, b = ("a", "b") if side == "ahead" else ("b", "a")
        levels = sides[side]
        near = levels[-1].join(calls, F.col("id") == F.col(a)).select(F.col(b).alias("n")).distinct()
        levels.append(materialize(near.join(_all(levels), F.col("n") == F.col("id"), "left_anti").select(F.col("n").alias("id")), "frontier"))
        size[side] = levels[-1].count()
        if not size[side]:
            size[side] = 1 << 62  # nothing more on this side
            if min(size.values()) == 1 << 62:
                break
    return sides["ahead"], sides["back"]


def best_paths(edges: DataFrame, start: str, end: str, k: int = 20, depth: int = 3, min_confidence: float = 0.0, unique: bool = False, keep: int | None = None) -> DataFrame:
    """(rank, path, path_conf): the ``k`` best paths of at most ``depth`` edges without a node twice, by product of confidences, fewer edges, ids.

    Search from both ends leaves the edges that can lie on such a path. From the end
    backwards every node then gets its ``keep`` best ways to the end, and the first
    of those that it had to let go: ways before that one are known for certain. If fewer than
    ``k`` are certain at the start, it is done again with more.
    """
    spark, calls = edges.sparkSession, _calls(edges, False, unique)
    empty = spark.createDataFrame([], "rank int, path array<string>, path_conf double")
    if start == end:
        return empty
    ahead, back = _distances(calls, start, end, depth)
    far = lambda levels, name: _all([x.withColumn(name, F.lit(i)) for i, x in enumerate(levels)])
    from_start, to_end = far(ahead, "df"), far(back, "db")
    known = calls.join(from_start.select(F.col("id").alias("a"), "df"), "a", "left").join(to_end.select(F.col("id").alias("b"), "db"), "b", "left")
    # a node that a search didn't reach lies beyond its last level
    df, db = F.coalesce("df", F.lit(len(ahead))), F.coalesce("db", F.lit(len(back)))
    useful = known.withColumn("df", df).withColumn("db", db).where((F.col("df") + 1 + F.col("db") <= depth) & (F.col("a") != end) & (F.col("b") != start) & (F.col("c") >= min_confidence))
    useful = materialize(useful.select("a", "b", "c", "df"), "useful")
    for read in (*ahead[1:], *back[1:], *([] if unique else [calls])):
        discard(read)

    keep = keep or 2 * k
    while True:
        found = _backwards(useful, start, end, depth, min_confidence, keep)
        rows = found.where(F.col("id") == start).select(F.explode("ways").alias("w"), "lost").where("lost is null or w < lost").orderBy("w").limit(k).collect()  # k rows
        lost = found.where((F.col("id") == start) & F.col("lost").isNotNull()).isEmpty()
        discard(found)
        if len(rows) >= k or lost:
            break
        keep *= 4
    discard(useful)
    out = [(i + 1, r["w"]["path"], r["w"]["conf"]) for i, r in enumerate(rows)]
    return spark.createDataFrame(out, empty.schema) if out else empty


def _backwards(useful: DataFrame, start: str, end: str, depth: int, min_confidence: float, keep: int) -> DataFrame:
    """(id, ways, lost): ways (minus, length, path, conf) in order, and the first of those that are not among them."""
    spark = useful.sparkSession
    way = lambda path, conf: F.struct(F.round(-conf, 9).alias("minus"), F.size(path).alias("length"), path.alias("path"), conf.alias("conf"))
    last = spark.range(1).select(F.lit(end).alias("id"), F.array(way(F.array(F.lit(end)), F.lit(1.0))).alias("ways")).withColumn("lost", F.lit(None).cast(spark.range(1).select(way(F.array(F.lit(end)), F.lit(1.0)).alias("x")).schema["x"].dataType))
    now = last
    for left in range(1, depth + 1):
        steps = useful.where(F.col("df") + left <= depth)
        longer = lambda w: way(F.concat(F.array("a"), w["path"]), F.col("c") * w["conf"])
        met = steps.join(now, F.col("b") == F.col("id")).select("a", F.transform(F.filter("ways", lambda w: ~F.array_contains(w["path"], F.col("a"))), longer).alias("ways"), F.when(F.col("lost").isNotNull(), longer(F.col("lost"))).alias("lost"))
        each = met.select("a", F.explode("ways").alias("w")).where(F.col("w.conf") >= min_confidence)
        ranked = each.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("w"))).where(F.col("n") <= keep + 1)
        ways = ranked.groupBy("a").agg(F.sort_array(F.collect_list(F.when(F.col("n") <= keep, F.col("w")))).alias("ways"), F.min(F.when(F.col("n") > keep, F.col("w"))).alias("own"))
        others = met.groupBy("a").agg(F.min("lost").alias("other"))
        both = ways.join(others, "a").select(F.col("a").alias("id"), "ways", F.least("own", "other").alias("lost"))
        following = materialize(both.unionByName(last), "ways")
        if now is not last:
            discard(now)
        now = following
    return now
