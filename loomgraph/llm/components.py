"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step re-hangs every edge on the smallest neighbour seen; the number of rounds
grows with the logarithm of the longest path. Nothing is collected: a round is
one aggregation and one join, its result a table in the shared folder, and the
table of the round before is deleted.

A node with very many neighbours doesn't bring them to one task: at most ``HOT``
nodes can have more than their share of all edges, and what their edges hang on is
broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import shared

#: A node is hot with more than two in so many edge ends; that many nodes can be hot.
HOT = 1024


def _star(edges: DataFrame, large: bool, size: int) -> DataFrame:
    """One step over ``size`` edges (a, b) with a > b, about."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
    bar = max(2 * size // HOT, 16)
    # at most HOT rows, as their degrees add up to no more than twice the edges
    hot = F.broadcast(least.where(F.col("degree") > bar).select(F.col("u").alias("hot_u"), F.col("m").alias("hot_m")))
    marked = both.join(hot, F.col("a") == F.col("hot_u"), "left")
    few = marked.where("hot_u is null").select("a", "b").join(least.where(F.col("degree") <= bar).select("u", "m"), F.col("a") == F.col("u")).select("a", "b", "m")
    hung = marked.where("hot_u is not null").select("a", "b", F.col("hot_m").alias("m")).unionByName(few)
    if large:
        return hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of some edge; edges are rows (a, b)."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now, before = shared.materialize(now, "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
        larger = shared.materialize(_star(now, True, state[0]), "edges")
        shared.discard(now)
        now = shared.materialize(_star(larger, False, state[0]), "edges")
        shared.discard(larger)
