"""Items that occur together, for baskets of any size.

Rare items go first, as a pair is no more frequent than its items. A basket is cut into
chunks of about ``BLOCK`` items, and its pairs are made chunk by chunk, so a basket of very many
items spreads over many tasks. Pairs are made twice: once to count them by a
hash of the pair in ``SIEVE`` buckets (at most that many rows, and each task adds up its own
first), and once to count those whose bucket reached the bar. So a pair that is too rare
seldom gets a row of its own in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import spans
from loomgraph.runtime import materialize

BLOCK, SIEVE = 256, 1 << 20


def frequent_rows(baskets: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """(basket, item, chunk, chunks) of items that are in at least ``least`` baskets."""
    rows = baskets.select("basket", "item").where("basket is not null and item is not null").distinct()
    often = rows.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("item")
    rows = rows.join(often, "item", "left_semi")
    chunks = rows.groupBy("basket").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    return rows.join(chunks, "basket").select("basket", "item", F.pmod(F.xxhash64("item"), "chunks").cast("int").alias("chunk"), "chunks")


def pairs(rows: DataFrame) -> DataFrame:
    """(a, b) with a < b, once for each basket that has both."""
    low = rows.select("basket", F.col("item").alias("x"), F.col("chunk").alias("lo"), F.explode(F.sequence(F.col("chunk"), F.col("chunks") - 1)).alias("hi"))
    high = rows.select("basket", F.col("item").alias("y"), F.explode(F.sequence(F.lit(0), F.col("chunk"))).alias("lo"), F.col("chunk").alias("hi"))
    met = low.join(high, ["basket", "lo", "hi"]).where("lo < hi or x < y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def pair_support(baskets: DataFrame, least: int = 5, block: int = BLOCK, sieve: int = SIEVE) -> DataFrame:
    """(a, b, support): pairs of items of ``baskets`` (basket, item) that at least ``least`` baskets have. Repeated rows count once."""
    made = pairs(materialize(frequent_rows(baskets, least, block), "baskets"))
    bucket = F.pmod(F.xxhash64("a", "b"), F.lit(sieve))
    # at most ``sieve`` numbers
    full = F.broadcast(made.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("bucket"))
    likely = made.withColumn("bucket", bucket).join(full, "bucket", "left_semi")
    return likely.groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= least)


def touched_symbols(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """(basket, item): commits and the symbols that their hunks overlap."""
    ranges = hunks.select(F.col("sha").alias("basket"), "path", F.col("new_start").alias("l_start"), (F.col("new_start") + F.greatest(F.col("new_len") - 1, F.lit(0))).alias("l_end"))
    own = symbols.select(F.col("id").alias("item"), "path", F.col("span_start").alias("r_start"), F.col("span_end").alias("r_end"))
    return spans.overlap(ranges, own).select("basket", "item").distinct()


def symbol_cochange(symbols: DataFrame, hunks: DataFrame, least: int = 5) -> DataFrame:
    """(a, b, support, strength): symbols that the same commits change; strength: against the one that changes less often."""
    touched = materialize(touched_symbols(symbols, hunks), "touched")
    churn = touched.groupBy("item").agg(F.count("*").alias("n"))
    of = lambda side: churn.select(F.col("item").alias(side), F.col("n").alias(f"n_{side}"))
    rows = pair_support(touched, least).join(of("a"), "a").join(of("b"), "b")
    return rows.select("a", "b", "support", (F.col("support") / F.least("n_a", "n_b")).alias("strength"))
