"""Hard-negative mining: norm-bucketed exact search.

Vectors are quantised to floor(256 * x); a score is the integer inner product.
Candidates are range-partitioned by squared norm, longest first, into buckets, and
each bucket's longest norm is kept (at most ``MOST_BUCKETS`` buckets, of any
size). An anchor needs a bucket only if its own norm times that length reaches the
anchor's bar (Cauchy-Schwarz): the running kth score, and for windows the lower
limit too. A first wave meets the longest buckets and sets the bars, a second one
meets what is left of the others. Within a task, candidates stream by in order of
norm past a block of ``BLOCK`` anchors, and the bar prunes slices and anchors again.

First the positives are found (the first of the same label), then, for each anchor
and positive, the first rows of other labels with a score in the positive's window.

Rows with a null id, label or vector, or with a null or non-finite component take
no part, nor do rows whose squared norm is 2**62 or more, as their scores are no
64-bit integers. Shorter vectors count as padded with zeros. Rows that repeat
an id are rows of their own: each is an anchor, each a candidate, and an anchor
leaves out one row with its own id, label and score to itself. Ties go by id. Empty
tables give empty results. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import shared

POSITIVES, NEGATIVES = 5, 5
MOST_BUCKETS, BUCKET_ROWS = 4096, 65_536
BLOCK, SLICE = 4096, 1024
#: Buckets that the first wave meets: one in so many, the longest.
FIRST = 8
#: Float products are exact below it.
EXACT = 2.0**53
NONE = -(1 << 63)
FOUND = "anchor_key long, anchor_id long, slot int, positive_id long, positive_score long, id long, score long, own boolean"


def _quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double"))


def rows_of(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector, norm2): the rows that take part, with quantised components."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).where(finite)
    # what a long can't hold is cut to its limits by floor, and left out for its norm
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), _quantised(F.col(vector_col)).alias("vector"))
    return rows.withColumn("norm2", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).where(F.col("norm2") < 2.0**62)


def bucketed(rows: DataFrame) -> tuple[DataFrame, list[float]]:
    """The rows with a bucket number, in descending order of norm, and the longest norm of each bucket."""
    spark = rows.sparkSession
    n = rows.count()
    buckets = max(shared.shuffle_partitions(spark), min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    # the running number parts rows that agree in norm and id
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(buckets, F.desc("norm2"), "id", "row").sortWithinPartitions(F.desc("norm2"))
    table = shared.materialize(dealt.withColumn("bucket", F.spark_partition_id()), "by-norm")
    longest = {r["bucket"]: r["norm2"] ** 0.5 for r in table.groupBy("bucket").agg(F.max("norm2").alias("norm2")).collect()}  # one number a bucket
    out, least = [], float("inf")
    for b in range(max(longest, default=-1) + 1):
        least = longest.get(b, least)
        out.append(least)
    return table, out


def _matrix(vectors: pa.ListArray, width: int | None = None) -> np.ndarray:
    lengths = np.asarray(vectors.value_lengths())
    flat, most = vectors.flatten().to_numpy(zero_copy_only=False), int(lengths.max(initial=0))
    if len(lengths) and (lengths == most).all():
        out = flat.reshape(len(lengths), most)
    else:
        out = np.zeros((len(lengths), most))
        out[np.arange(most)[None] < lengths[:, None]] = flat
    return out if width is None or width == most else np.pad(out, ((0, 0), (0, max(0, width - most))))[:, :width]


def _products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    # each term is below 2**62 in size, and so is each sum; sums of terms wrap and come back
    return np.einsum("ik,jk->ij", a.astype(np.int64), b.astype(np.int64))


class Searches:
    """The anchors of one block, what each looks for, and the best found so far.

    A slot is one search of an anchor: scores from ``low`` to ``high``, of the
    anchor's own label or of others; its best rows are kept in order.
    """

    def __init__(self, rows: list[pa.RecordBatch], same: bool, k: int) -> None:
        table = pa.Table.from_batches(rows)
        col = lambda c: table.column(c).combine_chunks()
        self.key, self.id, self.label, self.norm = (col(c).to_numpy(zero_copy_only=False) for c in ("anchor_key", "id", "label", "norm"))
        self.vectors, self.same, self.k = _matrix(col("vector")), same, k
        self.slots = max(int(np.asarray(col("low").value_lengths()).max(initial=0)), 1)
        self.low, self.high = (_padded(col(c), self.slots, fill) for c, fill in (("low", 1), ("high", 0)))  # a slot that isn't there wants nothing
        self.wanted = [_padded(col(c), self.slots, 0) for c in ("positive_id", "positive_score")]
        self.best_score = np.full((len(self.key), self.slots, k), NONE)
        self.best_id, self.best_own = np.zeros_like(self.best_score), np.zeros(self.best_score.shape, bool)
        self.bar = _padded(col("bar"), self.slots, 0)  # running kth score

    def needs(self) -> np.ndarray:
        """The score that a row must reach to be of use to an anchor."""
        return np.where(self.low <= self.high, np.maximum(self.low, self.bar), np.iinfo(np.int64).max).min(1)

    def meet(self, ids: np.ndarray, labels: np.ndarray, norms: np.ndarray, vectors: pa.ListArray) -> bool:
        """Look at some rows, the longest first; whether shorter ones can still be of use."""
        alive = np.flatnonzero(self.norm * norms[0] * (1 + 1e-9) >= self.needs())
        if not alive.size:
            return False
        scores = _products(self.vectors[alive], _matrix(vectors, self.vectors.shape[1]), float(self.norm[alive].max() * norms[0]))
        allowed = (self.label[alive][:, None] == labels[None]) == self.same
        for slot in range(self.slots):
            fits = allowed & (scores >= np.maximum(self.low, self.bar)[alive, slot][:, None]) & (scores <= self.high[alive, slot][:, None])
            if fits.shape[1] > self.k:  # the kth score of this slice alone is a bar, too
                kth = -np.partition(-np.where(fits, scores, NONE + 1), self.k - 1, axis=1)[:, self.k - 1]
                fits &= scores >= kth[:, None]
            at, which = np.nonzero(fits)
            if at.size:
                self._keep(slot, alive[at], ids[which], scores[at, which])
        return True

    def _keep(self, slot: int, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched = np.unique(at)
        old_score, old_id, old_own = (x[touched, slot].ravel() for x in (self.best_score, self.best_id, self.best_own))
        there = old_score != NONE
        own = (ids == self.id[at]) & (scores == self._self(at))
        at = np.concatenate([np.repeat(touched, self.k)[there], at])
        score, ident, mine = np.concatenate([old_score[there], scores]), np.concatenate([old_id[there], ids]), np.concatenate([old_own[there], own])
        order = np.lexsort((ident, -score, at))
        at, score, ident, mine = at[order], score[order], ident[order], mine[order]
        begins = np.searchsorted(at, touched)
        rank = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
        stay = rank < self.k
        self.best_score[touched, slot] = NONE
        self.best_score[at[stay], slot, rank[stay]], self.best_id[at[stay], slot, rank[stay]], self.best_own[at[stay], slot, rank[stay]] = score[stay], ident[stay], mine[stay]
        full = self.best_score[:, slot, self.k - 1]
        self.bar[:, slot] = np.maximum(self.bar[:, slot], full)

    def _self(self, at: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_norm2"):
            self._norm2 = np.einsum("ik,ik->i", self.vectors.astype(np.int64), self.vectors.astype(np.int64))
        return self._norm2[at]

    def found(self) -> pa.RecordBatch:
        a, s, r = np.nonzero(self.best_score != NONE)
        columns = [self.key[a], self.id[a], s.astype(np.int32), self.wanted[0][a, s], self.wanted[1][a, s], self.best_id[a, s, r], self.best_score[a, s, r], self.best_own[a, s, r]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in FOUND.split(", ")])


def _padded(lists: pa.ListArray, width: int, fill: int) -> np.ndarray:
    out = np.full((len(lists), width), fill, np.int64)
    lengths = np.asarray(lists.value_lengths())
    out[np.arange(width)[None] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _search(same: bool, k: int):  # noqa: ANN202
    """Streams sorted rows: for each bucket and block of anchors, the anchors and then the candidates by norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = searches = None
        waiting: list[pa.RecordBatch] = []
        more = True
        for batch in batches:
            bucket, block, kind = (batch.column(c).to_numpy() for c in ("bucket", "block", "kind"))
            cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                if at != (here := (bucket[a], block[a])):
                    if searches is not None:
                        yield searches.found()
                    at, searches, waiting, more = here, None, [], True
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    waiting.append(part)
                    continue
                if searches is None and waiting:
                    searches, waiting = Searches(waiting, same, k), []
                if searches is None or not more:
                    continue  # no anchor needs this bucket, or none needs its shorter rows
                for s in range(0, part.num_rows, SLICE):
                    rows = part.slice(s, SLICE)
                    if not (more := searches.meet(*(rows.column(c).to_numpy() for c in ("id", "label", "norm")), rows.column("vector"))):
                        break
        if searches is not None:
            yield searches.found()

    return run


def _wave(anchors: DataFrame, table: DataFrame, longest: list[float], first: int, last: int, same: bool, k: int, blocks: int) -> DataFrame:
    """What buckets ``first`` to ``last`` (not included) hold for the anchors that need them."""
    need = F.array_min(F.transform(F.arrays_zip("low", "bar"), lambda x: F.greatest(x["low"], x["bar"])))
    reach = F.size(F.filter(F.array(*map(F.lit, longest[first:last])), lambda length: F.col("norm") * length * (1 + 1e-9) >= need))
    some = anchors.withColumn("reach", reach).where("reach > 0")
    some = some.withColumn("bucket", F.explode(F.sequence(F.lit(first), F.lit(first - 1) + F.col("reach"))))
    some = some.select("bucket", F.pmod(F.xxhash64("anchor_key"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "label", "norm", "vector", "anchor_key", "low", "high", "bar", "positive_id", "positive_score")
    nothing = [F.lit(None).cast(some.schema[c].dataType).alias(c) for c in ("anchor_key", "low", "high", "bar", "positive_id", "positive_score")]
    farthest = some.agg(F.max("bucket")).first()[0]
    rows = table.where((F.col("bucket") >= first) & (F.col("bucket") <= (first - 1 if farthest is None else farthest)))
    # every block of the query set meets every bucket that some anchor needs
    rows = rows.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "label", F.sqrt("norm2").alias("norm"), "vector", *nothing)
    spark = table.sparkSession
    dealt = some.unionByName(rows).repartition(shared.shuffle_partitions(spark), "bucket", "block").sortWithinPartitions("bucket", "block", "kind", F.desc("norm"))
    return dealt.mapInArrow(_search(same, k), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_key", "slot").orderBy(F.desc("score"), "id", F.desc("own"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(anchors: DataFrame, table: DataFrame, longest: list[float], same: bool, k: int, blocks: int) -> DataFrame:
    """The ``k`` best rows of every slot of every anchor, with their ranks."""
    first = max(1, len(longest) // FIRST)
    early = shared.materialize(_best(_wave(anchors, table, longest, 0, first, same, k, blocks), k), "first-wave")
    if first >= len(longest):
        return early
    kth = early.where(F.col("rank") == k).groupBy(F.col("anchor_key").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("kth"))
    raised = anchors.join(kth, F.col("anchor_key") == F.col("of"), "left")
    bar = F.transform("bar", lambda old, i: F.greatest(old, F.coalesce(F.try_element_at("kth", i), old)))
    late = _wave(raised.withColumn("bar", bar).drop("of", "kth"), table, longest, first, len(longest), same, k, blocks)
    out = shared.materialize(_best(early.drop("rank").unionByName(late), k), "best")
    shared.discard(early)
    return out


def mine(
    table: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: tuple[int, int] = (80, 100),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` tells anchors by the column ``id``. A negative's score is at most the
    positive's, and at least ``low`` (numerator, denominator) of it.
    """
    spark = table.sparkSession
    rows, longest = bucketed(rows_of(table, id_col, vector_col, label_col))
    some = rows.where(is_anchor).withColumn("anchor_key", F.monotonically_increasing_id()).select("anchor_key", "id", "label", F.sqrt("norm2").alias("norm"), "vector")
    some = shared.materialize(some, "anchors")
    blocks = max(1, -(-some.count() // BLOCK))
    none = F.array().cast("array<long>")
    everything = some.select("*", F.array(F.lit(NONE)).alias("low"), F.array(F.lit((1 << 63) - 1)).alias("high"), F.array(F.lit(NONE)).alias("bar"), none.alias("positive_id"), none.alias("positive_score"))
    if not longest:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    # one more than asked, as the anchor may find itself
    best = search(everything, rows, longest, True, positives + 1, blocks)
    itself = Window.partitionBy("anchor_key")
    near = best.withColumn("own_rank", F.min(F.when(F.col("own"), F.col("rank"))).over(itself)).where("own_rank is null or rank <> own_rank")
    near = near.withColumn("place", F.row_number().over(itself.orderBy("rank"))).where(F.col("place") <= positives)
    top, bottom = low
    # a window's lower limit, rounded up; below zero there is no window
    limit = F.when(F.col("score") >= 0, F.ceil(F.col("score").cast("decimal(38,0)") * top / F.lit(bottom).cast("decimal(10,0)")).cast("long")).otherwise(F.lit((1 << 63) - 1))
    windows = near.groupBy("anchor_key").agg(F.sort_array(F.collect_list(F.struct("place", F.col("id").alias("positive"), "score", limit.alias("limit")))).alias("w"))
    asked = some.join(windows.withColumnRenamed("anchor_key", "of"), F.col("anchor_key") == F.col("of"))
    asked = asked.select(*some.columns, F.col("w.limit").alias("low"), F.col("w.score").alias("high"), F.transform("w", lambda _: F.lit(NONE)).alias("bar"), F.col("w.positive").alias("positive_id"), F.col("w.score").alias("positive_score"))
    asked = shared.materialize(asked, "windows")
    shared.discard(best)
    hard = search(asked, rows, longest, False, negatives, blocks)
    for read in (rows, some, asked):
        shared.discard(read)
    return hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, own, id AS positive_id, score AS positive_score FROM s WHERE label = own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE s.label <> p.own AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
