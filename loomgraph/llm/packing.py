"""Packing token sequences by cutting-stock column generation.

Every document becomes full pieces of ``capacity`` tokens and one remainder.
The histogram of the remainders' lengths, in at most ``bins`` classes of about
equal token mass, is the demand of a cutting-stock problem. A linear program
over patterns (how many pieces of each class fill a sequence) is solved by
column generation: duals price the classes, a knapsack dynamic program finds the
best new pattern. Solutions are rounded down, the few left-over pieces are
patterned greedily, and pieces, ranked within their class, take the patterns'
places by arithmetic on their rank.

The driver sees the histogram (at most ``capacity`` rows) and the patterns (a
few for each class) only. Null or empty texts are the end token alone. Equal
lengths are ordered by document, start and checksum, so the result is a function of
the input. Repeated rows are packed once each; they are interchangeable.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import shared, textkit, transducer

CAPACITY = 4096
BINS = 256
#: Column generation ends when the bound of the pricing step shows the cost to be within this share of the optimum.
GAP = 0.0005
#: It also ends after so many steps that don't lower the cost (degenerate small tables).
STALL = 150
#: Lengths are multiples of this in the knapsack.
UNIT = 4
#: Bytes of text that a task cuts into tokens at a time (a longer text alone): each takes some 60 bytes of memory on the way.
SLICE = 1 << 20


def pieces(df: DataFrame, tokenizer_path: str, end_token: int = 2, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): documents cut after every ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer.load(tokenizer_path)
        for batch in batches:
            for a, b, data, offs in textkit.slices(batch.column(1), SLICE):
                raw, edge = data.tobytes(), offs.tolist()
                texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip(edge, edge[1:], strict=False)]
                row, start, length, crc, total = [], [], [], [], []
                for i, ids in enumerate(transducer.encode(machine, texts)):
                    ids = np.append(ids, np.uint32(end_token)).astype("<u4")
                    for s in range(0, len(ids), capacity):
                        part = ids[s : s + capacity]
                        row.append(a + i)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                        total.append(len(ids))
                cols = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *cols], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(shared.thrifty(run), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    return out.withColumnRenamed("id", id_col)


def classes(lengths: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Upper ends of at most ``bins`` length classes of about equal token mass: all lengths that occur, or else multiples of ``UNIT``."""
    if len(lengths) <= bins:
        return lengths
    mass = np.cumsum(lengths * counts) / float((lengths * counts).sum())
    at = np.searchsorted(mass, np.arange(1, bins + 1) / bins - 1e-12)
    return np.unique(-(-lengths[np.minimum(at, len(lengths) - 1)] // UNIT) * UNIT)


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the worthiest multiset of sizes that fits in ``capacity``, by dynamic programming over capacities."""
    order = np.argsort(sizes, kind="stable")
    order = order[worth[order] > 0]
    s, w = sizes[order], worth[order]
    value, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    for c in range(int(s[0]) if len(s) else capacity + 1, capacity + 1):
        k = np.searchsorted(s, c, "right")
        gain = value[c - s[:k]] + w[:k]
        i = int(gain.argmax())
        value[c] = value[c - 1]
        if gain[i] > value[c]:
            value[c], taken[c] = gain[i], i
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            pattern[order[taken[c]]] += 1
            c -= int(s[taken[c]])
    return float(value[capacity]), pattern


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Patterns with how often each is used; together they meet the demand exactly."""
    m = len(sizes)
    if not m:
        return []
    unit = UNIT if capacity % UNIT == 0 and not (sizes % UNIT).any() else 1
    coarse, room = sizes // unit, capacity // unit
    basis = np.diag(room // coarse).astype(float)
    inverse, amount = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    bound, low, since = 0.0, np.inf, 0
    while since < STALL:
        duals, cost = inverse.sum(axis=0), float(amount.sum())
        since = since + 1 if cost > low * (1 - 1e-5) else 0
        low = min(low, cost)
        value, pattern = best_pattern(coarse, duals, room)
        bound = max(bound, cost / max(value, 1.0))  # the optimum is not below this
        if cost <= bound * (1 + gap):
            break
        on = np.flatnonzero(pattern)
        move = (inverse[:, on] * pattern[on]).sum(axis=1)
        ratio = np.where(move > 1e-9, amount / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        amount = np.maximum(amount - ratio[out] * move, 0)
        amount[out] = ratio[out]
        basis[:, out] = pattern
        pivot = inverse[out] / move[out]
        inverse -= move[:, None] * pivot
        inverse[out] = pivot
    used, left = [], demand.astype(np.int64).copy()
    for k in np.argsort(-amount, kind="stable").tolist():
        pattern = basis[:, k].astype(np.int64)
        n = int(amount[k] + 1e-7)
        if (on := pattern > 0).any():
            n = min(n, int((left[on] // pattern[on]).min()))
        if n > 0:
            used.append((pattern, n))
            left -= n * pattern
    by_size = np.argsort(-sizes, kind="stable").tolist()
    while left.any():  # what rounding left over: largest first, repeated as often as it goes
        pattern, room_left = np.zeros(m, np.int64), capacity
        for k in by_size:
            pattern[k] = min(left[k], room_left // sizes[k])
            room_left -= int(pattern[k] * sizes[k])
        on = pattern > 0
        n = int((left[on] // pattern[on]).min())
        used.append((pattern, n))
        left -= n * pattern
    return used


def places(patterns: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per class: first rank, pieces a sequence, and first sequence of each pattern that uses the class."""
    found: dict[int, list[list[int]]] = {}
    sequence = 0
    for pattern, n in patterns:
        for k in np.flatnonzero(pattern).tolist():
            rows = found.setdefault(k, [])
            rank = rows[-1][3] if rows else 0
            rows.append([rank, int(pattern[k]), sequence, rank + n * int(pattern[k])])
        sequence += n
    return {k: tuple(np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:3]) for k, rows in found.items()}


def pack(cut: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, bins: int = BINS, rows_a_rank_group: int = 100_000) -> DataFrame:
    """Add sequence_id and offset to the rows of :func:`pieces`."""
    histogram = sorted((r["length"], r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect())
    lengths, counts = (np.array(x, np.int64) for x in (zip(*histogram, strict=True) if histogram else ((), ())))
    ends = classes(lengths, counts, bins)
    at = np.searchsorted(ends, lengths)
    demand = np.bincount(at, counts, len(ends)).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    table = places(solve(ends, demand, capacity))
    # a class may hold any share of all pieces: its ranks are made of counts of hash groups and ranks within them
    groups = max(64, -(-int(demand.max(initial=0)) // rows_a_rank_group))
    ends_list = ends.tolist()

    def class_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.searchsorted(np.array(ends_list), batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(k.astype(np.int32))], names=[*batch.schema.names, "class"])

    def sequence_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rank, kind, out = pdf["rank"].to_numpy(), pdf["class"].to_numpy(), np.zeros(len(pdf), np.int64)
            for k in np.unique(kind).tolist():
                first, each, sequence = table[k]
                on = kind == k
                p = np.searchsorted(first, rank[on], "right") - 1
                out[on] = sequence[p] + (rank[on] - first[p]) // each[p]
            yield pdf.drop(columns=["rank"]).assign(sequence_id=out)

    columns = [f"`{c}` {t}" for c, t in cut.dtypes]
    cells = cut.mapInArrow(shared.thrifty(class_of), ", ".join([*columns, "class int"])).withColumn("cell", F.pmod(F.xxhash64(F.col(id_col), F.col("start"), F.col("ids_crc32")), F.lit(groups)))
    sizes = cells.groupBy("class", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("class", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("class", "cell").orderBy(F.col("length").desc(), id_col, "start", "ids_crc32")
    ranked = cells.join(sizes, ["class", "cell"]).withColumn("rank", F.col("before") + F.row_number().over(within) - 1).select(*cut.columns, "class", "rank")
    placed = ranked.mapInPandas(sequence_of, ", ".join([*columns, "class int", "sequence_id long"]))
    along = Window.partitionBy("sequence_id").orderBy(F.col("class").desc(), F.col("length").desc(), id_col, "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0))).drop("class")


def pack_documents(df: DataFrame, tokenizer_path: str, end_token: int = 2, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Cut and pack a table of texts: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(shared.materialize(pieces(df, tokenizer_path, end_token, id_col, text_col, capacity), "pieces"), id_col, capacity)
