"""Rule statistics of texts, vectorised over batches.

All are counts over the whole text. Null counts as the empty text, whose
statistics are all 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import shared, textkit


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in characters]] = 1
    return out


SYMBOLS = _table("#*$%&|<>")
BANGS = _table("!?")
UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTERS = UPPER + _table("abcdefghijklmnopqrstuvwxyz")
DIGITS = _table("0123456789")
WINDOW = 5


def window_keys(words: np.ndarray, own: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first word, key) of every window of ``size`` words that lies in one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(own[:n] == own[size - 1 :])
    key = np.zeros(n, np.uint64)
    for k in range(size):
        key = key * np.uint64(textkit.BASE) + words[k : k + n]
    return at, textkit.mix(key[at])


def within(key: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Keys that differ between texts."""
    return textkit.mix(key ^ (own.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E6C63D0876A9A47))


def statistics(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    s, e, first = textkit.word_spans(data, offs)
    own, n = textkit.owner(first), len(offs) - 1
    ends = offs[1:]

    def over(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=total[1:])
        return total[ends] - total[offs[:-1]]

    points = np.ones(256, np.int64)
    points[0x80:0xC0] = 0
    points[textkit.IS_SPACE] = 0
    out = {"n_words": np.diff(first).astype(np.int64), "word_chars": over(points), "n_symbols": over(SYMBOLS), "n_bangs": over(BANGS), "n_upper": over(UPPER), "n_letters": over(LETTERS), "n_digits": over(DIGITS)}

    prefix = textkit.prefix_hash(textkit.BYTE_VALUES[data])
    # lines: between line feeds and text borders
    feed = np.flatnonzero(data == 10)
    a, b = np.concatenate([offs[:-1], feed + 1]), np.concatenate([ends, feed])
    a.sort()
    b.sort()
    line_own = np.searchsorted(offs, a, "right") - 1
    if len(line_own):  # empty texts share their start with the next text
        line_own = np.minimum(line_own, n - 1)
    words_before = np.searchsorted(s, a), np.searchsorted(s, b)
    full = words_before[1] > words_before[0]
    a, b, line_own = a[full], b[full], line_own[full]
    line = within(textkit.mix(textkit.span_hash(prefix, a, b) + (b - a).astype(np.uint64)), line_own)
    later = pd.Series(line).duplicated().to_numpy() if len(line) else np.zeros(0, bool)
    out["n_lines"] = np.bincount(line_own, minlength=n).astype(np.int64)
    out["n_dup_lines"] = np.bincount(line_own[later], minlength=n).astype(np.int64)

    words = textkit.mix(textkit.span_hash(prefix, s, e) + (e - s).astype(np.uint64))
    at, key = window_keys(words, own)
    if len(at):
        twice = pd.Series(within(key, own[at])).duplicated(keep=False).to_numpy()
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, at[twice], 1)
        np.add.at(change, at[twice] + WINDOW, -1)
        covered = np.cumsum(change)[:-1] > 0
        out["n_repeat_words"] = textkit.sums(covered.astype(np.int64), first)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    same = np.zeros(len(words), np.int64)
    if len(words) > 1:
        same[1:] = (words[1:] == words[:-1]) & (own[1:] == own[:-1])
    out["n_same_as_previous"] = textkit.sums(same, first)
    if len(words):
        fresh = ~pd.Series(within(words, own)).duplicated().to_numpy()
        out["n_distinct_words"] = textkit.sums(fresh.astype(np.int64), first)
    else:
        out["n_distinct_words"] = np.zeros(n, np.int64)
    return out


#: Features of :func:`features`, in this order.
FEATURES = ("symbols", "bangs", "upper", "digits", "letters", "repeats", "duplicate_lines", "stutter", "distinct", "word_length", "brevity")


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios between the statistics, so that long and short texts compare."""
    words, chars = np.maximum(stats["n_words"], 1), np.maximum(stats["word_chars"], 1)
    letters = np.maximum(stats["n_letters"], 1)
    return np.stack(
        [
            stats["n_symbols"] / chars,
            stats["n_bangs"] / chars,
            stats["n_upper"] / letters,
            stats["n_digits"] / chars,
            stats["n_letters"] / chars,
            stats["n_repeat_words"] / words,
            stats["n_dup_lines"] / np.maximum(stats["n_lines"], 1),
            stats["n_same_as_previous"] / words,
            stats["n_distinct_words"] / words**0.85,
            np.minimum(stats["word_chars"] / words, 40) / 10,
            1 / np.sqrt(stats["n_words"] + 1),
        ],
        axis=1,
    )


def map_statistics(df: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[dict[str, np.ndarray]], list[pa.Array]]) -> DataFrame:
    """Apply ``make`` to the statistics of each batch; its arrays follow the id in ``schema``."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in textkit.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *make(statistics(data, offs))], names=["id", *names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(shared.thrifty(run), f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label_col: str, test: Callable[[dict[str, np.ndarray]], np.ndarray] | None = None, more: Callable[[np.ndarray, np.ndarray], list[bytes]] | None = None) -> tuple[np.ndarray, ...]:
    """(features, labels 0/1, and what ``test`` says or ``more`` makes of bytes and offsets) of at most ``most`` labelled documents, those with the smallest hashes of their ids.

    Null labels are left out; of repeated labels for one id the smallest counts, of
    repeated rows with one id the text with the smallest hash.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).cast("long").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    # at most ``most`` rows of two numbers: small enough to send to every executor
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    found = found.select("label", "id", F.xxhash64("text").alias("tag"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in textkit.slices(batch.column(3)):
                stats = statistics(data, offs)
                failed = test(stats) if test else np.zeros(b - a, bool)
                made = more(data, offs) if more else [b""] * (b - a)
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(3)), pa.array(list(features(stats)), pa.list_(pa.float64())), pa.array(failed), pa.array(made, pa.binary())], names=["label", "id", "tag", "x", "failed", "more"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = found.mapInArrow(shared.thrifty(run), f"label long, id {kind}, tag long, x array<double>, failed boolean, more binary")
    # one row for each id before any of them comes here
    rows = rows.groupBy("id").agg(F.min(F.struct("tag", "label", "x", "failed", "more")).alias("r")).select("id", "r.label", "r.x", "r.failed", *(["r.more"] if more else []))
    rows = rows.toPandas().sort_values("id")
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    out = (x, rows["label"].to_numpy(np.int64))
    if more:
        return (*out, rows["more"].tolist())
    return (*out, rows["failed"].to_numpy(bool)) if test else out
