"""Document quality by Bradley-Terry ranking of preference pairs.

Each pair prefers a document labelled 1 to one labelled 0; the odds of a
preference are the exponential of the difference of the documents' scores, which
are linear in features of the text: rule statistics and their squares, and hashed words
and pairs of neighbouring words (square roots of counts, of length 1 together). Weights
minimise the logistic loss on feature differences: first those of the statistics, by
Newton steps, then those of words, by gradients, for what statistics leave open; where
they tell all pairs apart, words get little weight. The bar between accepted and rejected documents is a
quantile of the training scores; the reported score is the logistic function of
the distance to that bar.

Labels, ids, languages and sources are not features. Null and empty texts are
scored by their (all zero) statistics. Where one of the two labels is missing
there is no pair to learn from, and every score is 0.5. Texts of any length are
read whole. Repeated rows get equal scores; of an id that repeats with several
texts, one is learnt from. Documents of one score are decided alike. An empty table
gives an empty result. Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import shared, statistics, textkit

#: Labelled documents that a model is fitted on, at most.
MOST_LABELLED = 16_000
#: Buckets of words and word pairs. With ``MOST_LABELLED``, it bounds what is learnt from: two bytes a bucket and document.
BUCKETS = 1024
#: Documents of the other label that each document of the more frequent label is paired with.
PARTNERS = 16


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    words: np.ndarray
    bar: float
    spread: float

    def score(self, x: np.ndarray, lexical: np.ndarray | float = 0.0) -> np.ndarray:
        """From statistics, and what :func:`lexical_scores` gives."""
        return 1 / (1 + np.exp(-np.clip((_spread(x, self.mean, self.scale) @ self.weights + lexical - self.bar) / self.spread, -30, 30)))

    def score_texts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return self.score(statistics.features(statistics.statistics(data, offs)), lexical_scores(data, offs, self.words))


def _spread(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.concatenate([z, z**2], axis=1)


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, square root of the count) of words in lower case and pairs of neighbouring ones, a row for each text and bucket."""
    s, e, first = textkit.word_spans(data, offs)
    own = textkit.owner(first)
    prefix = textkit.prefix_hash(textkit.FOLDED_VALUES[data])
    word = textkit.mix(textkit.span_hash(prefix, s, e) + (e - s).astype(np.uint64))
    beside = np.flatnonzero(own[1:] == own[:-1])
    pair = textkit.mix(word[beside] * np.uint64(textkit.BASE) + word[beside + 1])
    key = np.concatenate([own * BUCKETS + (word % np.uint64(BUCKETS)).astype(np.int64), own[beside] * BUCKETS + (pair % np.uint64(BUCKETS)).astype(np.int64)])
    at, count = np.unique(key, return_counts=True)
    return at // BUCKETS, at % BUCKETS, np.sqrt(count)


def lexical_scores(data: np.ndarray, offs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    if not weights.any():
        return np.zeros(n)
    text, bucket, root = _words(data, offs)
    length = np.sqrt(np.maximum(np.bincount(text, root**2, n), 1))
    return np.bincount(text, root * weights[bucket], n) / length


def lexical_rows(data: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """A vector of ``BUCKETS`` half floats for each text."""
    text, bucket, root = _words(data, offs)
    out = []
    begins = np.searchsorted(text, np.arange(len(offs)))
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        row = np.zeros(BUCKETS, np.float16)
        row[bucket[a:b]] = root[a:b] / max(np.sqrt((root[a:b] ** 2).sum()), 1)
        out.append(row.tobytes())
    return out


def pairs(good: np.ndarray, partners: int = PARTNERS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(preferred, other) in turns: each document of the more frequent label with ``partners`` of the other, all of which have about as many turns."""
    many, few = (good, ~good) if 2 * good.sum() >= len(good) else (~good, good)
    a, b = np.flatnonzero(many), np.flatnonzero(few)
    turns = min(partners, len(b))
    met = [(a, b[(np.arange(len(a)) + t * (1 + len(b) // turns)) % len(b)]) for t in range(turns)]
    return met if many is good else [(y, x) for x, y in met]


def _lost(p: list[tuple[np.ndarray, np.ndarray]], score: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean loss of the turns' pairs, added up over documents, and its derivative by each document's score."""
    loss, slope = 0.0, np.zeros(len(score))
    for good, bad in p:
        margin = np.clip(score[good] - score[bad], -30, 30)
        loss += float(np.log1p(np.exp(-margin)).sum())
        pull = 1 / (1 + np.exp(margin))
        slope -= np.bincount(good, pull, len(score)) - np.bincount(bad, pull, len(score))
    return loss / len(p), slope / len(p)


def fit_words(rows: np.ndarray, p: list[tuple[np.ndarray, np.ndarray]], score: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights of words on top of what documents score already: gradient steps, each as long as the loss allows."""
    v, step = np.zeros(rows.shape[1]), 1.0
    loss, slope = _lost(p, score)
    for _ in range(steps):
        gradient = rows.T @ slope.astype(np.float32) + ridge * v
        size = float(gradient @ gradient)
        if size < 1e-8:
            break
        while step > 1e-9:
            new = v - step * gradient
            new_loss, new_slope = _lost(p, score + rows @ new.astype(np.float32))
            if new_loss + ridge / 2 * float(new @ new) <= loss + ridge / 2 * float(v @ v) - step / 2 * size:
                break
            step /= 2
        else:
            break
        v, loss, slope, step = new, new_loss, new_slope, step * 2
    return v


def fit(x: np.ndarray, label: np.ndarray, words: list[bytes] | None = None, partners: int = PARTNERS, ridge: float = 1.0) -> Ranking:
    d = x.shape[1]
    good = label > 0
    if good.all() or not good.any():
        return Ranking(np.zeros(d), np.ones(d), np.zeros(2 * d), np.zeros(BUCKETS), 0.0, 1.0)
    mean, scale = x[good].mean(0), np.maximum(x[good].std(0), 1e-3)
    z = _spread(x, mean, scale)
    met = pairs(good, partners)
    w = np.zeros(2 * d)
    for _ in range(40):  # Newton steps; gradient and curvature are summed turn by turn
        gradient, curvature = ridge * w, ridge * np.eye(2 * d)
        for a, b in met:
            diff = z[a] - z[b]
            p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
            gradient = gradient + diff.T @ (p - 1)
            curvature += (diff * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ diff
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s, v = z @ w, np.zeros(BUCKETS)
    if words:
        rows = np.empty((len(words), BUCKETS), np.float32)
        for i, row in enumerate(words):
            rows[i] = np.frombuffer(row, np.float16)
        v = fit_words(rows, met, s)
        s = s + rows @ v.astype(np.float32)
    # the bar: the quantile of all scores at which labels and decisions differ least, halfway to the next score
    order = np.argsort(s, kind="stable")
    errors = np.concatenate([[0], np.cumsum(np.where(good[order], 1, -1))])
    best = np.flatnonzero(errors == errors.min())
    k = int(best[len(best) // 2])
    lower, upper = s[order[max(k - 1, 0)]], s[order[min(k, len(s) - 1)]]
    return Ranking(mean, scale, w, v, float((lower + upper) / 2), float(max(np.std(s) / 4, 1e-6)))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> Ranking:
    """Fit on at most ``most`` of the labelled documents."""
    return fit(*statistics.labelled_sample(docs, labels, most, id_col, text_col, label_col, more=lexical_rows))


def score(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in textkit.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(model.score_texts(data, offs))], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(shared.thrifty(run), f"id {kind}, score double").withColumnRenamed("id", id_col)


def accept(docs: DataFrame, model: Ranking, bar: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``bar`` or more, with all their columns; no shuffle."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in textkit.slices(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(model.score_texts(data, offs) >= bar))

    return docs.mapInArrow(shared.thrifty(run), docs.schema)


def remainder(column: str, divisor: int) -> F.Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor))


def held_out_scores(docs: DataFrame, labels: DataFrame, divisor: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt without the rows of one fold."""
    model = learn(docs, labels.where(remainder("doc_id", divisor) != fold))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(remainder("doc_id", divisor) == fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
