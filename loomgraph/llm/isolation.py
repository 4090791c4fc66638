"""Quality rules with an isolation forest over rule statistics.

Two plain rules come first (too few words; too many words in repeated windows).
For the rest, each tree splits a sample of good documents at random: a statistic
drawn at random, in proportion to the spread of its values there, at a random value
of it, until every document of the sample stands alone. A document goes down the
tree, and at each node a random split may part it from all of the sample there, the
likelier the further it lies outside of their ranges. Its path length is how many
splits that takes on average; the shorter the mean of it over all trees, the odder
the document. How odd a document may be is calibrated on the labels of good and bad
ones.

Null and empty texts have no words and fail the first rule. Texts of any length are
read whole, and statistics are shares, so that lengths compare. Without labels of
both kinds nothing is rejected by the forest. Equally odd documents are judged
alike, and so are repeated rows, each from its own text; an empty table gives an
empty result. Other columns are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm import statistics

#: Labelled documents used at most; trees; documents a tree.
MOST_LABELLED, TREES, SAMPLE = 16_000, 64, 64
#: Good documents that the forest may reject, as a share of the labelled ones.
LOST_GOOD = 0.001
EULER = 0.5772156649015329
#: Statistics in units of their spread among good documents, at most.
FARTHEST = 50.0


def usual_path(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search among n: what a leaf of n documents would still add."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Tree:
    """Nodes; the children of a node are ``child`` and the one after it, and leaves have none (-1)."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    rest: np.ndarray  # what a leaf still adds
    low: np.ndarray  # nodes x statistics: ranges of the sample
    high: np.ndarray

    def path(self, x: np.ndarray) -> np.ndarray:
        """Expected number of splits until each row of ``x`` is alone."""
        total, reach = np.zeros(len(x)), np.ones(len(x))
        rows, node, level = np.arange(len(x)), np.zeros(len(x), np.int64), 0
        spread = (self.high - self.low).sum(1)
        while len(rows):
            here = x[rows]
            outside = (np.maximum(self.low[node] - here, 0) + np.maximum(here - self.high[node], 0)).sum(1)
            parted = outside / np.maximum(outside + spread[node], 1e-12)
            level += 1
            total[rows] += reach[rows] * parted * level
            reach[rows] *= 1 - parted
            leaf = self.child[node] < 0
            total[rows[leaf]] += reach[rows[leaf]] * (level - 1 + self.rest[node[leaf]])
            rows, node, here = rows[~leaf], node[~leaf], here[~leaf]
            node = self.child[node] + (here[np.arange(len(rows)), self.feature[node]] >= self.cut[node])
        return total


def grow_tree(x: np.ndarray, rng: np.random.Generator, depth: int) -> Tree:
    feature, cut, child, rest, low, high = [], [], [], [], [], []

    def add(part: np.ndarray) -> int:
        for column, value in ((feature, 0), (cut, 0.0), (child, -1), (rest, float(usual_path(len(part)))), (low, part.min(0)), (high, part.max(0))):
            column.append(value)
        return len(feature) - 1

    todo = [(add(x), x, 0)]
    while todo:
        node, part, level = todo.pop()
        spread = high[node] - low[node]
        if level == depth or not spread.sum() > 0:
            continue
        k = int(rng.choice(len(spread), p=spread / spread.sum()))
        at = rng.uniform(low[node][k], high[node][k])
        right = part[:, k] >= at
        if right.all() or not right.any():
            continue
        feature[node], cut[node], child[node] = k, at, len(feature)
        todo += [(add(part[~right]), part[~right], level + 1), (add(part[right]), part[right], level + 1)]
    return Tree(*(np.array(c) for c in (feature, cut, child, rest, low, high)))


@dataclass
class Forest:
    trees: list[Tree]
    middle: np.ndarray
    scale: np.ndarray
    norm: float
    bar: float = np.inf

    def oddness(self, x: np.ndarray) -> np.ndarray:
        """Of each row: 2 ** -(mean path over all trees / usual path), near 1 for documents that stand alone early."""
        z = np.clip((x - self.middle) / self.scale, -FARTHEST, FARTHEST)
        z, row = np.unique(z, axis=0, return_inverse=True) if len(z) else (z, np.zeros(0, np.int64))
        total = np.zeros(len(z))
        for tree in self.trees:
            total += tree.path(z)
        return (2 ** -(total / len(self.trees) / self.norm))[row.reshape(-1)]

    def kept(self, odd: np.ndarray) -> np.ndarray:
        return odd < self.bar


def grow(x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 11) -> Forest:
    """Trees on random samples of the rows."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    middle, scale = np.median(x, 0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - middle) / scale, -FARTHEST, FARTHEST)
    depth = 2 + int(np.ceil(np.log2(max(sample, 2))))
    grown = [grow_tree(z[rng.choice(len(z), sample, replace=False)], rng, depth) for _ in range(trees)]
    return Forest(grown, middle, scale, float(max(usual_path(sample), 1e-9)))


def fit(x: np.ndarray, label: np.ndarray, failed: np.ndarray | None = None, lost_good: float = LOST_GOOD, weight: int = 20) -> Forest | None:
    """The bar is the one that rejects most bad rows, a good one counting as ``weight`` bad ones and at most a share of ``lost_good`` of them; rows that fail the plain rules have no say."""
    use = np.ones(len(x), bool) if failed is None else ~failed
    x, good = x[use], label[use] > 0
    if not good.any() or good.all():
        return None
    forest = grow(x[good])
    odd = forest.oddness(x)
    values = np.unique(odd)
    bars = (values[1:] + values[:-1]) / 2
    if len(bars):
        lost = good.sum() - np.searchsorted(np.sort(odd[good]), bars, "left")
        caught = (~good).sum() - np.searchsorted(np.sort(odd[~good]), bars, "left")
        gain = np.where(lost <= lost_good * good.sum(), caught - weight * lost, -1)
        if gain.max() > 0:
            best = np.flatnonzero(gain == gain.max())
            forest.bar = float(bars[best].mean())  # as far from the good ones as from the bad ones
    return forest


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


def apply_rules(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, oddness."""
    forest = fit(*statistics.labelled_sample(docs, labels, most, id_col, text_col, label_col, base_failed))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def make(stats: dict[str, np.ndarray]) -> list[pa.Array]:
        failed = base_failed(stats)
        odd = forest.oddness(statistics.features(stats)) if forest else np.zeros(len(failed))
        kept = ~failed & (forest.kept(odd) if forest else True)
        return [*(pa.array(stats[c]) for c in counts), pa.array(failed), pa.array(kept), pa.array(odd)]

    return statistics.map_statistics(docs, id_col, text_col, ", ".join([*(f"{c} long" for c in counts), "base_failed boolean", "kept boolean", "oddness double"]), make)
