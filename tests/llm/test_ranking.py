"""The quality classifier: an independent fit of the same loss, words where statistics say nothing, ties, null and repeated rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from loomgraph.llm import ranking, statistics


def loss(z, label_pairs, w, ridge=1.0):
    return sum(np.log1p(np.exp(-(z[a] - z[b]) @ w)) for a, b in label_pairs) + ridge / 2 * w @ w


def test_statistics_part_is_the_least_loss_found_otherwise():
    """Coordinate search on the loss, pair by pair, without any of the fit's own steps."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 2)) + np.repeat([[0.0, 0.0], [1.0, -0.5]], 20, axis=0)
    label = np.repeat([1, 0], 20)
    model = ranking.fit(x, label, partners=3)
    mean, scale = x[label > 0].mean(0), x[label > 0].std(0)
    z = (x - mean) / scale
    z = np.concatenate([z, z**2], axis=1)
    met = [(int(a), int(b)) for good, bad in ranking.pairs(label > 0, 3) for a, b in zip(good, bad, strict=True)]
    assert all(label[a] == 1 and label[b] == 0 for a, b in met) and len(met) == len(set(met)) == 60
    w, step = np.zeros(4), 1.0
    while step > 1e-7:
        moved = False
        for k in range(4):
            for sign in (1, -1):
                new = w.copy()
                new[k] += sign * step
                if loss(z, met, new) < loss(z, met, w):
                    w, moved = new, True
        step = step if moved else step / 2
    assert np.allclose(model.weights, w, atol=1e-4)


def test_pairs_use_both_labels_evenly():
    for n_good, n_bad in ((50, 7), (7, 50), (1, 1), (20, 20)):
        good = np.array([True] * n_good + [False] * n_bad)
        met = ranking.pairs(good)
        assert all(good[a].all() and not good[b].any() for a, b in met)
        turns = np.bincount(np.concatenate([x for p in met for x in p]), minlength=len(good))
        assert turns[~good].max() - turns[~good].min() <= max(2, turns[~good].min()) and turns.min() >= 1


def prose(rng, words, n=60):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def lexical(spark):
    """Two kinds of text that agree in all statistics: equally many words of the same lengths from two vocabularies."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    one, two, both = [[word() for _ in range(60)] for _ in range(3)]
    rows = [(i, prose(rng, (one if i % 2 else two) + both)) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2, 0) for i in range(600)], "doc_id long, quality int, toxic int")


def test_words_tell_what_statistics_do_not(lexical):
    docs, labels = lexical
    rows = ranking.held_out_scores(docs, labels).where("held_out").collect()
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in rows]) > 0.95
    x, label, _ = statistics.labelled_sample(docs, labels.where("doc_id % 3 > 0"), 16_000, "doc_id", "text", "quality", more=ranking.lexical_rows)
    plain = ranking.fit(x, label)
    test = x[:150]
    assert abs(np.mean((plain.score(test) >= 0.5) == (label[:150] > 0)) - 0.5) < 0.25


def test_scores_of_slices_are_those_of_rows():
    rng = random.Random(1)
    texts = ["", "One two", "ONE two", "x", *(prose(rng, ["aa", "b", "Ccc", "é"], n) for n in (3, 50, 700))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    weights = np.random.default_rng(1).normal(size=ranking.BUCKETS)
    rows = [np.frombuffer(r, np.float16).astype(float) for r in ranking.lexical_rows(data, offs)]
    got = ranking.lexical_scores(data, offs, weights)
    assert np.allclose(got, [r @ weights for r in rows], atol=2e-2)
    assert got[0] == 0 and got[1] == got[2]
    alone = [ranking.lexical_scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), weights)[0] for t in texts]
    assert np.allclose(got, alone)


def test_ties_nulls_and_repeated_rows(spark, lexical):
    docs, labels = lexical
    more = spark.createDataFrame([(9000, "same words here"), (9001, "same words here"), (9001, "same words here"), (None, "same words here"), (9002, None), (9003, ""), (5, "another text of an id")], "doc_id long, text string")
    odd = spark.createDataFrame([(9002, None, 0), (None, 1, 0), (7, 1, None), (7, 0, None), (9000, 1, 0), (9001, 0, 0)], "doc_id long, quality int, toxic int")
    rows = ranking.held_out_scores(docs.unionAll(more), labels.unionAll(odd)).collect()
    assert len(rows) == 607
    same = {r["score"] for r in rows if r["doc_id"] in (9000, 9001, None)}
    empty = {r["score"] for r in rows if r["doc_id"] in (9002, 9003)}
    assert len(same) == 1 == len(empty) and all(0 <= s <= 1 for s in same | empty)
