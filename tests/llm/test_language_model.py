"""The language model: a function of the rows alone, and its score against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import language_model as lm
from loomgraph.llm import textkit


def corpus(spark, n=150, seed=2):
    rng = random.Random(seed)
    words = [f"{rng.choice('abcdefgh')}{i}{rng.choice(['er', 'ing', 'ou', 'x'])}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([5, 60, 400])]) for _ in range(rng.randint(1, 120)))) for i in range(n)]
    return spark.createDataFrame([*rows, (500, None), (501, ""), (None, rows[0][1]), rows[1]], "doc_id long, text string")


def by_row(df):
    return sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("head", [lm.HEAD, 50])
def test_score_does_not_depend_on_the_layout(spark, head):
    docs = corpus(spark)
    first, *others = [by_row(lm.score_documents(docs.repartition(n), head=head)) for n in (1, 3, 11)]
    for rows in others:
        for a, b in zip(first, rows, strict=True):
            assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9) and abs(a[4] - b[4]) <= 1e-5 * a[1]


def test_head_changes_no_count(spark):
    a, b = (by_row(lm.score_documents(corpus(spark), head=h)) for h in (lm.HEAD, 50))
    assert [x[:3] for x in a] == [x[:3] for x in b] and all(math.isclose(x[3], y[3], rel_tol=1e-9) for x, y in zip(a, b, strict=True))


def whole_model(spark, docs):
    rows = [r["text"] or "" for r in docs.where("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0").collect()]
    tagged = docs.selectExpr("doc_id", "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 10 = 0, false) held_out", "text")
    voc = lm.vocabulary(lm.count_words(tagged), len(rows))
    return rows, voc, lm.learn(tagged.where("not held_out"), voc)


def slices_of(texts, voc):
    for _, _, data, offs in textkit.slices(pa.array(texts)):
        word, form, first = lm.tokens(data, offs)
        kind, slot, _, _ = voc.classes(word, form)
        yield word, lm.features(word, kind, slot, first, voc.offsets)


def test_training_and_score_by_plain_loops(spark):
    """Weights by loops over tokens and features, scores by sums over all classes, slots and words."""
    docs = corpus(spark)
    rows, voc, model = whole_model(spark, docs)
    split, size = int(voc.offsets[4]), int(voc.offsets[-1])
    tokens = []  # (class rows, class, group, slot rows, slot)
    for _, x in slices_of(rows, voc):
        place = {int(t): i for i, t in enumerate(x.within)}
        for t in range(len(x.rows)):
            i = place.get(t)
            tokens.append((x.rows[t].tolist(), int(x.kind[t]), *((int(x.kind[t]) - lm.END_CLASS - 1, (split + x.slot_rows[i]).tolist(), int(x.slot[i])) if i is not None else (None, [], None))))
    weights = np.zeros((size, lm.CLASSES))
    occurs = np.zeros((size, lm.CLASSES))
    for features, kind, _, slots, slot in tokens:
        for r in features:
            occurs[r, kind] += 1
        for r in slots:
            occurs[r, slot] += 1

    def chances(features, bias):
        z = np.log(bias) + sum(weights[r] for r in features)
        return np.exp(z) / np.exp(z).sum()

    share = np.vstack([np.tile(voc.class_share, (split, 1)), np.full((size - split, lm.CLASSES), 1 / lm.CLASSES)])
    for step in lm.STEPS:
        expects = np.zeros((size, lm.CLASSES))
        for features, _, group, slots, _ in tokens:
            p = chances(features, voc.class_share)
            for r in features:
                expects[r] += p
            if slots:
                p = chances(slots, voc.slot_share[group])
                for r in slots:
                    expects[r] += p
        weights = np.clip(weights + step * np.log((occurs + lm.PRIOR * share) / (expects + lm.PRIOR * share)), -lm.STEEPEST, lm.STEEPEST)
    assert np.abs(weights).max() > 0.5 and np.allclose(lm.folded(voc, weights.astype(np.float32)), model.table, atol=2e-4)

    got = {r["doc_id"]: r["score"] for r in lm.score_documents(docs).where("doc_id is not null").collect()}
    count = {}
    for word, _ in slices_of(rows, voc):
        for w in word.tolist():
            count[w] = count.get(w, 0) + 1
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id is not null").collect()}
    for i in [*range(12), 500, 501]:
        for word, x in slices_of([texts[i]], voc):
            score, k = 0.0, 0
            for t in range(len(x.rows)):
                score += math.log10(chances(x.rows[t], voc.class_share)[x.kind[t]])
                n = count.get(int(word[t]), 0) if t < len(word) else len(rows)
                if t in x.within:
                    group = int(x.kind[t]) - lm.END_CLASS - 1
                    score += math.log10(chances(split + x.slot_rows[k], voc.slot_share[group])[x.slot[k]])
                    cell = lm.END_CLASS + 1 + group * (lm.OWN_SLOTS + lm.SHARED_SLOTS) + int(x.slot[k])
                    k += 1
                else:
                    cell = int(x.kind[t])
                score += math.log10(n + lm.SMOOTH) - voc.log_total[cell]
            assert abs(score - got[i]) <= 1e-4 * len(x.rows)


def test_probabilities_add_up(spark):
    """After any tokens, all words met and the end have a little less than 1 together: the rest is for words not met."""
    docs = corpus(spark)
    rows, voc, model = whole_model(spark, docs)
    word, count = {}, {}
    for t in rows:
        for w in t.split():
            count[w] = count.get(w, 0) + 1
    history = "a b " + rows[3][:40]
    ask = [f"{history} {w}" for w in count] + [history]
    start, total = len(history.split()), 0.0
    for k, (_, x) in enumerate(slices_of(ask, voc)):
        logs = model.token_logs(x)
        at = x.begin[:-1] + start
        n = [count.get(t.split()[-1], 0) if i < len(count) else len(rows) for i, t in enumerate(ask)]
        total += (10 ** (logs[at] + np.log10(np.array(n) + lm.SMOOTH))).sum()
    assert 0.85 < total <= 1 + 1e-5


def test_most_frequent_words_are_bounded(spark):
    same = spark.range(5000).selectExpr("id AS word", "0 AS form", "1L AS n", "1L AS everywhere")
    assert 700 < lm.most_frequent(same, 1000).count() <= 1000 and lm.most_frequent(same, 5000).count() == 5000
    steep = spark.range(5000).selectExpr("id AS word", "0 AS form", "id * id AS n", "id * id AS everywhere")
    got = sorted(r["word"] for r in lm.most_frequent(steep, 100).collect())
    assert 50 < len(got) <= 100 and got[-1] == 4999 and min(got) > 4000


def test_table_grows_with_the_corpus():
    assert lm.layout(0)[1] == lm.LEAST_WORD_ROWS and lm.layout(30_000_000)[1] == 16_384 and lm.layout(1 << 40)[1] == lm.MOST_WORD_ROWS
    assert (np.diff(lm.layout(12345)) > 0).all()


def test_learning_helps_on_held_out_rows(spark):
    rng = random.Random(4)
    after = {w: rng.sample("abcdefghijklmnopqrstuvwxyz", 3) for w in "abcdefghijklmnopqrstuvwxyz"}

    def text():
        w = [rng.choice("abcdefghijklmnopqrstuvwxyz")]
        for _ in range(200):
            w.append(rng.choice(after[w[-1]]))
        return " ".join(w)

    docs = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")
    rows = lm.score_documents(docs).where("held_out").collect()
    gain = sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert gain > 0.5  # of the log10(26 / 3) = 0.94 there are


@pytest.mark.parametrize("part", [0, 4])
def test_expected_counts_are_sums_over_tokens(part):
    """Each batch is added up exactly, and no array of it is so large that memory is mapped anew."""
    rng, offsets = np.random.default_rng(part), lm.layout(1 << 20)
    n, first = 500, offsets[part]
    rows = np.stack([offsets[k] - first + rng.integers(0, 8, n) ** 3 for k in range(part, part + (3 if part else 4))], 1)
    chances = rng.random((n, lm.CLASSES)).astype(np.float32)
    sums = lm.Sums(offsets, lm.CLASSES)
    sums.expected(rows, chances, part)
    want = np.zeros((int(offsets[-1]), lm.CLASSES))
    for row, chance in zip(rows, chances, strict=True):
        for r in row:
            want[first + r] += chance
    assert np.array_equal(sums.table, want.astype(np.float32))
    assert lm.BATCH * lm.CLASSES * 8 <= 1 << 21


def test_expected_counts_keep_what_many_batches_add():
    """A sum over hundreds of batches is rounded once, when it is sent."""
    rng, offsets = np.random.default_rng(7), lm.layout(0)
    sums, want = lm.Sums(offsets, lm.CLASSES), np.zeros(lm.CLASSES)
    for _ in range(300):
        chances = rng.random((40, lm.CLASSES)).astype(np.float32)
        sums.expected(np.full((40, 4), 3), chances, 0)
        want += 4 * chances.astype(np.float64).sum(0)
    assert np.array_equal(sums.table[3], want.astype(np.float32)) and not sums.table[4:].any()


def test_words_do_not_depend_on_where_texts_are_cut():
    rng = random.Random(3)
    texts = ["", "a b", *(" ".join(rng.choice(["an", "The", "é", "ox"]) for _ in range(rng.choice([0, 1, 9000, 60_000]))) for _ in range(12))]
    data, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    word, form, first = lm.tokens(data, offs)
    alone = [lm.tokens(data[a:b], np.array([0, b - a])) for a, b in zip(offs, offs[1:], strict=False)]
    assert np.array_equal(word, np.concatenate([x[0] for x in alone])) and np.array_equal(form, np.concatenate([x[1] for x in alone]))
    assert np.diff(first).tolist() == [len(t.split()) for t in texts]
