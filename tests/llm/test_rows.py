"""Rows that operators seldom see: missing and repeated ids, columns named like their own, texts beyond a chunk, labels that repeat or are null."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import isolation, language_model, near_dedup, packing, registry, repeats, token_counts


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def clashing(df, *names):
    return df.withColumns({c: F.lit("x") for c in names})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(str(registry.tokenizer()))


def test_packing_rows_without_id_or_with_one_in_common(spark, library):
    """At the real capacity, with more than 256 different lengths."""
    rng = random.Random(1)
    texts = [(i, prose(rng, rng.randrange(1, 700))) for i in range(330)] + [(None, "no id"), (None, "no id"), (None, None), (5, "another text"), (6, prose(rng, 4000))]
    texts.append(texts[7])
    docs = clashing(spark.createDataFrame(texts, "doc_id long, text string"), "sequence_id", "length", "ids", "rank")
    got = packing.pack_documents(docs, registry.tokenizer()).collect()
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    assert sum(r["length"] for r in got) == sum(want)
    assert len({n for n in want}) > 256
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        end = 0
        for offset, n in sorted(held):
            assert offset == end
            end += n
        assert end <= 4096
    assert len(places) <= 1.02 * -(-sum(want) // 4096) + 1
    firsts = sorted(r["doc_tokens"] for r in got if r["start"] == 0)
    assert firsts == want


def test_near_duplicates_and_repeats_with_clashing_columns(spark):
    rng = random.Random(2)
    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(1, a), (2, a + " tail"), (3, b), (4, prose(rng, 80)), (4, prose(rng, 80)), (None, b), (None, None), (5, "")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "grp", "rep", "gone_id", "row", "kept_text", "tag", "id", "node", "component")
    kept = near_dedup.keep_one(docs, percent=80)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 in ids and 5 in ids
    cut = repeats.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    texts = defaultdict(list)
    for r in cut.collect():
        texts[r["doc_id"]].append(r["text"])
    assert texts[1] == [a] and texts[2] != [a + " tail"] and texts[3] == [b] and b not in texts[None]
    assert repeats.repeats(docs).count() == len(rows) == near_dedup.near_duplicates(docs).count()


def test_rules_with_odd_labels(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 40)) for i in range(60)] + [(100 + i, "### %% " * 30) for i in range(20)] + [(None, prose(rng, 40)), (7, "other text"), (8, None)]
    labels = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(15)] + [(3, None), (None, 1), (5, 0), (5, 1), (8, 1)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), "label", "x", "path", "failed")
    got = isolation.apply_rules(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    assert not any(r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 100)
    assert sum(r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 40) >= 36
    assert isolation.apply_rules(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == len(rows)


def test_token_counts_beyond_a_chunk(spark, library):
    rng = random.Random(4)
    long = prose(rng, 30_000)
    rows = [(1, long), (1, long), (None, "x" * 70_000), (2, None), (2, "two words")]
    got = token_counts.count_tokens(clashing(spark.createDataFrame(rows, "doc_id long, text string"), "n_tokens", "chunk"), registry.tokenizer()).collect()
    want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for _, t in rows)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == want


def test_language_model_scores_of_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 30)) for i in range(40)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (None, None), (4, "another text of an id"), (50, "")]
    got = language_model.score_documents(clashing(spark.createDataFrame(rows, "doc_id long, text string"), "word", "form", "held_out")).collect()
    assert len(got) == len(rows) and all(r["score"] <= 0 and r["base_score"] < 0 for r in got)
    assert len({round(r["score"], 6) for r in got if r["doc_id"] == 3}) == 1
    assert len({round(r["score"], 6) for r in got if r["n_tokens"] == 1}) == 1
