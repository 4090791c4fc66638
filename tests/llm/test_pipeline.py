"""The stages of the pipeline on one corpus: each decision takes effect, clean documents stay."""

from __future__ import annotations

import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, test_item = prose(70), prose(40)
    texts = {i: prose(150) for i in range(100)}
    texts |= {100 + i: " ".join(w.upper() + "###" for w in prose(120).split()) for i in range(30)}
    texts |= {200: texts[0], 201: texts[1] + " tail", 202: f"{prose(80)} {passage} {prose(80)}", 203: f"{prose(80)} {passage} {prose(80)}", 204: f"{prose(60)} {test_item} {prose(60)}", 205: prose(9000)}
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in range(130)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, test_item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(now)
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    assert all(df.columns == docs.columns and df.dtypes == docs.dtypes for df in seen[:-1])
    assert ids(seen[0]) == set(texts) - set(range(100, 130))
    assert ids(seen[1]) == ids(seen[0]) - {200, 201}
    assert ids(seen[2]) == ids(seen[1])
    cut = {r["doc_id"]: r for r in seen[2].collect()}
    assert passage in cut[202]["text"] and passage not in cut[203]["text"] and cut[203]["n_chars"] == len(cut[203]["text"]) and cut[5]["text"] == texts[5]
    assert ids(seen[3]) == ids(seen[2]) - {204}
    assert ids(seen[4]) == ids(seen[3]) and {"sequence_id", "offset"} <= set(seen[4].columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()


def test_stages_take_whatever_rows_there_are(spark, tmp_path):
    """Nulls in any column, empty texts, ids that repeat or are missing, columns named like our own, no count of characters."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = prose(20)
    texts = [(i, prose(100)) for i in range(40)] + [(100 + i, " ".join(w.upper() + "###" for w in prose(80).split())) for i in range(15)]
    texts += [(None, prose(90)), (None, prose(95)), (None, None), (200, None), (201, ""), (202, " "), (203, item), (None, item), (5, prose(70)), (5, item), (6, texts[6][1])]
    docs = spark.createDataFrame([(i, t, None, "r") for i, t in texts], "doc_id long, text string, lang string, row string").withColumns({c: corpus_pipeline.F.lit("x") for c in ("id", "tag", "row_key", "bad_id", "grp", "score", "keep")})
    spark.createDataFrame([(i, int(i < 40), None) for i in [*range(30), *range(100, 112)]] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        before, now = now, spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert now.columns == docs.columns
        if k == 3:
            assert item not in {r["text"] for r in now.collect()}
            kept = {(r["doc_id"], r["text"]) for r in now.collect()}
            assert {x for x in texts if x[0] is not None and x[0] < 40 and x[0] not in (5, 6)} <= kept
    assert now.count() > 0
    nothing = docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, nothing, str(tmp_path)).count() == 0, k
