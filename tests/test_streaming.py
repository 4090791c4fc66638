from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from loomgraph.operators import mining
from loomgraph.sources.store import Store
from loomgraph.streaming import commits


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select cast(id % 7 as string) sha, timestamp'2024-01-01' + make_interval(0,0,0,cast(id % 7 as int)) ts, concat('f', id % 3, '.py') path, 'python' lang from range(40)").distinct()
    source = tmp_path / "in"
    for k in range(2):
        rows.where(f"cast(sha as int) % 2 = {k}").coalesce(1).write.mode("append").parquet(str(source))
        commits.follow(spark, str(source), str(tmp_path), str(tmp_path / "check")).awaitTermination()
    got = Store(spark, tmp_path).read("stream_stats")
    want = mining.last_commit(mining.kept_files(rows.select("sha", "path", "lang")), rows.select("sha", "ts").distinct())
    columns = ["path", "churn", "last_commit_sha"]
    assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())


@pytest.mark.parametrize("batches", [3])
def test_any_split_into_batches_gives_the_batch_result(spark, tmp_path, batches):
    """Commits come in pieces, some grow beyond the limit only later; a new query starts for every batch."""
    rng = random.Random(batches)
    start = datetime(2024, 1, 1)  # noqa: DTZ001
    rows = []
    for c in range(25):
        size = rng.choice([1, 2, 3, 5, 6, 7, 12])
        rows += [(f"c{c:02d}", start + timedelta(days=c), f"f{p}.{'md' if p == 3 else 'py'}", "unknown" if p == 3 else "python") for p in rng.sample(range(14), size)]
    rows += rng.sample(rows, 10)  # some come twice
    rng.shuffle(rows)
    source, most = tmp_path / "in", 5
    cut = len(rows) // batches + 1
    for k in range(batches):
        spark.createDataFrame(rows[k * cut : (k + 1) * cut], commits.SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        commits.follow(spark, str(source), str(tmp_path), str(tmp_path / "check"), most=most).awaitTermination()
        so_far = spark.createDataFrame(rows[: (k + 1) * cut], commits.SCHEMA).distinct()
        kept = mining.kept_files(so_far.select("sha", "path", "lang"), most)
        want = mining.last_commit(kept, so_far.select("sha", "ts").distinct())
        store = Store(spark, tmp_path)
        assert sorted(map(tuple, store.read("stream_stats").collect())) == sorted(map(tuple, want.collect()))
        assert sorted(map(tuple, store.read("stream_pairs").collect())) == sorted(map(tuple, mining.pair_support(kept).collect()))
    hot = commits.hottest(store, "2024-03-01", 3).collect()
    assert len(hot) == 3 and hot[0]["hotspot"] >= hot[2]["hotspot"] > 0
    # a batch that was merged before changes nothing
    last = store.read("stream_batch").first()["batch"]
    before = sorted(map(tuple, store.read("stream_stats").collect()))
    commits.merge_changes(store, spark.createDataFrame([("x", start, "f1.py", None, 1)], commits.CHANGES), last)
    assert sorted(map(tuple, store.read("stream_stats").collect())) == before
