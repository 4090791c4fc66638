"""Mining as commits arrive: a file stream of changed files, merged batch by batch into stored tables.

The files of a commit may come in any number of batches. A commit's state holds the files seen
so far, and every batch gives signed changes: files and pairs of files that it adds,
or, when the commit grows beyond the mass-commit limit, the ones to take back. So after every batch
the tables are those of a batch run over all rows until then, whatever the split. State lives
in the state store and is dropped ``keep`` after a commit's last file; files that come later
than that count as another commit.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loomgraph.functions import scalars
from loomgraph.operators import mining
from loomgraph.sources.store import Store

SCHEMA = "sha string, ts timestamp, path string, lang string"
CHANGES = "sha string, ts timestamp, path string, other string, sign int"
#: State on disk; and no batches without rows, which processing-time timers would call for without end: they expire with the next rows.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class CommitFiles(StatefulProcessor):
    """Files of one commit. Rows out: a file (``other`` null) or a pair of files, to add (1) or take back (-1)."""

    def __init__(self, most: int, keep: timedelta) -> None:
        self.most, self.keep = most, int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "path string", "source boolean")
        self.commit = handle.getValueState("commit", "ts timestamp, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        ts, before = self.commit.get() if self.commit.exists() else (None, 0)
        fresh: dict[str, bool] = {}
        for part in rows:
            for path, source, at in zip(part["path"], part["source"], part["ts"], strict=True):
                ts = at if ts is None else max(ts, at)
                if path not in fresh and not self.files.containsKey((path,)):
                    fresh[path] = bool(source)
        if not fresh:
            return
        counted = before <= self.most
        old = sorted(k[0] for k, v in self.files.iterator() if v[0]) if counted else []
        for path, source in fresh.items():
            self.files.updateValue((path,), (source,))
        self.commit.update((ts, before + len(fresh)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep)
        new = sorted(p for p, source in fresh.items() if source)
        if before + len(fresh) <= self.most:
            pairs = [tuple(sorted(p)) for p in combinations(new, 2)] + [tuple(sorted((a, b))) for a in old for b in new]
            yield self._rows(key[0], ts, new, pairs, 1)
        elif counted:
            yield self._rows(key[0], ts, old, list(combinations(old, 2)), -1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.files.clear()
        self.commit.clear()
        return iter(())

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(sha: str, ts: object, paths: list[str], pairs: list[tuple[str, str]], sign: int) -> pd.DataFrame:
        rows = [(sha, ts, p, None, sign) for p in paths] + [(sha, ts, a, b, sign) for a, b in pairs]
        return pd.DataFrame(rows, columns=["sha", "ts", "path", "other", "sign"]).astype({"ts": "datetime64[us]", "sign": "int32"})


def changes(stream: DataFrame, most: int = mining.MASS_COMMIT, keep: timedelta = timedelta(days=30)) -> DataFrame:
    """Signed changes (``CHANGES``) of a stream of ``SCHEMA``."""
    rows = stream.where("sha is not null and path is not null").select("sha", "ts", "path", scalars.is_source(F.col("lang")).alias("source"))
    return rows.groupBy("sha").transformWithStateInPandas(CommitFiles(most, keep), CHANGES, "append", "processingTime")


def merge_changes(store: Store, batch: DataFrame, batch_id: int) -> None:
    """Add a batch's changes to stored churn, last commits and pairs. All of them and the batch's number become current together: a batch that was merged before is skipped, so a restart counts nothing twice."""
    done = store.read("stream_batch").first()["batch"] if store.has("stream_batch") else None
    if done is not None and batch_id <= done:
        return
    log = f"{store.place}/stream-log"
    batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
    batch = store.spark.read.schema(CHANGES).parquet(f"{log}/batch={batch_id}")
    files, pairs = batch.where("other is null"), batch.where("other is not null")
    delta = files.groupBy("path").agg(F.sum("sign").alias("more"), F.max(F.when(F.col("sign") > 0, F.struct("ts", "sha"))).alias("newest"), F.bool_or(F.col("sign") < 0).alias("less"))
    columns = ["path", "churn", "last_commit_sha", "last_commit_ts"]
    old = store.read("stream_stats") if store.has("stream_stats") else store.spark.createDataFrame([], "path string, churn long, last_commit_sha string, last_commit_ts timestamp")
    both = old.withColumn("last", F.struct(F.col("last_commit_ts").alias("ts"), F.col("last_commit_sha").alias("sha"))).select("path", "churn", "last").join(delta, "path", "full")
    both = both.select("path", (F.coalesce("churn", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("churn"), F.greatest("last", "newest").alias("last"), F.coalesce("less", F.lit(False)).alias("less")).where("churn > 0")
    # where something was taken back, the last commit is looked up among all that is left
    again = both.where("less").select("path")
    every = store.spark.read.schema(f"{CHANGES}, batch long").parquet(log).where((F.col("batch") <= batch_id) & F.col("other").isNull()).join(again, "path", "left_semi")
    left = every.groupBy("path", "sha").agg(F.sum("sign").alias("n"), F.max("ts").alias("ts")).where("n > 0").groupBy("path").agg(F.max(F.struct("ts", "sha")).alias("found"))
    stats = both.join(left, "path", "left").withColumn("last", F.when(F.col("less"), F.col("found")).otherwise(F.col("last")))
    stats = stats.select("path", "churn", F.col("last.sha").alias("last_commit_sha"), F.col("last.ts").alias("last_commit_ts")).select(*columns)
    added = pairs.groupBy(F.col("path").alias("file_a"), F.col("other").alias("file_b")).agg(F.sum("sign").cast("long").alias("support"))
    if store.has("stream_pairs"):
        added = store.read("stream_pairs").unionByName(added).groupBy("file_a", "file_b").agg(F.sum("support").alias("support"))
    store.write_all({"stream_stats": stats, "stream_pairs": added.where("support > 0"), "stream_batch": store.spark.createDataFrame([(batch_id,)], "batch long")})


def follow(spark: SparkSession, folder: str, root: str, checkpoint: str, once: bool = True, most: int = mining.MASS_COMMIT, keep: timedelta = timedelta(days=30)) -> StreamingQuery:
    """Read Parquet files of ``SCHEMA`` as they come into ``folder``."""
    store = Store(spark, root)
    stream = changes(spark.readStream.schema(SCHEMA).parquet(folder), most, keep)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: merge_changes(store, batch, n))
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        return (writer.trigger(availableNow=True) if once else writer).start()  # the query has a session of its own from here on
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hottest(store: Store, as_of: str, n: int = 20, include_tests: bool = False) -> DataFrame:
    """The hottest files of what came so far."""
    stats = store.read("stream_stats").withColumn("age_days", mining.age_days(F.col("last_commit_ts"), as_of))
    most = stats.agg(F.max("churn").alias("most"))  # one row
    rows = stats.crossJoin(F.broadcast(most)).withColumn("hotspot", mining.hotspot(F.col("churn"), F.col("most"), F.col("age_days"))).drop("most")
    return mining.hotspots(rows, n, include_tests)


def churn_by_window(stream: DataFrame, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Commits per file and time window, with late data up to ``late``. Their number is approximate (a sketch of bounded state, some 5 % off)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "path").agg(F.approx_count_distinct("sha").alias("commits"))
