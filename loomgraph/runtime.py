"""Where intermediate tables go: the folder all executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolderError(RuntimeError):
    """Executors on other machines need a folder that all of them see."""


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on one machine (tests), where it is unset, a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise NoSharedFolderError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path  # for ``discard``
    return out


def filesystem(spark: SparkSession, path: str):  # noqa: ANN201
    """(Hadoop file system, path, configuration) for a path of any scheme."""
    conf, place = spark._jsparkSession.sessionState().newHadoopConf(), spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(conf), place, conf


def discard(df: DataFrame) -> None:
    """Delete the table of a result of ``materialize`` that nothing reads any more."""
    fs, path, _ = filesystem(df.sparkSession, df._table)
    fs.delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that only finished work refers to: Spark deletes them once the driver has collected garbage, which on an idle driver may take long.

    What a first collection frees lets others go, some a moment later, so there are several.
    """
    for _ in range(3):
        gc.collect()  # what Python still refers to, the driver's JVM keeps
        spark._jvm.System.gc()
        time.sleep(0.5)


def ship(spark: SparkSession) -> None:
    """Let executors import this package wherever they run: once for each context, Spark sends it to them as a zip file."""
    context = spark.sparkContext
    if getattr(context, "_loomgraph_shipped", False):
        return
    package = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(path))
    context._loomgraph_shipped = True
