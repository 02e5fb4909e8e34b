"""Tables written in the folder that driver and executors share, to cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir. Without that setting, a local session gets a folder of this machine; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/loomwork-checkpoints"
    return f"{base.rstrip('/')}/loomwork-{uuid.uuid4().hex}"


def written(df: DataFrame, **options) -> DataFrame:
    """The same rows, read back from a new table; it survives lost executors. options are the writer's.

    discard() removes the table; what is behind a result that is still lazy goes when the session's machine ends."""
    path = shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    _goes_at_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def _goes_at_exit(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)


def kept(view: DataFrame, table: DataFrame) -> DataFrame:
    """A view of a written table that discard() takes for it."""
    view.written_path = table.written_path
    return view


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on any file system that Spark reaches."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def size_of(spark: SparkSession, paths) -> int:
    """Bytes of folders on any file system that Spark reaches."""
    sc, total = spark.sparkContext, 0
    for path in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        total += at.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return total


def discard(*tables: DataFrame) -> None:
    """Removes the tables behind results of written(), which nothing may read any more."""
    for t in tables:
        remove(t.sparkSession, t.written_path)
