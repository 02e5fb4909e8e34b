"""A live view of an event log: counters in versions, each with the number of its last event, and what follows it.

publish() reads only events after the last version's and adds them to its counters. A reader that joins late takes the
latest version and goes on with the events after it, as a table or a stream; merged() puts both together.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row for each stage, or for events without one: counters, sums, and the last queue size with its event.
COUNTERS = "stage string, started long, completed long, failed long, links long, items long, queue_seq long, queue_size long, last_seq long, version int"
KEYS = ("started", "completed", "failed", "links", "items")


def counters(events: DataFrame) -> DataFrame:
    """events(seq, stage, phase, links, items, queue) -> a row for each stage.

    links and items are what an event found and stored; queue is the number that waited when something was enqueued.
    Nulls count as nothing; of the queue the size at the largest seq stays."""
    n = lambda phase: F.count_if(F.col("phase") == phase).alias(phase)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("links", "items")]
    last = F.max(F.when(F.col("queue").isNotNull(), F.struct("seq", "queue"))).alias("q")
    got = events.groupBy("stage").agg(n("started"), n("completed"), n("failed"), *sums, last, F.max("seq").alias("last_seq"))
    return got.select("stage", *KEYS, F.col("q.seq").alias("queue_seq"), F.col("q.queue").cast("long").alias("queue_size"), "last_seq")


def merged(*parts: DataFrame) -> DataFrame:
    """Counters of several ranges of events as one."""
    names = ["stage", *KEYS, "queue_seq", "queue_size", "last_seq"]
    both = parts[0].select(*names)
    for p in parts[1:]:
        both = both.unionByName(p.select(*names))
    last = F.max(F.when(F.col("queue_seq").isNotNull(), F.struct("queue_seq", "queue_size"))).alias("q")
    got = both.groupBy("stage").agg(*[F.sum(k).alias(k) for k in KEYS], last, F.max("last_seq").alias("last_seq"))
    return got.select("stage", *KEYS, "q.queue_seq", "q.queue_size", "last_seq")


def latest(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """The latest version's counters, its number and its last event; none, 0 and -1 before the first."""
    try:
        rows = spark.read.schema(COUNTERS).parquet(path)
        version = rows.agg(F.max("version")).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        version = None
    if version is None:
        return spark.createDataFrame([], COUNTERS), 0, -1
    now = rows.where(F.col("version") == version)
    return now, version, now.agg(F.max("last_seq")).first()[0]


def publish(events: DataFrame, path: str, upto: int | None = None) -> int:
    """A new version with the events after the last one's, or those of them up to a number; its number. Without any there is none."""
    spark = events.sparkSession
    now, version, seq = latest(spark, path)
    new = events.where(F.col("seq") > seq)
    if upto is not None:
        new = new.where(F.col("seq") <= upto)
    added = counters(new).cache()
    if not added.isEmpty():
        version += 1
        # One row for each stage; a version is one file, so it is there whole or not at all.
        merged(now, added).withColumn("version", F.lit(version)).coalesce(1).write.mode("append").parquet(path)
    added.unpersist()
    return version


def hand_over(events: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """What a late reader gets: the latest counters, and the rows or the stream of events after them."""
    now, _, seq = latest(events.sparkSession, path)
    return now, events.where(F.col("seq") > seq)
