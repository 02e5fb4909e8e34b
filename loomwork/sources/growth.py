"""Growth of a vector space out of a stream: a bounded buffer across batches, flushes, a version and a log row for each.

The buffer keeps what came first and drops what comes when it is full. A flush makes one new version of the space with
all that the buffer holds and empties it. Every batch ends with one row of a log, which names the buffer's folder, the
version, and what was added, kept and lost; the row is what makes a batch count: a batch that is given again after its row
was written changes nothing, and one that died before leaves no trace but folders that nothing names.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.graph import in_sequence
from loomwork.plans.store import remove
from loomwork.sources import space_store

CAPACITY, FLUSH_SECONDS = 1000, 10.0
LOG = "batch long, at double, added long, lost long, kept long, flushed boolean, version int, flushed_at double, buffer string"
LINKS = "seq long, url string, expansions array<string>"


def flush_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's rows, one for each batch; none before the first."""
    try:
        return spark.read.schema(LOG).parquet(f"{path}/log")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def buffered(spark: SparkSession, folder: str | None) -> DataFrame:
    return spark.read.schema(LINKS).parquet(folder) if folder else spark.createDataFrame([], LINKS)


def take_batch(links: DataFrame, batch: int, path: str, blueprint_id: str, encode=space_store.bag_of_words, capacity: int = CAPACITY, every: float = FLUSH_SECONDS, clock: Callable[[], float] = time.time) -> None:
    """links(seq, url, expansions) of one batch into the buffer; the first batch makes version 1 if there is no space yet.

    Of a batch that doesn't fit, the rows of the smallest seq stay. The buffer is flushed when it is full, or when ``every``
    seconds have passed since the last flush. The number of rows is bounded by ``capacity``, so a buffer is a small table."""
    spark = links.sparkSession
    last = flush_log(spark, path).orderBy(F.desc("batch")).first()
    if last is not None and last.batch >= batch:
        return
    now = clock()
    version, since, old = (last.version, last.flushed_at, last.buffer) if last else (0, now, None)
    have = buffered(spark, old)
    n_old = have.count()
    new = in_sequence(links.select("seq", "url", "expansions"), "place", "seq", "url").where("place is not null")
    added = new.count()
    kept = min(added, capacity - n_old)
    full = have.unionByName(new.where(F.col("place") < kept).select("seq", "url", "expansions"))
    held = n_old + kept
    flush = held > 0 and (held >= capacity or now - since >= every)
    folder = f"{path}/buffer/{batch:09d}-{uuid.uuid4().hex}"
    if flush:
        none = spark.createDataFrame([], "key string, vector array<float>, type string, text string, source_url string")
        space = space_store.load(spark, f"{path}/space", blueprint_id, version) if version else none
        # A folder that a batch left without its log row is written again.
        remove(spark, f"{path}/space/{blueprint_id}/v{version + 1}")
        space_store.save(space_store.grown(space, full, encode), f"{path}/space", blueprint_id, version + 1)
        version, since = version + 1, now
    else:
        full.write.parquet(folder)
    row = (batch, now, added, added - kept, kept, flush, version, float(since), None if flush else folder)
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
    if old:
        remove(spark, old)


def grow_stream(links: DataFrame, path: str, blueprint_id: str, checkpoint: str, every_trigger: str | None = None, **how):
    """A stream of links into the space at path. Takes what is there and ends; with ``every_trigger`` it goes on at that pace
    and the running query is returned."""

    def put(batch: DataFrame, number: int) -> None:
        take_batch(batch, number, path, blueprint_id, **how)

    writer = links.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    if every_trigger is not None:
        return writer.trigger(processingTime=every_trigger).start()
    return writer.trigger(availableNow=True).start().awaitTermination()


def buffer_totals(spark: SparkSession, path: str) -> DataFrame:
    """One row out of the log: batches, added, kept and lost links, flushes, the latest version and what waits."""
    log = flush_log(spark, path)
    since = log.agg(F.coalesce(F.max(F.when(F.col("flushed"), F.col("batch"))), F.lit(-1)).alias("b"))
    own = log.join(F.broadcast(since))  # one row
    held = own.agg(F.coalesce(F.sum(F.when(F.col("batch") > F.col("b"), F.col("kept"))), F.lit(0)).alias("waiting"))
    sums = log.agg(F.count("*").alias("batches"), F.sum("added").alias("added"), F.sum("kept").alias("kept"), F.sum("lost").alias("lost"), F.count_if("flushed").alias("flushes"), F.max("version").cast("long").alias("version"))
    return sums.join(F.broadcast(held))
