"""Streaming forms of the event-log operators; with availableNow their results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def counts_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """An extension: counts by event time, closed by a watermark."""
    by = F.window("ts", width).alias("w")
    return events.withWatermark("ts", late).groupBy(by, "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_seen(events: DataFrame, keys: list[str], late: str | None = None, time: str = "ts") -> DataFrame:
    """Stateful dedup: the first event of each key. Without ``late`` all keys are kept for ever; with it, such as "1 day", a key
    is kept until event time has gone on by that, and bounds the state, so that repeats are known if they come within it."""
    if late is None:
        return events.dropDuplicates(keys)
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_to(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now into a Parquet folder; a second call adds only what is new."""
    if mode == "append":
        df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
        return

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def stop_monitor(events: DataFrame, max_nodes: int, max_depth: int, max_seconds: float, target: str | None = None, idle: float | None = None, late: str = "0 seconds") -> DataFrame:
    """events(crawl_id, seq, ts, type, depth, url) -> (crawl_id, stop_seq, reason), once for each crawl, with state.

    A crawl's state is five numbers; events of one trigger are taken in order of seq, as numbers of some 30 bytes each, so
    what a trigger may bring (read_events' max_files) bounds a crawl's memory. ``target`` ends a crawl with a
    node whose url contains it. ``idle`` seconds without an event end it too: where a later event shows the gap, or
    else by a timer of event time, which needs ts not to lag by more than ``late``."""
    import pandas as pd

    columns = ["crawl_id", "stop_seq", "reason"]

    def why(added, nodes, depth, hit, elapsed):
        if added and nodes >= max_nodes:
            return "MAX_NODES"
        if added and depth >= max_depth:
            return "MAX_DEPTH"
        if added and hit:
            return "TARGET_REACHED"
        return "MAX_TIME" if elapsed >= max_seconds else None

    def step(key, frames, state):
        nodes, begun, latest, last_seq, done = state.get if state.exists else (0, -1.0, -1.0, -1, False)
        found = None
        if state.hasTimedOut:
            state.update((nodes, begun, latest, last_seq, True))
            if not done:
                yield pd.DataFrame([(key[0], last_seq, "NO_PROGRESS")], columns=columns)
            return
        rows = pd.concat(list(frames)).sort_values("seq")
        for seq, sec, added, depth, hit in zip(rows["seq"], rows["sec"], rows["added"], rows["depth"], rows["hit"], strict=True):
            reason, stop = None, int(seq)
            if idle is not None and latest >= 0 and sec - latest >= idle:
                reason, stop = "NO_PROGRESS", last_seq
            begun = sec if begun < 0 else begun
            nodes += added
            reason = reason or why(added, nodes, depth, hit, sec - begun)
            latest, last_seq = max(latest, sec), int(seq)
            if reason and not done:
                done, found = True, (key[0], stop, reason)
        state.update((int(nodes), float(begun), float(latest), int(last_seq), bool(done)))
        if idle is not None and not done:
            state.setTimeoutTimestamp(max(int((latest + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame([found], columns=columns)

    if idle is not None:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    hit = F.coalesce(F.contains("url", F.lit(target)), F.lit(False)) if target is not None and "url" in events.columns else F.lit(False)
    added = F.coalesce(F.col("type") == "node_added", F.lit(False))
    rows = events.select("crawl_id", "seq", "ts", F.col("ts").cast("timestamp").cast("double").alias("sec"), added.alias("added"), F.coalesce("depth", F.lit(-1)).alias("depth"), hit.alias("hit"))
    kept = "nodes long, begun double, latest double, last_seq long, done boolean"
    return rows.groupBy("crawl_id").applyInPandasWithState(step, "crawl_id long, stop_seq long, reason string", kept, "append", "NoTimeout" if idle is None else "EventTimeTimeout")


def upsert_stream(df: DataFrame, path: str, checkpoint: str, keys: list[str], order: str, every: str | None = None):
    """Batches of a stream upserted into a table (export.upserted reads it), the last writer of a key by ``order`` winning.

    Takes what is there and ends; with ``every`` ("10 seconds") it goes on at that pace, and the running query is returned."""
    from loomwork.operators.export import upsert_into

    def put(batch: DataFrame, _: int) -> None:
        upsert_into(batch.sparkSession, path, batch, keys, order)

    writer = df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    if every is not None:
        return writer.trigger(processingTime=every).start()
    return writer.trigger(availableNow=True).start().awaitTermination()
