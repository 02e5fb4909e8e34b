"""When a crawl stops, what is fetched again and how long requests wait."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.graph import range_width

#: Attempts after which a fetch is given up, what a retry takes off the priority, bounds of the backoff.
MAX_ATTEMPTS = 3
FETCH_PENALTY, EMPTY_PENALTY = 2.0, 5.0
BACKOFF_FIRST, BACKOFF_MAX = 1.0, 10.0


def first_stop(events: DataFrame, max_nodes: int, max_depth: int, target: str | None, max_seconds: float, idle: float | None = None) -> DataFrame:
    """events(seq, ts, type, depth, url) in order of seq -> the first event that ends the crawl, and why.

    ``idle`` seconds without an event, as a later event shows, end it at the event before the gap. Running counts come from totals of ranges of seq and a running sum over those, so no task sees all events."""
    width = range_width(events, "seq")
    df = events.withColumn("__b", F.floor(F.col("seq") / width))
    added = F.col("type") == "node_added"
    sums = df.groupBy("__b").agg(F.count_if(added).alias("n"), F.max(F.when(added, F.col("depth"))).alias("d"), F.max("ts").alias("t"), F.max("seq").alias("s"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    start = df.agg(F.min_by("ts", "seq").alias("begun"))
    sums = sums.select("__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.max("d").over(before), F.lit(-1)).alias("d0"), F.max("t").over(before).alias("t0"), F.max("s").over(before).alias("s0"))
    inner = Window.partitionBy("__b").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = df.join(sums, "__b").join(F.broadcast(start)).withColumns({"nodes": F.col("n0") + F.sum(F.when(added, 1).otherwise(0)).over(inner), "top_depth": F.greatest("d0", F.max(F.when(added, F.col("depth"))).over(inner))})
    elapsed = F.col("ts").cast("double") - F.col("begun").cast("double")
    why = F.when(added & (F.col("nodes") >= max_nodes), "MAX_NODES").when(added & (F.col("depth") >= max_depth), "MAX_DEPTH")
    if target is not None:
        why = why.when(added & F.contains("url", F.lit(target)), "TARGET_REACHED")
    why = why.when(elapsed >= max_seconds, "MAX_TIME")
    run = run.withColumn("stop", F.col("seq"))
    if idle is not None:
        earlier = Window.partitionBy("__b").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        run = run.withColumns({"latest": F.greatest("t0", F.max("ts").over(earlier)), "last_seq": F.greatest("s0", F.max("seq").over(earlier))})
        gap = F.col("ts").cast("double") - F.col("latest").cast("double") >= idle
        why, run = F.when(gap, "NO_PROGRESS").otherwise(why), run.withColumn("stop", F.when(gap, F.col("last_seq")).otherwise(F.col("seq")))
    stops = run.withColumn("reason", why).where("reason is not null")
    return stops.agg(F.min_by("stop", "seq").alias("stop_seq"), F.min_by("reason", "seq").alias("reason"), F.min_by("nodes", "seq").alias("nodes")).where("stop_seq is not null")


def after_stop_dropped(events: DataFrame, stop: DataFrame) -> DataFrame:
    limit = stop.select(F.min("stop_seq").alias("__stop"))
    return events.join(F.broadcast(limit)).where(F.col("__stop").isNull() | (F.col("seq") <= F.col("__stop"))).select(*events.columns)


def retry_plan(failures: DataFrame, key: str, order: str, priority: Column) -> DataFrame:
    """Each failure of a fetch with its attempt, what happens and the new priority."""
    attempt = F.row_number().over(Window.partitionBy(key).orderBy(order))
    df = failures.withColumn("attempt", attempt)
    again = F.col("attempt") <= MAX_ATTEMPTS
    return df.withColumn("action", F.when(again, "requeue").otherwise("give_up")).withColumn("new_priority", F.when(again, priority - FETCH_PENALTY * F.col("attempt")).otherwise(priority - FETCH_PENALTY * MAX_ATTEMPTS))


def backoff_series(outcomes: DataFrame, key: str, order: str, limited: Column) -> DataFrame:
    """(key, order, backoff): doubled from one second to ten on a rate limit, halved on any other outcome.

    The recurrence needs the rows of a key in order; they pass one by one, so that memory doesn't grow."""
    kinds = dict(outcomes.dtypes)

    def run(frames):
        at, wait = None, 0.0
        for f in frames:
            out = []
            for k, hit in zip(f[key], f["__limited"], strict=True):
                at, wait = k, wait if k == at else 0.0
                wait = (BACKOFF_FIRST if wait == 0 else min(wait * 2, BACKOFF_MAX)) if hit else wait / 2
                out.append(wait)
            yield f[[key, order]].assign(backoff=out)

    rows = outcomes.select(key, order, limited.alias("__limited")).repartition(key).sortWithinPartitions(key, order)
    return rows.mapInPandas(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, backoff double")
