"""Replay of an event log by snapshots: the state at any event from one snapshot, one delta and a few events.

Events are counted in ranges of ``every`` numbers, and ``per_full`` ranges make a stretch. write_replay() leaves three
tables, each in folders that a seek names: snapshots before stretches, for each range of a stretch the state gathered
since the stretch began, and the events by stretch, sorted. A snapshot before stretch n holds what the stretches since
n less its lowest bit bring, so the whole state before a stretch is in as many snapshots as its number has bits set.
seek() reads those, one delta and of the events fewer than ``every`` rows. Sizes: an event is in as many snapshots as the
number of stretches has bits at most, however many keys there are; a delta has at most as many rows as its stretch has events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVERY, PER_FULL = 200, 16
STATE = ("state", "last_seq", "n_events")


def _fold(events: DataFrame, by: list[Column | str]) -> DataFrame:
    return events.groupBy(*by).agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("last_seq"), F.count("*").alias("n_events"))


def _gathered(folds: DataFrame, by: list[str], step: str, until: Column) -> DataFrame:
    """Folds summed up along step, each sum valid up to the step before the next one, or before ``until``."""
    w = Window.partitionBy(*by).orderBy(step)
    return folds.withColumns({"n_events": F.sum("n_events").over(w), "until": F.coalesce(F.lead(step).over(w), until)})


def write_replay(events: DataFrame, key: str, path: str, every: int = EVERY, per_full: int = PER_FULL) -> None:
    """events(seq, key, state) -> the tables of a replay below path; seq counts from 0, rows without seq or key are left out."""
    rows = events.where(F.col("seq").isNotNull() & F.col(key).isNotNull()).select("seq", key, "state")
    stretch = F.floor(F.col("seq") / (every * per_full)).alias("stretch")
    rows.select("*", stretch).repartitionByRange("stretch", "seq").sortWithinPartitions("stretch", "seq").write.partitionBy("stretch").parquet(f"{path}/events")
    folds = _fold(rows, [F.floor(F.col("seq") / every).alias("range"), key]).withColumn("stretch", F.floor(F.col("range") / per_full))
    deltas = _gathered(folds, ["stretch", key], "range", (F.col("stretch") + 1) * per_full)
    steps = F.explode(F.sequence("range", F.col("until") - 1)).alias("at")
    deltas.select(key, *STATE, "stretch", steps).repartition("stretch", "at").write.partitionBy("stretch", "at").parquet(f"{path}/deltas")
    last = rows.agg(F.coalesce(F.max(stretch), F.lit(-1)).alias("last"))
    last.write.parquet(f"{path}/last")
    end = int(last.sparkSession.read.parquet(f"{path}/last").first().last) + 1
    # A stretch is part of one snapshot for each bit that its number hasn't set: of the stretches that differ from it below that bit.
    snapshots = F.expr(f"filter(transform(filter(sequence(0, {end.bit_length()}), k -> getbit(stretch, k) = 0), k -> shiftleft(shiftright(stretch, k) + 1, k)), n -> n <= {end})")
    parts = _fold(rows, [stretch, key]).select(key, *STATE, F.explode(snapshots).alias("before"))
    sums = [F.max_by("state", "last_seq").alias("state"), F.max("last_seq").alias("last_seq"), F.sum("n_events").alias("n_events")]
    parts.groupBy("before", key).agg(*sums).repartitionByRange("before", key).write.partitionBy("before").parquet(f"{path}/wholes")


def seek(spark: SparkSession, path: str, key: str, seq: int, schema: str, every: int = EVERY, per_full: int = PER_FULL) -> DataFrame:
    """(key, state, last_seq, n_events) as of event number seq, with the sizes that write_replay() had; schema: key and state.

    A number before the first event gives no rows, one beyond the last the state at the end."""
    whole = max(seq + 1, 0) // every
    stretch = whole // per_full
    before = min(stretch, spark.read.schema("last long").parquet(f"{path}/last").first().last + 1)
    snapshots = []
    while before:
        snapshots.append(before)
        before &= before - 1
    read = lambda table, more: spark.read.schema(f"{schema}, {more}").parquet(f"{path}/{table}")
    sums = "last_seq long, n_events long"
    old = read("wholes", f"{sums}, before long").where(F.col("before").isin(snapshots))
    parts = [old.select(key, *STATE)]
    if whole % per_full:
        since = read("deltas", f"{sums}, stretch long, at long").where((F.col("stretch") == stretch) & (F.col("at") == whole - 1))
        parts.append(since.select(key, *STATE))
    tail = read("events", "seq long, stretch long").where((F.col("stretch") == stretch) & F.col("seq").between(whole * every, seq))
    parts.append(tail.select(key, "state", F.col("seq").alias("last_seq"), F.lit(1).cast("long").alias("n_events")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(key).agg(F.max_by("state", "last_seq").alias("state"), F.max("last_seq").alias("last_seq"), F.sum("n_events").alias("n_events"))
