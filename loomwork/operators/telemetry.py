"""Statistics, durations and states out of the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.urls import unquoted

CHECKPOINT_EVERY = 200
TICKS, ERRORS, CANDIDATES, PENDING = 40, 1000, 4000, 2000
#: Phases in the order of the funnel.
STATES = ("CREATED", "FETCHED", "FILTERED", "SCORED", "EXPANDED")


def stage_durations(ticks: DataFrame) -> DataFrame:
    """ticks(stage, node_id, seq, ts, phase) -> each end with its duration in ms since the latest open start.

    A start is used up by the end that follows it; a later start replaces an open one."""
    by = Window.partitionBy("stage", "node_id").orderBy("seq")
    ends = F.col("phase").isin("completed", "failed")
    run = ticks.withColumn("run", F.sum(F.when(ends, 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    run = run.withColumn("run", F.coalesce("run", F.lit(0)))
    open_start = F.last(F.when(F.col("phase") == "started", F.col("ts")), ignorenulls=True).over(Window.partitionBy("stage", "node_id", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ms = (F.unix_micros("ts") - F.unix_micros(open_start)) / 1000
    return run.withColumn("duration_ms", ms).where(ends).select("stage", "node_id", "seq", "phase", "duration_ms")


def stage_stats(ticks: DataFrame, durations: DataFrame, queue: str | None = None) -> DataFrame:
    """Counts by phase, last and mean duration of timed completions, what is in flight, and, given a column with the
    number that waited at an event, the last such number as queue_size."""
    last = [] if queue is None else [F.max_by(queue, F.when(F.col(queue).isNotNull(), F.col("seq"))).alias("queue_size")]
    n = ticks.groupBy("stage").agg(*[F.count_if(F.col("phase") == p).alias(p) for p in ("enqueued", "started", "completed", "failed")], *last)
    timed = durations.where("phase = 'completed' and duration_ms is not null")
    d = timed.groupBy("stage").agg(F.max_by("duration_ms", "seq").alias("last_ms"), F.avg("duration_ms").alias("avg_ms"))
    return n.join(d, "stage", "left").withColumn("in_flight", F.greatest(F.lit(0).cast("long"), F.col("started") - F.col("completed") - F.col("failed")))


def bottleneck(stats: DataFrame, order: Column) -> DataFrame:
    """The stage with the largest mean duration; the first in order of equals."""
    return stats.where("avg_ms is not null").agg(F.max_by("stage", F.struct("avg_ms", -order)).alias("stage"), F.max("avg_ms").alias("avg_ms")).where("stage is not null")


def funnel(states: DataFrame) -> DataFrame:
    """states(state) -> for each state of the funnel, how many nodes reached it or a later one."""
    n = states.groupBy("state").agg(F.count("*").alias("n"))
    reached = [F.coalesce(F.sum(F.when(F.col("state").isin(*STATES[k:]), F.col("n"))), F.lit(0)).alias(f"c{k}") for k in range(len(STATES))]
    wide = n.agg(*reached)
    return wide.select(F.posexplode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(f"c{k}").alias("reached")) for k, s in enumerate(STATES)]))).select((F.col("pos") + 1).cast("long").alias("step"), "col.state", "col.reached")


def state_at(events: DataFrame, key: str, seq: int | None = None) -> DataFrame:
    """The last state of each node, as of an event number."""
    df = events if seq is None else events.where(F.col("seq") <= seq)
    return df.groupBy(key).agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("last_seq"), F.count("*").alias("n_events"))


def checkpoints(events: DataFrame, key: str, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """Folds of each range of ``every`` events: what a seek adds up instead of single events."""
    return events.groupBy(F.floor(F.col("seq") / every).alias("range"), key).agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("last_seq"), F.count("*").alias("n_events"))


def seek(folds: DataFrame, events: DataFrame, key: str, seq: int, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """The state as of an event number out of whole ranges and the events after them; equals state_at()."""
    whole = (seq + 1) // every
    old = folds.where(F.col("range") < whole).select(key, "state", "last_seq", "n_events")
    rest = events.where((F.col("seq") >= whole * every) & (F.col("seq") <= seq)).select(key, "state", F.col("seq").alias("last_seq"), F.lit(1).cast("long").alias("n_events"))
    return old.unionByName(rest).groupBy(key).agg(F.max_by("state", "last_seq").alias("state"), F.max("last_seq").alias("last_seq"), F.sum("n_events").alias("n_events"))


def sampled(events: DataFrame, order: str, rate: float, critical: Column) -> DataFrame:
    """One in N events by a running number, all critical ones."""
    step = max(1, round(1 / rate)) if rate > 0 else None
    if step is None:
        return events.where(critical)
    return events.where(critical | (F.pmod(F.col(order), F.lit(step)) == 0))


#: Event types that the minimal trace mode keeps.
MINIMAL = ("signup", "error")


def traced(events: DataFrame, mode: str, order: str, kind: str = "event_type", rate: float = 0.1, minimal=MINIMAL) -> DataFrame:
    """The events that a trace mode lets pass: off, minimal, sampled (critical ones always) or full."""
    critical = F.col(kind).isin(*minimal)
    if mode == "off":
        return events.where(F.lit(False))
    if mode == "full":
        return events
    if mode == "minimal":
        return events.where(critical)
    if mode == "sampled":
        return sampled(events, order, rate, critical)
    raise ValueError(f"unknown trace mode {mode!r}")


def as_of_details(nodes: DataFrame, details: DataFrame) -> DataFrame:
    """nodes(seq, url), details(seq, url, detail): the latest detail before each node, used by one node only."""
    both = nodes.select("seq", "url", F.lit(None).cast("string").alias("detail"), F.lit(True).alias("is_node")).unionByName(details.select("seq", "url", "detail", F.lit(False).alias("is_node")))
    by = Window.partitionBy("url").orderBy("seq", "is_node")
    run = both.withColumn("run", F.coalesce(F.sum(F.when(F.col("is_node"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.last("detail", ignorenulls=True).over(Window.partitionBy("url", "run").orderBy("seq", "is_node").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return run.withColumn("detail", last).where("is_node").select("seq", "url", "detail")


def live_candidates(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates that did not become nodes and whose parent is a node."""
    fresh = candidates.join(nodes.select("url"), "url", "left_anti")
    return fresh.join(nodes.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi").select(*candidates.columns)


def log_lines(events: DataFrame, order: str = "seq") -> DataFrame:
    """One text line for each event: time, type, node."""
    return events.select(order, F.format_string("%s [%s] node=%s", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.upper("type"), F.col("node_id").cast("string")).alias("line"))


def debug_lines(events: DataFrame, tag: Column, status: Column, numbers: dict[str, Column], texts: dict[str, Column], order: str = "seq", width: int = 80) -> DataFrame:
    """[TAG] STATUS k=v ...: numbers with four decimals, texts percent-decoded and cut to width."""
    shown = [F.concat(F.lit(f"{k}="), F.format_string("%.4f", c.cast("double"))) for k, c in numbers.items()]
    shown += [F.concat(F.lit(f"{k}="), F.left(F.coalesce(unquoted(c), c, F.lit("")), F.lit(width))) for k, c in texts.items()]
    return events.select(order, F.concat_ws(" ", F.concat(F.lit("["), F.upper(tag), F.lit("]")), status, *shown).alias("line"))


def valid_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """Messages of a log that parse as JSON objects with a text type; others are dropped. Batch or stream."""
    df = lines.withColumn("payload", F.try_parse_json(column))
    kind = F.try_variant_get("payload", "$.type", "string")
    return df.withColumn("type", kind).where("payload is not null and type is not null")


def edges_of(nodes: DataFrame) -> DataFrame:
    """Distinct parent-child edges of nodes(node_id, parent_id)."""
    return nodes.where("parent_id is not null").select(F.col("parent_id").alias("a"), F.col("node_id").alias("b")).distinct()
