"""Reports over an event log, decisions and nodes: counts, rates, buffers, filters by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.graph import in_groups, range_width
from loomwork.operators.telemetry import STATES

#: What a stage's buffer of ticks and a node's retries hold, the place of kinds that have none, and the
#: least scale of a chart of signals.
BUFFER, RETRIES, LAST_PLACE, LEAST_SCALE = 40, 3, 99, 0.001


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def crawl_metrics(events: DataFrame, key: str = "node_id", sums: tuple[str, ...] = ()) -> DataFrame:
    """events(ts, state, key) -> one row: events by state, nodes, seconds from first to last, nodes a second (0 without time),
    and the sums of further columns, such as accepted links and stored items."""
    nodes, seconds = F.countDistinct(key), F.max("ts").cast("double") - F.min("ts").cast("double")
    totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
    return events.agg(*[F.count_if(F.col("state") == s).alias(s.lower()) for s in STATES], nodes.alias("nodes"), seconds.alias("seconds"), _rate(nodes, seconds).alias("rate"), *totals)


def state_histogram(states: DataFrame) -> DataFrame:
    """states(state), one row for each node -> (state, n)."""
    return states.groupBy("state").agg(F.count("*").alias("n"))


def drop_rate(decisions: DataFrame, by: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """decisions(by, decision) -> dropped, trusted and the share of dropped ones among both, for each value of by, and the
    sums of further columns, such as numbers of accepted and rejected links."""
    dropped, trusted = F.count_if(F.col("decision") == "dropped"), F.count_if(F.col("decision") == "trusted")
    return decisions.groupBy(by).agg(dropped.alias("dropped"), trusted.alias("trusted"), _rate(dropped, dropped + trusted).alias("rate"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


#: Candidates of one list; a parent with more gets several.
LISTED = 1000


def candidates_by_parent(candidates: DataFrame, parent: str, order: str, size: int = LISTED) -> DataFrame:
    """(parent, part, n, candidates): the candidates of each parent in their order, ``size`` a list, and the number of all of them.

    No task gathers all candidates of a parent; those without a parent are a group of their own."""
    rest = [c for c in candidates.columns if c not in (parent, order)]
    parts = in_groups(candidates, [parent], order, *rest).withColumn("part", F.floor(F.col("__place") / size))
    listed = F.sort_array(F.collect_list(F.struct("__place", F.struct(order, *rest).alias("c"))))
    return parts.groupBy(parent, "part", F.col("__size").alias("n")).agg(F.transform(listed, lambda x: x.c).alias("candidates"))


def signal_scale(signals: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, scale): the largest absolute value of any signal, LEAST_SCALE at least."""
    return signals.groupBy(by).agg(F.greatest(F.lit(LEAST_SCALE), *[F.max(F.abs(c)) for c in columns]).alias("scale"))


def retry_attempts(failures: DataFrame, key: str) -> DataFrame:
    """(key, attempts, retried): failures of each node, and how many of them were tried again."""
    n = F.count("*")
    return failures.groupBy(key).agg(n.alias("attempts"), F.least(n, F.lit(RETRIES)).alias("retried"))


def buffer_stats(rows: DataFrame, by: str, size: int = BUFFER) -> DataFrame:
    """(by, added, kept, lost) of a buffer that holds the first ``size`` rows of each value."""
    n = rows.groupBy(by).agg(F.count("*").alias("added"))
    return n.select(by, "added", F.least("added", F.lit(size)).alias("kept"), F.greatest(F.col("added") - size, F.lit(0)).alias("lost"))


def in_order(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """rows with place: that of the column's value among names, LAST_PLACE for others; sorted by it."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col(column))
    return rows.withColumn("place", F.when(place > 0, place).otherwise(LAST_PLACE).cast("long")).orderBy("place", column)


def of_kinds(events: DataFrame, kinds: list[str], column: str = "event_type", keep: bool = True) -> DataFrame:
    """Events of the kinds, or of all others."""
    hit = F.col(column).isin(*kinds)
    return events.where(hit if keep else ~hit | F.col(column).isNull())


def errors_of(events: DataFrame, node: int, kind: str = "error", key: str = "node_id") -> DataFrame:
    return events.where((F.col(key) == node) & (F.col("event_type") == kind))


def children_of(nodes: DataFrame, node: int) -> DataFrame:
    return nodes.where(F.col("parent_id") == node)


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges (a, b) both of whose ends are nodes(node_id)."""
    ends = lambda c: nodes.select(F.col("node_id").alias(c))
    return edges.select("a", "b").distinct().join(ends("a"), "a", "left_semi").join(ends("b"), "b", "left_semi").select("a", "b")


def seen_by_model(decisions: DataFrame) -> DataFrame:
    """The union of what a cascade sends to the model: the middle, and the samples of the low and the high bucket."""
    return decisions.where("decision = 'llm'").withColumn("part", F.when(F.col("bucket") == "mid", "mid").otherwise(F.concat("bucket", F.lit("_sample"))))


def running_depth(nodes: DataFrame, order: str = "seq", width: int | None = None) -> DataFrame:
    """nodes(order, depth) with the number of nodes and the largest depth so far, by order.

    Running values come from ranges of ``width`` numbers (range_width() without one) and a running sum over those, so no task sees all rows."""
    width = width or range_width(nodes, order)
    df = nodes.withColumn("__b", F.floor(F.col(order) / width))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("__b").agg(F.count("*").alias("n"), F.max("depth").alias("d"))
    sums = sums.select("__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.max("d").over(before), F.lit(-1)).alias("__d"))
    inner = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = {"nodes": F.col("__n") + F.count("*").over(inner), "top_depth": F.greatest("__d", F.max("depth").over(inner))}
    return df.join(sums, "__b").withColumns(run).drop("__b", "__n", "__d")


def snapshot_then_tail(folds: DataFrame, events: DataFrame, key: str, seq: int, every: int) -> tuple[DataFrame, DataFrame]:
    """What a late reader gets: the state as of an event number, and the events after it."""
    from loomwork.operators.telemetry import seek

    return seek(folds, events, key, seq, every), events.where(F.col("seq") > seq)
