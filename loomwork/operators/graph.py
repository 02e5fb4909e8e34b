"""Graph operators: connected components, hierarchy walks, frontier growth."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.plans.store import discard, kept, written


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, label): the smallest node that can be reached.

    Every round takes the smallest label of the neighbours and then the label of that label, so the
    number of rounds grows with the logarithm of a component's length. Each round is written to the
    shared folder and removed after the next; discard() removes the last. Nodes without an edge don't appear; an empty table gives an empty one.
    """
    both = written(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = written(labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("next")))
        of = step.select(F.col("node").alias("root"), F.col("next").alias("root_label"))
        jumped = written(step.join(of, F.col("next") == F.col("root")).select("node", "old", F.least("next", "root_label").alias("label")))
        discard(labels, step)
        labels = kept(jumped.select("node", "label"), jumped)
        if jumped.where("old <> label").isEmpty():
            discard(both)
            return labels


class Lineage:
    """Ancestors of nodes(node_id, parent_id) by doubling: level k leads from a node to the one 2^k steps up.

    Levels are written as they are needed and stay until close(), so that further paths take joins only. Levels and
    rounds grow with the logarithm of the longest path. A parent that isn't a node is still an ancestor; a cycle ends
    where it brings nothing new; a node of several parents has the ancestors of all."""

    def __init__(self, nodes: DataFrame):
        self.levels = [written(nodes.where("parent_id is not null").select(F.col("node_id").alias("child"), F.col("parent_id").alias("up")).distinct())]

    def level(self, k: int) -> DataFrame:
        while len(self.levels) <= k:
            last = self.levels[-1]
            onward = last.select(F.col("child").alias("up"), F.col("up").alias("next"))
            self.levels.append(written(last.join(onward, "up").select("child", F.col("next").alias("up")).distinct()))
        return self.levels[k]

    def ancestors_of(self, ids: DataFrame) -> DataFrame:
        """ids(node_id) and all nodes on the way to their roots, in a written table."""
        found, k = written(ids.select("node_id").distinct()), 0
        while True:
            # found holds all that is less than 2^k steps up, so this step brings what is less than twice as far
            step = self.level(k).join(found, F.col("child") == F.col("node_id")).select(F.col("up").alias("node_id")).distinct()
            more = written(step.join(found, "node_id", "left_anti"))
            if more.isEmpty():
                discard(more)
                return found
            both = written(found.union(more))
            discard(found, more)
            found, k = both, k + 1

    def close(self) -> None:
        discard(*self.levels)
        self.levels = []


def ancestors(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """nodes(node_id, parent_id), ids(node_id) -> the nodes on the way from ids to their roots, themselves included."""
    lineage = Lineage(nodes)
    found = lineage.ancestors_of(ids)
    lineage.close()
    return found


def neighbourhood(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """ids, all their ancestors and their children."""
    children = nodes.join(ids.select(F.col("node_id").alias("p")), F.col("parent_id") == F.col("p"), "left_semi").select("node_id")
    return ancestors(nodes, ids).union(children).distinct()


def in_sequence(rows: DataFrame, name: str, *order: str | Column, first: int = 0) -> DataFrame:
    """rows with a running number by order, from ``first``: places within sorted ranges, and a running sum over the ranges."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_rows.withColumn("__m", F.monotonically_increasing_id()))
    place = placed.withColumns({"__p": F.shiftright("__m", 33), "__k": F.col("__m").bitwiseAND(F.lit(2**33 - 1))})
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = place.groupBy("__p").count().select("__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__n"))  # one row for each range
    return place.join(F.broadcast(sizes), "__p").select(*rows.columns, (F.col("__n") + F.col("__k") + first).cast("long").alias(name))


def in_groups(rows: DataFrame, by: list[str], *order: str | Column) -> DataFrame:
    """rows with __place, the place from 0 of each row in its group by order, and __size, the group's number of rows.

    Places come from sorted ranges of all rows, so no task gathers a group; nulls in ``by`` are a group of their own."""
    numbered = in_sequence(rows, "__n", *by, *order)
    own = numbered.groupBy(*[F.col(c).alias(f"__by{k}") for k, c in enumerate(by)]).agg(F.min("__n").alias("__first"), F.count("*").alias("__size"))
    same = [F.col(c).eqNullSafe(F.col(f"__by{k}")) for k, c in enumerate(by)]
    return numbered.join(own, same).select(*rows.columns, (F.col("__n") - F.col("__first")).alias("__place"), "__size")


def range_width(rows: DataFrame, order: str, least: int = 10_000) -> int:
    """How many numbers of ``order`` make a range: the root of what they span, so that the ranges, whose totals meet in
    one task, and the rows of one range grow alike."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    return least if low is None else max(least, math.isqrt(int(high - low)) + 1)


def seed_nodes(seeds: DataFrame, domains: DataFrame, first_priority: float = 0.01) -> DataFrame:
    """seeds(url, domain) joined to domains(base_url); seeds of unknown domains raise."""
    if not seeds.join(domains, seeds["domain"] == domains["base_url"], "left_anti").isEmpty():
        raise KeyError("a seed names a domain that is not declared")
    known = seeds.join(domains, seeds["domain"] == domains["base_url"]).select("url", "domain")
    return in_sequence(known, "node_id", "url").withColumns({"depth": F.lit(0), "priority": F.lit(first_priority)})


def child_nodes(links: DataFrame, parents: DataFrame, first_id: int = 0) -> DataFrame:
    """links(parent_id, pos, url, score, priority) -> new nodes, one for each (parent, url), numbered in order.

    Depth is the parent's plus one, the domain is inherited. Numbers run through sorted ranges of (parent, pos, url), so no
    task sees all links of a parent. Links of parents that aren't nodes take numbers but give no node."""
    once = links.groupBy("parent_id", "url").agg(F.min(F.struct("pos", "score", "priority")).alias("l")).select("parent_id", "url", "l.*")
    numbered = in_sequence(once, "node_id", "parent_id", "pos", "url", first=first_id)
    p = parents.select(F.col("node_id").alias("parent_id"), F.col("depth").alias("parent_depth"), "domain")
    return numbered.join(p, "parent_id").select("node_id", "url", "parent_id", "domain", (F.col("parent_depth") + 1).cast("int").alias("depth"), "score", "priority")


def frontier(nodes: DataFrame, wave: int, order: str = "asc") -> DataFrame:
    """The next nodes to visit; the lowest priority comes first unless order is desc."""
    key = F.col("priority").asc() if order == "asc" else F.col("priority").desc()
    return nodes.orderBy(key, F.col("node_id").asc()).limit(wave)
