"""The crawl as waves: each wave is one batch of Spark jobs over the frontier, until nothing is left or a stop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.extract import extract_links
from loomwork.operators.graph import frontier, in_sequence
from loomwork.operators.seen import SeenSet
from loomwork.plans.store import discard, shared_dir, written
from loomwork.sources.pages import Pace, PageTable, failures, fetch_wave, host_states, no_hosts

NODES = "node_id long, url string, parent_id long, depth int, priority double, wave int"
RETRIES = "node_id long, attempt int, priority double"
#: Ids of visited nodes that are sent to all tasks at most.
SENT = 1_000_000


def crawl(seeds: DataFrame, pages: DataFrame | None, max_nodes: int, max_depth: int, wave: int, score, route=None, selector: str = "//a", judge=None, fetch=None, pace: Pace | None = None) -> DataFrame:
    """seeds(url) -> nodes(node_id, url, parent_id, depth, priority, wave).

    Pages come from pages(url, html), which is dealt to buckets once, or from fetch(url), paced by host. A fetch that fails
    is tried again in a later wave with its node's priority lowered, MAX_ATTEMPTS times in all but the first; a page that is
    null has no links. score gives a link's priority as a column of (url, anchor, context, depth); route may map a link's
    url to another one; judge may take the new links of a wave (url, parent_id, pos, depth, anchor, context) through any
    operators, the cascade's for one, and gives back those that stay. A url becomes a node once. The crawl ends when the
    number of nodes reaches max_nodes, when a node reaches max_depth, or without a frontier. Each wave adds its nodes,
    visits and retries to folders of the shared place; nothing is written twice, and urls of earlier waves are neither
    shuffled nor read but for the buckets that a wave hits."""
    spark, base = seeds.sparkSession, shared_dir(seeds.sparkSession)
    table = PageTable(pages, f"{base}/pages") if fetch is None else None
    rows = in_sequence(seeds.select("url").distinct(), "node_id", "url").select("node_id", "url", F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("depth"), F.lit(0.01).alias("priority"), F.lit(0).alias("wave"))
    rows.write.parquet(f"{base}/nodes/0")
    spark.createDataFrame([], "node_id long").write.parquet(f"{base}/visited/0")
    seen, hosts, turn, known, again = SeenSet(spark, f"{base}/seen"), no_hosts(spark), 0, [f"{base}/nodes/0"], []
    read = lambda schema, *paths: spark.read.schema(schema).parquet(*paths)
    fresh = read(NODES, *known)
    seen.add(fresh.select("url"))
    n_nodes, depth = fresh.agg(F.count("*"), F.coalesce(F.max("depth"), F.lit(0))).first()
    while n_nodes < max_nodes and depth < max_depth:
        visited = read("node_id long", *[f"{base}/visited/{k}" for k in range(turn + 1)])
        done = F.broadcast(visited) if (turn + 1) * wave <= SENT else visited
        open_ = read(NODES, *known).join(done, "node_id", "left_anti")
        if again:
            last = read(RETRIES, *again).groupBy(F.col("node_id").alias("of")).agg(F.max(F.struct("attempt", "priority")).alias("r"))
            open_ = open_.join(last, F.col("node_id") == F.col("of"), "left").withColumns({"priority": F.coalesce("r.priority", "priority"), "attempt": F.coalesce("r.attempt", F.lit(0))}).drop("of", "r")
        else:
            open_ = open_.withColumn("attempt", F.lit(0))
        front = written(frontier(open_, wave))
        if front.isEmpty():
            break
        turn += 1
        if table is not None:
            got, gone = table.of(front), front.select("node_id")
        else:
            fetched = fetch_wave(front, hosts, fetch, pace)
            retried, given_up = failures(fetched)
            retried.write.parquet(f"{base}/retries/{turn}")
            again.append(f"{base}/retries/{turn}")
            hosts = written(host_states(fetched, hosts))
            got, gone = fetched, fetched.where("error is null").select("node_id").union(given_up)
        gone.write.parquet(f"{base}/visited/{turn}")
        links = extract_links(got.select("node_id", "url", "html").where("html is not null"), selector, key="node_id")
        if route is not None:
            links = links.withColumn("url", route(F.col("url")))
        new = written(links).join(F.broadcast(front.select("node_id", "depth")), "node_id")  # at most ``wave`` rows
        one = written(seen.unseen(new).groupBy("url").agg(F.min(F.struct("node_id", "pos", "depth", "anchor", "context")).alias("l")))
        rows = one.select("url", F.col("l.node_id").alias("parent_id"), "l.pos", (F.col("l.depth") + 1).alias("depth"), "l.anchor", "l.context")
        rows = judge(rows) if judge is not None else rows
        numbered = in_sequence(rows, "node_id", "parent_id", "pos", "url", first=n_nodes)
        numbered.select("node_id", "url", "parent_id", "depth", score().cast("double").alias("priority"), F.lit(turn).alias("wave")).write.parquet(f"{base}/nodes/{turn}")
        known.append(f"{base}/nodes/{turn}")
        fresh = read(NODES, known[-1])
        seen.add(fresh.select("url"))
        more, deepest = fresh.agg(F.count("*"), F.coalesce(F.max("depth"), F.lit(0))).first()
        n_nodes, depth = n_nodes + more, max(depth, deepest)
        discard(front, one)
    return read(NODES, *known)
