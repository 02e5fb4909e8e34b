"""Where pages come from: a page table, or any fetch function run by the tasks, paced and retried."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.lifecycle import BACKOFF_FIRST, BACKOFF_MAX, FETCH_PENALTY, MAX_ATTEMPTS
from loomwork.plans.store import written

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
#: Urls that are sent to all tasks at most, and pages of a bucket.
SENT, PAGES = 100_000, 2_000
MOST_BUCKETS = 4096


def one_each(pages: DataFrame) -> DataFrame:
    """(url, html) of pages(url, html), a row for each url: the smallest of several texts, so that a fetch gives one page."""
    return pages.where("url is not null").groupBy("url").agg(F.min("html").alias("html"))


def from_table(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """frontier(url) with html from pages(url, html), a row for each of the frontier; null is a failed fetch."""
    return frontier.join(one_each(pages), "url", "left")


class PageTable:
    """pages(url, html) in buckets of their url's hash: a wave reads the buckets of its urls, and html is never shuffled
    while the wave's urls are few enough to be sent to all tasks. Pages without a url are left out,
    of several with one url the smallest text is taken."""

    def __init__(self, pages: DataFrame, path: str, buckets: int | None = None):
        self.spark, self.path = pages.sparkSession, path
        self.buckets = buckets or min(MOST_BUCKETS, max(1, pages.count() // PAGES))
        rows = one_each(pages).select("url", "html", self._bucket().alias("bucket"))
        rows.repartition("bucket", F.pmod(F.xxhash64("html"), F.lit(8))).write.partitionBy("bucket").parquet(path)
        self.filled = {r.bucket for r in self.spark.read.schema("bucket int").parquet(path).select("bucket").distinct().collect()}

    def _bucket(self):
        return F.pmod(F.xxhash64("url"), F.lit(self.buckets)).cast("int")

    def of(self, frontier: DataFrame) -> DataFrame:
        """frontier(url, ...) with html; null without a page."""
        hit = [r[0] for r in frontier.select(self._bucket()).distinct().collect()]  # at most ``buckets``
        places = [f"{self.path}/bucket={b}" for b in hit if b in self.filled]
        pages = self.spark.read.schema("url string, html string").parquet(*places) if places else self.spark.createDataFrame([], "url string, html string")
        urls = frontier.select("url").distinct()
        found = pages.join(F.broadcast(urls) if frontier.count() <= SENT else urls, "url", "left_semi")
        return frontier.join(found, "url", "left")


def by_fetching(frontier: DataFrame, fetch: Callable[[str], str | None]) -> DataFrame:
    """frontier(url) with html by fetch(url), spread by host so that one task asks each host; without pace or retries."""
    host = F.regexp_extract("url", HOST, 1)

    def run(frames: Iterable[pd.DataFrame]):
        for frame in frames:
            out = []
            for url in frame["url"]:
                try:
                    out.append(fetch(url))
                except Exception:  # noqa: BLE001  a fetch that fails gives a row without a page, whatever the client raises
                    out.append(None)
            yield frame.assign(html=out)

    columns = ", ".join(f"`{n}` {t}" for n, t in frontier.dtypes)
    return frontier.repartition(host).mapInPandas(run, f"{columns}, html string")


@dataclass(frozen=True)
class Pace:
    """Seconds between two requests to a host, bounds of the backoff, the most that chance adds; the clock can be a test's."""

    least: float = 1.0
    first: float = BACKOFF_FIRST
    most: float = BACKOFF_MAX
    jitter: float = 0.2
    clock: Callable[[], float] = field(default=time.monotonic)
    sleep: Callable[[float], None] = field(default=time.sleep)

    def after(self, wait: float, error: str | None) -> float:
        """The backoff after a request: doubled by a rate limit, halved by anything else."""
        if error is not None and ("429" in error or "Too Many Requests" in error):
            return self.first if wait == 0 else min(wait * 2, self.most)
        return wait / 2


FETCHED = "node_id long, url string, host string, html string, error string, attempt int, priority double, place long, delay double, backoff double"


def fetch_wave(front: DataFrame, hosts: DataFrame, fetch: Callable[[str], str | None], pace: Pace | None = None) -> DataFrame:
    """front(node_id, url, priority, attempt), hosts(host, backoff) -> FETCHED, a row for each node, in a written table.

    One task asks a host, its nodes in order of priority and number, and waits before each request for what is left of
    pace.least seconds, the host's backoff and some jitter. A fetch that raises gives its error and no page; nothing is
    lost or asked twice by a later reader of the table. ``place`` is the request's number at its host."""
    pace = pace or Pace()
    known = hosts.select(F.col("host").alias("__h"), F.col("backoff").alias("__b"))
    host = F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))
    rows = front.select("node_id", "url", "priority", "attempt", host.alias("host")).join(known, F.col("host") == F.col("__h"), "left").drop("__h")

    def run(frames):
        at, wait, place, asked = None, 0.0, 0, None
        for f in frames:
            out = []
            for node, url, priority, attempt, name, begun in f[["node_id", "url", "priority", "attempt", "host", "__b"]].itertuples(index=False, name=None):
                if name != at:
                    at, place, asked = name, 0, None
                    wait = 0.0 if pd.isna(begun) else float(begun)
                delay = wait + (max(pace.least - (pace.clock() - asked), 0.0) if asked is not None else 0.0)
                delay += random.Random(f"{url}{attempt}").random() * pace.jitter
                if delay > 0:
                    pace.sleep(delay)
                asked, html, error = pace.clock(), None, None
                try:
                    html = fetch(url)
                except Exception as why:  # noqa: BLE001  whatever the client raises is the request's error
                    error = f"{type(why).__name__}: {why}"
                wait, place = pace.after(wait, error), place + 1
                out.append((node, url, name, html, error, attempt, priority, place, delay, wait))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FETCHED.split(", ")])

    return written(rows.repartition("host").sortWithinPartitions("host", "priority", "node_id").mapInPandas(run, FETCHED))


def failures(fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a wave: (node_id, attempt, priority) of those that are tried again with their penalty, and (node_id) of those given up."""
    failed = fetched.where("error is not null").select("node_id", (F.col("attempt") + 1).alias("attempt"), (F.col("priority") - FETCH_PENALTY).alias("priority"))
    return failed.where(F.col("attempt") <= MAX_ATTEMPTS), failed.where(F.col("attempt") > MAX_ATTEMPTS).select("node_id")


def host_states(fetched: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, backoff) after a wave; hosts that it didn't ask keep theirs."""
    now = fetched.groupBy("host").agg(F.max_by("backoff", "place").alias("backoff"))
    return hosts.join(now.select("host"), "host", "left_anti").select("host", "backoff").unionByName(now)


def no_hosts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "host string, backoff double")
