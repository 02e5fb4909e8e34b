"""Details of nodes joined to them as both stream in: each detail is used once, and what waits is bounded."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loomwork.operators.telemetry import PENDING

ROWS = "crawl_id long, seq long, url string, detail string, lost long"


def _in_order(rows):
    return sorted((r for f in rows for r in zip(f["seq"], f["url"], f["detail"], f["is_node"], strict=True)), key=lambda r: (r[0], r[3]))


class _OneShot(StatefulProcessor):
    """State: details that wait, by url; the order in which they came, as a queue of numbers; how many were lost."""

    def __init__(self, bound: int):
        self.bound = bound

    def init(self, handle: StatefulProcessorHandle) -> None:
        text, number = StructType([StructField("x", StringType())]), StructType([StructField("n", LongType())])
        entry = StructType([StructField("n", LongType()), StructField("detail", StringType())])
        place = StructType([StructField("head", LongType()), StructField("tail", LongType()), StructField("held", LongType()), StructField("lost", LongType())])
        self.waiting = handle.getMapState("waiting", text, entry)
        self.queue = handle.getMapState("queue", number, text)
        self.place = handle.getValueState("place", place)

    def handleInputRows(self, key, rows, timers):
        head, tail, held, lost = self.place.get() if self.place.exists() else (0, 0, 0, 0)
        out = []
        for seq, url, detail, is_node in _in_order(rows):
            found = self.waiting.getValue((url,)) if self.waiting.containsKey((url,)) else None
            if is_node:
                out.append((key[0], int(seq), url, found[1] if found else None))
                if found:
                    self.waiting.removeKey((url,))
                    self.queue.removeKey((found[0],))
                    held -= 1
                continue
            if found:  # a later detail takes the place of the one that waits
                self.queue.removeKey((found[0],))
                held -= 1
            self.waiting.updateValue((url,), (tail, detail))
            self.queue.updateValue((tail,), (url,))
            tail, held = tail + 1, held + 1
            while held > self.bound:
                while not self.queue.containsKey((head,)):
                    head += 1
                self.waiting.removeKey(self.queue.getValue((head,)))
                self.queue.removeKey((head,))
                head, held, lost = head + 1, held - 1, lost + 1
        self.place.update((head, tail, held, lost))
        if out:
            yield pd.DataFrame([(*r, lost) for r in out], columns=["crawl_id", "seq", "url", "detail", "lost"])

    def close(self) -> None:
        pass


class _EachUrl(StatefulProcessor):
    """Without a bound urls don't meet: the state of one is the detail that waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getValueState("waiting", StructType([StructField("detail", StringType())]))

    def handleInputRows(self, key, rows, timers):
        was = self.waiting.get()[0:1] if self.waiting.exists() else None
        now, out = was, []
        for seq, _, detail, is_node in _in_order(rows):
            if is_node:
                out.append((key[0], int(seq), key[1], now[0] if now else None, 0))
            now = None if is_node else (detail,)
        if now:
            self.waiting.update(now)
        elif was:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=["crawl_id", "seq", "url", "detail", "lost"])

    def close(self) -> None:
        pass


#: Where a stream's state is kept; transformWithState needs this store.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def one_shot_details(events: DataFrame, bound: int | None = PENDING) -> DataFrame:
    """events(crawl_id, seq, url, detail, is_node) as a stream -> the nodes with the latest detail before each, or null.

    A crawl holds at most ``bound`` details that no node has used; beyond, the one that came first is lost, and ``lost``
    counts those of the crawl so far. A detail comes before a node of the same number. Rows of a trigger are taken in
    the order of seq, those of later triggers after them; urls and numbers must not be null. Memory of a crawl's task:
    its rows of one trigger. Without a bound (None) nothing is lost: each url has a state of its own in the store, and a
    task's memory is a url's rows of one trigger. The session needs PROVIDER as a setting."""
    rows = events.select("crawl_id", "seq", "url", "detail", "is_node")
    if bound is None:
        return rows.groupBy("crawl_id", "url").transformWithStateInPandas(_EachUrl(), ROWS, "Append", "none")
    return rows.groupBy("crawl_id").transformWithStateInPandas(_OneShot(bound), ROWS, "Append", "none")
