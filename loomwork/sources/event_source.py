"""An event log behind a client as a Python data source: a stream with offsets that can be read again, and retries that wait longer.

A client is any object with size(), the number of lines there are by now, and lines(lo, hi), those from lo up to hi; both may
raise when the connection is gone. Offsets are numbers of lines, so a batch that is planned again reads the same lines and
a restart goes on where its checkpoint stands. Lines are read by the tasks, RANGE of them each; the driver asks for the size only.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "line long, type string, payload string, malformed boolean"
RANGE = 10_000
#: Seconds before the first and, doubled each time, at most before a further try; tries before the error goes on.
FIRST_WAIT, MOST_WAIT, TRIES = 1.0, 15.0, 8
ARROW = pa.schema([("line", pa.int64()), ("type", pa.string()), ("payload", pa.string()), ("malformed", pa.bool_())])


def patient(call: Callable[[], object], sleep: Callable[[float], None] = time.sleep, tries: int = TRIES) -> object:
    """call() until it doesn't raise; the wait doubles up to MOST_WAIT, and after so many tries the error is the caller's."""
    wait = FIRST_WAIT
    for k in range(tries):
        try:
            return call()
        except Exception:  # noqa: BLE001  whatever the client raises, it is tried again
            if k == tries - 1:
                raise
            sleep(wait)
            wait = min(2 * wait, MOST_WAIT)


def parsed(line: str) -> tuple[str | None, str, bool]:
    """type, the line, and whether it isn't a JSON object with a text type."""
    try:
        value = json.loads(line)
        kind = value.get("type") if isinstance(value, dict) else None
    except (ValueError, RecursionError):
        kind = None
    return (kind, line, False) if isinstance(kind, str) else (None, line, True)


@dataclass
class _Range(InputPartition):
    lo: int
    hi: int


class _Lines:
    def __init__(self, client, sleep, width: int):
        self.client, self.sleep, self.width = client, sleep, width

    def cut(self, lo: int, hi: int) -> list[_Range]:
        return [_Range(at, min(at + self.width, hi)) for at in range(lo, hi, self.width)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        lines = patient(lambda: self.client.lines(partition.lo, partition.hi), self.sleep)
        rows = [parsed(x) for x in lines]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(range(partition.lo, partition.lo + len(rows)), pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols, list(ARROW)[1:], strict=True))], schema=ARROW)


class _Batch(_Lines, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.cut(0, patient(self.client.size, self.sleep)) or [_Range(0, 0)]


class _Stream(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"line": 0}

    def latestOffset(self) -> dict:
        return {"line": int(patient(self.client.size, self.sleep))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.cut(start["line"], end["line"])


def event_source(spark: SparkSession, name: str, client, sleep: Callable[[float], None] = time.sleep, width: int = RANGE) -> None:
    """Makes a client known to the session as a format of that name: spark.read or spark.readStream .format(name).load()."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Batch(client, sleep, width)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(client, sleep, width)

    spark.dataSource.register(Source)


def line_counts(lines: DataFrame) -> DataFrame:
    """One row: lines, and how many of them are malformed."""
    return lines.agg(F.count("*").alias("lines"), F.count_if("malformed").alias("malformed"))
