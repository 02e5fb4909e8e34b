"""The urls that a crawl has seen, in hash buckets with a bit filter, grown by increments.

A wave looks its urls up in the filter first: what isn't there is new. The rest is looked for in the buckets that it hits,
which are read without a shuffle while the wave's urls are few enough to be sent to all tasks. A wave writes its new urls
as further files of their buckets; nothing that was written before is written or shuffled again. The filter has a fixed
size and its answers are only ever too careful, so results are exact however full it gets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.plans.store import shared_dir, written

BUCKETS, FILTER_BITS = 64, 24
#: Urls of a wave that are sent to all tasks at most; more are joined by a shuffle of both sides.
SENT = 200_000


class SeenSet:
    """Rows without a url are never seen and never new."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS, sent: int = SENT):
        self.spark, self.path, self.buckets, self.sent = spark, path or shared_dir(spark), buckets, sent
        self.bits = np.zeros(1 << FILTER_BITS - 6, np.int64)
        self.filled: set[int] = set()

    def _hashed(self, urls: DataFrame) -> DataFrame:
        h = F.xxhash64("url")
        return urls.withColumns({"__slot": F.shiftrightunsigned(h, 64 - FILTER_BITS).cast("int"), "__bucket": F.pmod(h, F.lit(self.buckets)).cast("int")})

    def _maybe(self, rows: DataFrame) -> DataFrame:
        held = self.spark.sparkContext.broadcast(self.bits)

        @F.pandas_udf("boolean")
        def known(slots: pd.Series) -> pd.Series:
            at = slots.to_numpy()
            return pd.Series((held.value[at >> 6] >> (at & 63)) & 1).astype(bool)

        return rows.where(known("__slot"))

    def add(self, urls: DataFrame) -> None:
        """urls(url), which none of the set's are, as one increment."""
        new = written(self._hashed(urls.where("url is not null").select("url").distinct()))
        new.select("url", F.col("__bucket").alias("bucket")).repartition("bucket").write.partitionBy("bucket").mode("append").parquet(self.path)
        words = new.groupBy(F.shiftright("__slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, __slot & 63))").alias("bits")).toArrow()  # the filter's words at most
        self.bits = self.bits.copy()
        self.bits[words.column("word").to_numpy()] |= words.column("bits").to_numpy()
        self.filled |= {r.bucket for r in new.select(F.col("__bucket").alias("bucket")).distinct().collect()}  # at most ``buckets``

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The urls, or those of some buckets."""
        places = [f"{self.path}/bucket={b}" for b in sorted(self.filled) if buckets is None or b in buckets]
        return self.spark.read.schema("url string").parquet(*places) if places else self.spark.createDataFrame([], "url string")

    def seen_of(self, rows: DataFrame) -> DataFrame:
        """The distinct urls of rows(url) that are in the set, in a written table."""
        asked = written(self._maybe(self._hashed(rows.where("url is not null").select("url").distinct())).select("url", "__bucket"))
        hit = [r[0] for r in asked.select("__bucket").distinct().collect()]  # at most ``buckets``
        urls = asked.select("url")
        few = asked.count() <= self.sent
        return written(self.read(hit).join(F.broadcast(urls) if few else urls, "url", "left_semi"))

    def unseen(self, rows: DataFrame) -> DataFrame:
        """rows(url, ...) whose url isn't in the set; repeats among them stay."""
        old = self.seen_of(rows)
        few = old.count() <= self.sent
        return rows.where("url is not null").join(F.broadcast(old) if few else old, "url", "left_anti").select(*rows.columns)
