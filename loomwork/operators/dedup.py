"""Links and items that were not seen before."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_hash(columns: list[str]):
    """SHA-256 of the item's values as JSON with sorted names, ", " and ": " between them (text fields)."""

    def quoted(c):
        plain = F.to_json(F.array(F.col(c)))
        return F.when(F.col(c).isNull(), "null").otherwise(F.substring(plain, 2, 2**30).substr(F.lit(1), F.length(plain) - 2))

    parts = [F.concat(F.lit(f'"{c}": '), quoted(c)) for c in sorted(columns)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)


def with_item_hash(items: DataFrame, column: str = "item") -> DataFrame:
    """items with item_hash: SHA-256 of the item struct as JSON with sorted keys and ASCII escapes; a null item has none.

    The exact form for items of any fields, lists and scripts; item_hash() is its native form for ASCII texts."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else hashlib.sha256(json.dumps(json.loads(t), sort_keys=True).encode()).hexdigest() for t in texts])

    return items.withColumn("item_hash", digest(F.to_json(column, {"ignoreNullFields": "false"})))


def dedup_links(links: DataFrame, seen: DataFrame, mode: str = "cross_page") -> DataFrame:
    """Links whose url is not in seen(url). cross_page keeps repeats among the new ones, strict drops them."""
    new = links.join(seen.select("url").distinct(), "url", "left_anti").select(*links.columns)
    if mode == "cross_page":
        return new
    if mode != "strict":
        raise ValueError(f"unknown mode {mode!r}")
    order = [c for c in links.columns if c != "url"]
    first = new.groupBy("url").agg(F.min(F.struct(*order)).alias("first"))
    return first.select("url", "first.*").select(*links.columns)


def dedup_items(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Items whose item_hash is not in seen(item_hash)."""
    return items.join(seen.select("item_hash").distinct(), "item_hash", "left_anti").select(*items.columns)


def accept_reject_counts(links: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    known = seen.select(F.col("url")).distinct().withColumn("known", F.lit(True))
    marked = links.join(known, "url", "left")
    return marked.groupBy(key).agg(F.count_if(F.col("known").isNull()).alias("accepted"), F.count_if(F.col("known").isNotNull()).alias("rejected"))


def grown(seen: DataFrame, accepted: DataFrame) -> DataFrame:
    """seen(url) with the accepted urls."""
    return seen.select("url").union(accepted.select("url")).distinct()
