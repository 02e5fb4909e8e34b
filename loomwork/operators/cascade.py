"""The scoring cascade: buckets, budgets and decisions for each node's links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.graph import in_groups
from loomwork.plans.store import written

#: Shares of the low bucket and of the high bucket that a model sees, and of the latter at random.
LOW_SHARE, HIGH_SHARE, RANDOM_SHARE = 0.01, 0.30, 0.30


def bucket(score, low: float, high: float):
    """low below the first bound, high above the second; both bounds are mid."""
    return F.when(score < low, "low").when(score > high, "high").otherwise("mid")


def budgets(links: DataFrame, parent: str, low_share=LOW_SHARE, high_share=HIGH_SHARE, random_share=RANDOM_SHARE) -> DataFrame:
    """For each node: bucket sizes and how many of them the model gets."""
    n = links.groupBy(parent).agg(*[F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in ("low", "mid", "high")])
    high = F.floor(F.col("n_high") * high_share)
    rand = F.floor(high * random_share)
    return n.select(parent, "n_low", "n_mid", "n_high", F.floor(F.col("n_low") * low_share).alias("low_budget"), rand.alias("random_budget"), (high - rand).alias("top_budget"))


def decisions(links: DataFrame, parent: str, key: str, seed: str, **shares) -> DataFrame:
    """links(parent, key, nlp_score, bucket) with decision: llm, trusted or dropped.

    Random choices follow the md5 of seed and key, so that they can be repeated anywhere. Ranks are places within sorted
    ranges, so a node with a large share of all links isn't ranked by one task. Links in the middle, or without a bucket, need
    no rank: the model sees them. The links are written first, since they are read three times."""
    links = written(links)
    dice = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    own = budgets(links, parent, **shares).withColumnRenamed(parent, "__parent")
    df = links.join(own, F.col(parent).eqNullSafe(F.col("__parent")))  # links without a parent are a group of their own
    is_high = F.col("bucket") == "high"
    by_chance = in_groups(df.where("bucket in ('low', 'high')"), [parent, "bucket"], dice, key).withColumnRenamed("__place", "by_chance").drop("__size")
    picked = F.col("by_chance") < F.when(is_high, F.col("random_budget")).otherwise(F.col("low_budget"))
    low = by_chance.where(~is_high).select(*links.columns, F.when(picked, "llm").otherwise("dropped").alias("decision"))
    by_score = in_groups(by_chance.where(is_high).withColumn("__picked", picked), [parent, "__picked"], F.desc("nlp_score"), key)
    high = by_score.select(*links.columns, F.when(F.col("__picked") | (F.col("__place") < F.col("top_budget")), "llm").otherwise("trusted").alias("decision"))
    rest = links.where("bucket is null or bucket not in ('low', 'high')").withColumn("decision", F.lit("llm"))
    return rest.union(low).union(high)
