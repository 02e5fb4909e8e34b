"""The vector space as Parquet, one folder for each version, with a small index; its growth by expansions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIM = 64


def save(space: DataFrame, path: str, blueprint_id: str, version: int) -> None:
    """space(key, vector, type, text, source_url) as a new version; a version that exists is an error."""
    space.withColumns({"blueprint_id": F.lit(blueprint_id), "version": F.lit(version)}).write.mode("errorifexists").parquet(f"{path}/{blueprint_id}/v{version}")


def load(spark: SparkSession, path: str, blueprint_id: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{blueprint_id}/v{version}").select("key", "vector", "type", "text", "source_url")


def index(spark: SparkSession, path: str) -> DataFrame:
    """(blueprint_id, version, n_vectors) of all saved spaces."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path).groupBy("blueprint_id", "version").agg(F.count("*").alias("n_vectors"))


def bag_of_words(texts: pd.Series, dim: int = DIM) -> list[np.ndarray]:
    """A deterministic stand-in for an embedding model: signed, hashed word counts of unit length."""
    import xxhash

    out = []
    for text in texts:
        v = np.zeros(dim, np.float32)
        for w in (text or "").lower().split():
            h = xxhash.xxh3_64_intdigest(w)
            v[h % dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(v)
        out.append(v / norm if norm else v)
    return out


def embedded(df: DataFrame, text: str, encode: Callable[[pd.Series], list] = bag_of_words) -> DataFrame:
    """df with vector, each distinct text encoded once."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({text: f[text], "vector": [x.tolist() for x in encode(f[text])]})

    vectors = df.select(text).where(F.col(text).isNotNull()).distinct().mapInPandas(run, f"`{text}` string, vector array<float>")
    return df.join(vectors, text, "left")


def grown(space: DataFrame, links: DataFrame, encode: Callable[[pd.Series], list] = bag_of_words) -> DataFrame:
    """space with the expansions of links(url, expansions) under the keys url::exp::number."""
    flat = links.select("url", F.posexplode("expansions").alias("k", "text"))
    new = embedded(flat.select(F.concat("url", F.lit("::exp::"), F.col("k").cast("string")).alias("key"), "text", "url"), "text", encode)
    return space.unionByName(new.select("key", "vector", F.lit("expansion").alias("type"), "text", F.col("url").alias("source_url")))
