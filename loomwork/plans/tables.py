"""Readers of the input tables for the registered queries."""

from __future__ import annotations


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    """Six decimals, so that two engines agree on sums in other orders; no negative zero."""
    from pyspark.sql import functions as F

    return F.round(c, 6) + F.lit(0.0)
