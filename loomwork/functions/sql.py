"""Table functions and an aggregate for plain SQL: links and items of a page, and the mean of vectors.

register(spark) makes them known to a session:

    SELECT page_id, l.* FROM pages, LATERAL page_links(html, url, '//a') AS l
    SELECT page_id, i.* FROM pages, LATERAL page_items(html, '{"fields": {"t": {"selector": "//h1", "type": "scalar"}}}') AS i
    SELECT label, vector_mean(embedding) FROM embeddings GROUP BY label
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class PageLinks:
    """(pos, url, anchor, context) of a page's links, as extract_links() gives them."""

    def eval(self, html: str, base: str, selector: str = "//a"):
        from loomwork.operators.extract import page_links

        for link in page_links(html, base, selector):
            yield link["pos"], link["href"], link["anchor"], link["context"]


class PageItems:
    """(pos, a column for each field) of a page's items by a spec, which must be constant: its fields make the columns."""

    def __init__(self):
        self.spec: tuple[str, dict] | None = None

    @staticmethod
    def analyze(html: AnalyzeArgument, spec: AnalyzeArgument) -> AnalyzeResult:
        from loomwork.operators.extract import checked_spec

        if not spec.isConstantExpression or not spec.value:
            raise ValueError("the spec of page_items must be a constant text")
        fields = checked_spec(json.loads(spec.value))["fields"]
        columns = [StructField(n, StringType() if f.get("type", "list") == "scalar" else ArrayType(StringType())) for n, f in fields.items()]
        return AnalyzeResult(StructType([StructField("pos", LongType()), *columns]))

    def eval(self, html: str, spec: str):
        from loomwork.operators.extract import page_items

        if self.spec is None or self.spec[0] != spec:
            self.spec = spec, json.loads(spec)
        for pos, item in enumerate(page_items(html, self.spec[1])):
            yield pos, *item.values()


def _vector_mean(vectors: pd.Series) -> list[float]:
    """The element-wise mean; vectors that are null are left out, without any it is empty."""
    some = [v for v in vectors if v is not None]
    return np.mean(np.array(some, np.float64), axis=0).tolist() if some else []


def register(spark: SparkSession) -> None:
    """page_links and page_items as table functions, vector_mean as an aggregate.

    The aggregate holds a group's vectors in one task; space.centroids() is the form that sums them where they are."""
    spark.udtf.register("page_links", F.udtf(PageLinks, returnType="pos long, url string, anchor string, context string"))
    spark.udtf.register("page_items", F.udtf(PageItems))
    spark.udf.register("vector_mean", F.pandas_udf(_vector_mean, "array<double>", F.PandasUDFType.GROUPED_AGG))
