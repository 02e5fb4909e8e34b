"""The scoring of a wave's links from end to end: features' score, buckets, decisions, the model's answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators import answers, cascade


def judged(links: DataFrame, nlp_score: Column, low: float, high: float, client: Callable[[str], str | None], blocks: list, parent: str = "parent_id", seed: str = "seed", **shares) -> DataFrame:
    """links(url, parent, pos, anchor, context) that stay, with nlp_score, bucket, decision, score, relevance_type and expansions.

    The low bucket is dropped but for a sample, the middle one and samples of both others go to the model, one prompt
    for each parent; the rest of the high one is trusted: its score is its nlp_score in hundredths. A link that the
    model was asked about and gave no answer for keeps no score."""
    scored = links.withColumn("nlp_score", nlp_score).withColumn("bucket", cascade.bucket(F.col("nlp_score"), low, high))
    decided = cascade.decisions(scored, parent, "url", seed, **shares).where("decision <> 'dropped'")
    asked = decided.where("decision = 'llm'").select(parent, "pos", "url", "anchor", "context")
    prompts = answers.scoring_prompts(asked, parent, blocks)
    found = answers.parse_answers(answers.ask(prompts.select(parent, "prompt"), client).select("answer"))
    best = found.groupBy("url").agg(F.max(F.struct("score", "relevance_type", "expansions")).alias("r")).select("url", "r.*")
    blank = {"score": F.when(F.col("decision") == "trusted", F.round(F.col("nlp_score") * 100).cast("int")), "relevance_type": F.lit(None).cast("string"), "expansions": F.lit(None).cast("array<string>")}
    trusted, rest = (decided.withColumns(blank).where(F.col("decision") == d) for d in ("trusted", "llm"))
    return answers.map_partial(rest, best).unionByName(trusted)
