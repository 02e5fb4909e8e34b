"""Scores of candidate links as column expressions: overlap, composite, priorities, answers of a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the composite score and of the three priority strategies.
COMPOSITE = {"target_similarity": 0.85, "coverage_gap": 0.10, "novelty_injection": 0.05, "contextual_consistency": 0.05, "lexical_overlap": 0.05, "semantic_delta": -0.05, "region_density": -0.05, "cluster_distance": 0.0}
AGGRESSIVE = {"target_similarity": 0.40, "coverage_gap": 0.15, "novelty_injection": 0.10, "contextual_consistency": 0.05}
BALANCED = {"target_similarity": 0.25, "coverage_gap": 0.15, "novelty_injection": 0.20, "contextual_consistency": 0.10, "lexical_overlap": 0.05}
EXPLORATION = {"target_similarity": 0.05, "coverage_gap": 0.20, "novelty_injection": 0.35, "semantic_delta": 0.05, "cluster_distance": 0.25}
DEPTH = {"aggressive": 0.08, "balanced": 0.05, "exploration": 0.03}
RELEVANCE = ("direct", "partial", "irrelevant", "ambiguous")
TOKEN = r"[\p{L}\p{N}_]+"


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)))


def shared_part(x: Column, y: Column) -> Column:
    """Shared part of two arrays of distinct members; 0 if one has none."""
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two texts' distinct tokens; 0 if one has none."""
    return shared_part(tokens(F.coalesce(a, F.lit(""))), tokens(F.coalesce(b, F.lit(""))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in doubles; null for a vector of zeros."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = [F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) for v in (a, b)]
    return F.try_divide(dot, norm[0] * norm[1])


def weighted(weights: dict[str, float], signal: Callable[[str], Column] = F.col) -> Column:
    """Sum of the signals by weight; a missing signal counts as 0."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.lit(weight) * F.coalesce(signal(name), F.lit(0.0))
    return total


def composite() -> Column:
    """Weighted features between 0 and 1; 1 if it is no number."""
    total = weighted(COMPOSITE)
    return F.when(F.isnan(total), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))


Strategy = Callable[[Column, Column, Column, Column], Column]
STRATEGIES: dict[str, Strategy] = {}


def register_strategy(name: str, strategy: Strategy) -> None:
    """strategy(score, depth, nlp_bias, llm_bias) -> priority, from the feature columns."""
    STRATEGIES[name] = strategy


def strategy(name: str) -> Strategy:
    if name not in STRATEGIES:
        raise ValueError(f"unknown priority strategy {name!r}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[name]


def model_share(score: Column) -> Column:
    """A score of 0 to 100 as 0 to 1; null is 0."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score.cast("double") / 100)), F.lit(0.0))


def _linear(name: str, weights: dict[str, float]) -> Strategy:
    def priority(score, depth, nlp_bias, llm_bias):
        inner = weighted(weights) - F.lit(DEPTH[name]) * depth
        return F.round(F.greatest(F.lit(0.0), nlp_bias * inner + llm_bias * model_share(score)), 6)

    return priority


for _name, _weights in (("aggressive", AGGRESSIVE), ("balanced", BALANCED), ("exploration", EXPLORATION)):
    register_strategy(_name, _linear(_name, _weights))


def priority(name: str, score: Column, depth: Column) -> Column:
    """With the live biases: 60 and 40, or the features alone where the model gave no score or 0."""
    scored = F.coalesce(score, F.lit(0)) != 0
    nlp, llm = F.when(scored, 60.0).otherwise(1.0), F.when(scored, 40.0).otherwise(0.0)
    return strategy(name)(score, depth, nlp, llm)


def parsed_score(v: Column) -> Column:
    """A model's score, given as JSON text of any kind: whole part, 0 to 100; 0 if it is none."""
    inner = F.regexp_replace(v, r'^\s*"(.*)"\s*$', "$1")
    quoted = v.rlike(r'^\s*"')
    whole = F.when(quoted & inner.rlike(r"^\s*[+-]?[0-9]{1,18}\s*$"), F.expr("1")).when(~quoted & v.rlike(r"^\s*-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\s*$"), F.lit(2))
    number = F.when(whole == 1, F.trim(inner).try_cast("double")).when(whole == 2, F.trim(v).try_cast("double"))
    return F.coalesce(F.least(F.lit(100.0), F.greatest(F.lit(0.0), number)).cast("int"), F.lit(0))


def parsed_relevance(v: Column) -> Column:
    return F.when(F.lower(v).isin(*RELEVANCE), F.lower(v)).otherwise("ambiguous")


def parsed_expansions(v: Column) -> Column:
    """array<string> -> trimmed texts, blanks dropped; null is an empty list."""
    return F.coalesce(F.filter(F.transform(v, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))
