"""Prompts for a language model, and its answers mapped onto links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.scores import parsed_expansions, parsed_relevance, parsed_score
from loomwork.operators.graph import in_groups
from loomwork.plans.store import written


def unfenced(answer: Column) -> Column:
    """An answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def flat_objects(text: Column) -> Column:
    """JSON objects without nested ones that stand in prose; an empty list if one can't be parsed."""
    found = F.regexp_extract_all(text, F.lit(r"\{[^}]*\}"), F.lit(0))
    bad = F.exists(found, lambda x: F.try_parse_json(x).isNull())
    return F.when(text.isNull() | bad, F.array().cast("array<string>")).otherwise(found)


def parse_answers(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """One row (url, score, relevance_type, expansions) for each result of an answer of either shape.

    {"results": [{"url": ...}]} and {url: {...}} are understood; what isn't JSON gives no row."""
    keep = [c for c in answers.columns if c != answer]
    df = answers.withColumn("__j", F.try_parse_json(unfenced(F.col(answer)))).where("__j is not null")
    listed = F.try_variant_get("__j", "$.results", "array<variant>")
    one = df.select(*keep, F.explode(listed).alias("r")).select(*keep, F.try_variant_get("r", "$.url", "string").alias("url"), "r")
    keyed = F.when(F.try_variant_get("__j", "$.results", "variant").isNull(), F.try_variant_get("__j", "$", "map<string,variant>"))
    both = one.unionByName(df.select(*keep, F.explode(keyed).alias("url", "r")))
    score = F.try_variant_get("r", "$.score", "string")
    quoted = F.schema_of_variant(F.try_variant_get("r", "$.score", "variant")) == "STRING"
    score = F.when(quoted, F.concat(F.lit('"'), score, F.lit('"'))).otherwise(score)
    relevance = F.try_variant_get("r", "$.relevance_type", "string")
    kept = F.filter(F.try_variant_get("r", "$.expansions", "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    expansions = F.transform(kept, lambda v: F.try_variant_get(v, "$", "string"))
    return both.select(*keep, "url", parsed_score(score).alias("score"), parsed_relevance(relevance).alias("relevance_type"), parsed_expansions(expansions).alias("expansions"))


def map_results(links: DataFrame, results: DataFrame, key: str = "url") -> DataFrame:
    """Full mapping: links without a result keep their score (0 without one) and are irrelevant.

    Without any result the links stay as they are."""
    r = results.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in ("score", "relevance_type", "expansions")])
    some = results.agg((F.count("*") > 0).alias("__any"))
    df = links.join(r, links[key] == F.col("__k"), "left").join(F.broadcast(some))
    hit = F.col("__k").isNotNull()
    fill = {
        "score": F.when(hit, F.col("__score")).when(F.col("__any"), F.coalesce("score", F.lit(0))).otherwise(F.col("score")),
        "relevance_type": F.when(hit, F.col("__relevance_type")).when(F.col("__any"), "irrelevant").otherwise(F.col("relevance_type")),
        "expansions": F.when(hit, F.col("__expansions")).when(F.col("__any"), F.array().cast("array<string>")).otherwise(F.col("expansions")),
    }
    return df.select(*[fill[c].alias(c) if c in fill else F.col(c) for c in links.columns])


def map_partial(links: DataFrame, results: DataFrame, key: str = "url", order: str = "pos") -> DataFrame:
    """Partial mapping: only the last link of each url with a result changes."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) == 1
    r = results.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in ("score", "relevance_type", "expansions")])
    df = links.withColumn("__last", last).join(r, links[key] == F.col("__k"), "left")
    hit = F.col("__k").isNotNull() & F.col("__last")
    return df.select(*[F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in ("score", "relevance_type", "expansions") else F.col(c) for c in links.columns])


#: Links of one prompt; a node with more gets several.
PROMPT_LINKS = 50
#: Stands for the links among the blocks of a prompt.
LINKS = object()


def assembled(blocks: list[tuple[str, Column | str]]) -> Column:
    """Blocks (heading, text) with blank lines between them; a heading has a line of its own, none if it is empty."""
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"{head}\n"), text(body)) if head else text(body) for head, body in blocks])


def scoring_prompts(links: DataFrame, parent: str, blocks: list[tuple[str, Column | str | object]], size: int = PROMPT_LINKS) -> DataFrame:
    """(parent, part, n_links, prompt): the links of each node in their order, ``size`` a prompt, as JSON in the place of LINKS.

    links: parent, pos, url, anchor, context. Sentences are the caller's. Numbers come from sorted ranges, so no task gathers
    all links of a node; links without a parent are a group of their own."""
    parts = in_groups(links.select(parent, "pos", "url", "anchor", "context"), [parent], "pos", "url").withColumn("part", F.floor(F.col("__place") / size))
    items = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("__place", F.struct("url", "anchor", "context").alias("l")))), lambda x: x.l))
    listed = parts.groupBy(parent, "part").agg(items.alias("__links"), F.count("*").alias("n_links"))
    return listed.select(parent, "part", "n_links", assembled([(head, F.col("__links") if body is LINKS else body) for head, body in blocks]).alias("prompt"))


def build_prompts(links: DataFrame, parent: str, topic: Column, instruction: str, size: int = PROMPT_LINKS) -> DataFrame:
    """Prompts of the topic, the instruction and the links."""
    return scoring_prompts(links, parent, [("", F.concat(F.lit("Topic: "), topic)), ("", instruction), ("", LINKS)], size)


def ask(prompts: DataFrame, client: Callable[[str], str | None], prompt: str = "prompt") -> DataFrame:
    """prompts with answer by client(prompt), called by the tasks; a call that fails gives null.

    The answers are written before they are used, so that a lost executor or a second reader doesn't ask again."""

    def run(frames):
        for frame in frames:
            out = []
            for text in frame[prompt]:
                try:
                    out.append(client(text))
                except Exception:  # noqa: BLE001  whatever the client raises, the row has no answer
                    out.append(None)
            yield frame.assign(answer=out)

    columns = ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes)
    return written(prompts.mapInPandas(run, f"{columns}, answer string"))


def expansion_prompts(topics: DataFrame, blocks: list[tuple[str, Column | str]]) -> DataFrame:
    """topics with a prompt that asks for descriptions; all its blocks, whatever their number, are the caller's."""
    return topics.withColumn("prompt", assembled(blocks))
