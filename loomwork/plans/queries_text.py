"""Queries over texts: transform chains, parsing of a model's answers, prompts."""

from __future__ import annotations

import copy
import json

from pyspark.sql import functions as F

from loomwork.functions import format as fmt
from loomwork.functions.scores import jaccard
from loomwork.functions.transforms import chain
from loomwork.functions.urls import unquoted
from loomwork.operators import answers
from loomwork.plans.tables import r6, t
from loomwork.sources import blueprint


def _tf(spark, sf_dir, steps, source="text", is_list=False):
    docs = t(spark, sf_dir, "documents")
    c = F.split("text", " ") if is_list else F.col(source)
    return docs.select("doc_id", chain(c, steps, is_list).alias("value"))


def q_tf_regex(spark, sf_dir):
    return _tf(spark, sf_dir, [{"type": "regex", "pattern": r"([A-Z][a-z]+)\."}])


def q_tf_regex_extract(spark, sf_dir):
    return _tf(spark, sf_dir, [{"type": "regex_extract", "pattern": r"[0-9]+"}, {"type": "join", "sep": ","}])


def q_tf_lowercase(spark, sf_dir):
    return _tf(spark, sf_dir, [{"type": "lowercase"}])


def q_tf_strip(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    return docs.select("doc_id", chain(F.concat(F.lit(" \n\t"), F.col("text"), F.lit("  \n")), [{"type": "strip"}]).alias("value"))


def q_tf_join(spark, sf_dir):
    return _tf(spark, sf_dir, [{"type": "join", "sep": "-"}], is_list=True)


def q_tf_truncate(spark, sf_dir):
    return _tf(spark, sf_dir, [{"type": "truncate"}])


def q_tf_deduplicate(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    return docs.select("doc_id", chain(F.split("text", " "), [{"type": "deduplicate"}, {"type": "join", "sep": " "}], True).alias("value"))


def q_tf_chain(spark, sf_dir):
    return _tf(spark, sf_dir, [{"type": "regex_extract", "pattern": r"[A-Za-z]+"}, {"type": "join", "sep": " "}, {"type": "lowercase"}, {"type": "truncate", "max_len": 40}, {"type": "unknown"}])


def q_lexical_overlap(spark, sf_dir):
    docs, items = t(spark, sf_dir, "documents"), t(spark, sf_dir, "benchmark")
    n = items.agg(F.count("*").alias("n"))
    pairs = docs.join(F.broadcast(n)).join(items.select("item_id", F.col("text").alias("topic")), F.expr("doc_id % n = item_id"))
    return pairs.select("doc_id", "item_id", r6(jaccard(F.col("text"), F.col("topic"))).alias("overlap"))


def q_url_unquote(spark, sf_dir):
    pages = t(spark, sf_dir, "pages")
    html = F.replace(F.replace("html", F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))
    coded = F.concat("url", F.lit("%20a+b%C3%A9"), html, F.when(F.col("page_id") % 4 == 0, "%zz").otherwise(""))
    return pages.select("page_id", F.md5(unquoted(coded)).alias("url"))


def _answers(spark, sf_dir):
    """Test adapter: labels as a model's answers; every other one in the keyed shape and fenced."""
    labels = t(spark, sf_dir, "labels")
    url, score = F.concat(F.lit("u"), F.col("doc_id").cast("string")), F.col("quality") * 100 + F.col("doc_id") % 7
    relevance = F.when(F.col("quality") == 1, "DIRECT").otherwise("nonsense")
    body = F.format_string('"score": %s, "relevance_type": "%s", "expansions": [" a ", "", "b%s"]', F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('"'), score.cast("string"), F.lit('.5"'))).otherwise(score.cast("string")), relevance, F.col("doc_id").cast("string"))
    listed = F.concat(F.lit('{"results": [{"url": "'), url, F.lit('", '), body, F.lit("}]}"))
    keyed = F.concat(F.lit('```json\n{"'), url, F.lit('": {'), body, F.lit("}}\n```"))
    return labels.select("doc_id", F.when(F.col("doc_id") % 2 == 0, listed).otherwise(keyed).alias("answer"))


def q_llm_parse(spark, sf_dir):
    got = answers.parse_answers(_answers(spark, sf_dir))
    return got.select("doc_id", "url", F.col("score").cast("long").alias("score"), "relevance_type", F.array_join("expansions", "|").alias("expansions"))


def _links(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    empty = F.lit(None).cast("array<string>")
    return docs.select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 3 == 0, F.lit(7)).alias("score"), F.lit(None).cast("string").alias("relevance_type"), empty.alias("expansions"))


def q_map_results(spark, sf_dir):
    got = answers.map_results(_links(spark, sf_dir), answers.parse_answers(_answers(spark, sf_dir)))
    return got.select("url", F.col("score").cast("long").alias("score"), "relevance_type", F.array_join("expansions", "|").alias("expansions"))


def q_map_partial(spark, sf_dir):
    links = _links(spark, sf_dir)
    got = answers.map_partial(links.union(links.withColumn("pos", F.col("pos") + 100_000_000)), answers.parse_answers(_answers(spark, sf_dir)))
    return got.select("url", "pos", F.col("score").cast("long").alias("score"), "relevance_type")


def q_flat_objects(spark, sf_dir):
    events = t(spark, sf_dir, "events")
    text = F.concat(F.lit("see "), F.array_join(F.array_repeat(F.col("props"), (F.col("event_id") % 4).cast("int")), " and "), F.when(F.col("event_id") % 5 == 0, " {broken}").otherwise(""))
    return events.select("event_id", F.size(answers.flat_objects(text)).cast("long").alias("n"), F.get_json_object(F.try_element_at(answers.flat_objects(text), F.lit(1)), "$.k").cast("long").alias("k"))


def q_build_prompt(spark, sf_dir):
    talk = t(spark, sf_dir, "conversations")
    links = talk.select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("url"), F.regexp_replace("text", r'[\n"\\/]', " ").alias("anchor"), F.lit("c").alias("context"))
    return answers.build_prompts(links, "conv_id", F.lit("health"), "Score every link.", 3)


def q_scoring_prompts(spark, sf_dir):
    talk = t(spark, sf_dir, "conversations")
    links = talk.select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("url"), F.regexp_replace("text", r'[\n"\\/]', " ").alias("anchor"), F.lit("c").alias("context"))
    blocks = [("Reader", "a nurse"), ("Links", answers.LINKS), ("Form", '{"<url>": {"score": 1}}')]
    return answers.scoring_prompts(links, "conv_id", blocks, 2).select("conv_id", "part", "n_links", "prompt")


def q_model_answers(spark, sf_dir):
    """A client that the tasks call: it fails for every prompt with a digit."""

    def client(prompt):
        if any(c.isdigit() for c in prompt):
            raise TimeoutError
        return '{"n": %d}' % len(prompt)

    return answers.ask(t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("prompt")), client).select("item_id", "answer")


def q_link_text(spark, sf_dir):
    p = t(spark, sf_dir, "pages")
    return p.select("page_id", fmt.link_text(F.col("url"), F.when(F.col("page_id") % 3 > 0, F.col("page_id").cast("string")), F.lit("c")).alias("text"))


def q_crawl_ids(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.select("event_id", fmt.crawl_id(F.concat("event_type", F.when(F.col("event_id") % 2 == 0, ".v1.json").otherwise("")), F.col("ts")).alias("crawl_id"))


def q_dotted_paths(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    doc = F.concat(F.lit('{"a": {"b": '), F.col("props"), F.lit(', "c.d": 1}}'))
    return e.select("event_id", fmt.at_path(doc, "a.b.k").alias("k"), fmt.at_path(doc, "a.x.k").alias("none"), fmt.at_path(F.lit("no json"), "a").alias("broken"))


def q_json_lines(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    text = F.concat_ws("\n", "props", F.lit("  "), F.lit("{broken"), F.concat("props", F.lit("\r")), F.lit("7"))
    return fmt.json_lines(e.select("event_id", text.alias("text")), "text").select("event_id", F.col("line_no").cast("long").alias("line_no"), F.col("payload").isNotNull().alias("ok"))


GOOD_SPEC = {
    "blueprint_id": "b", "target_topic": "@", "seeds": [{"url": "u", "domain": "d"}], "domains": {"d": {"base_url": "d", "link_selector": "//a"}},
    "extraction": {"fields": {"f": {"selector": "//a", "type": "list", "export_type": "text", "transform": [{"type": "truncate"}]}}},
    "scoring": {"strategy": "TOPICAL", "params": {"scoring_type": "x", "model_information": "m"}}, "expansion": {"style": "rich", "num_descriptions": 3, "llm_type": "a", "llm_model": "b"},
    "stop_conditions": {"max_nodes": 5, "max_depth": 2, "max_duration": 9.0, "no_progress_timeout": 1, "stop_url": None},
}
PROFILES = {"site": {"t": {"selector": "//title", "type": "scalar", "export_type": "text", "transform": [{"type": "strip"}]}, "u": {"selector": "//u", "type": "list", "export_type": "json"}}}
#: What is changed in GOOD_SPEC, and what the check says then; None removes.
SPEC_CASES = [
    ((), 0, None),
    (("seeds",), None, "specification lacks seeds"),
    (("scoring", "strategy"), "topical", "scoring: 'topical' is none of TOPICAL, PATHFINDING, EXPLORATION, GOAL_ORIENTED, DENSITY_FOCUSED, UNCERTAINTY_BIASED"),
    (("scoring", "params", "model_information"), {}, "scoring params: model_information must be text"),
    (("expansion", "num_descriptions"), "3", "expansion: num_descriptions must be whole number"),
    (("expansion", "style"), "long", "expansion: 'long' is none of concise, balanced, rich"),
    (("stop_conditions", "max_nodes"), True, "stop_conditions: max_nodes must be whole number"),
    (("stop_conditions", "no_progress_timeout"), None, "stop_conditions lacks no_progress_timeout"),
    (("stop_conditions", "priority_strategy"), "fast", "stop_conditions: 'fast' is none of aggressive, balanced, exploration"),
    (("seeds", 0, "url"), 7, "seed 0: url must be text"),
    (("domains", "d", "link_selector"), None, "domain d lacks link_selector"),
    (("extraction", "mode"), "container", "extraction: mode container needs the selector of its containers"),
    (("extraction", "fields"), {}, "extraction: no fields"),
    (("extraction", "profile"), "p", "extraction: no profile 'p'"),
    (("extraction",), {"profile": "site", "checklist": ["t"]}, None),
    (("extraction",), {"profile": "site", "checklist": ["t", "z"]}, "profile has no z"),
    (("extraction", "fields", "f", "export_type"), "blob", "field f: 'blob' is none of text, real, int, json"),
    (("extraction", "fields", "f", "transform"), [{"type": "regex"}], "field f: regex needs a pattern"),
    (("extraction", "fields", "f", "transform"), [{"type": "sort"}], "field f: transform: 'sort' is none of regex, regex_extract, lowercase, strip, join, truncate, deduplicate"),
]


def spec_with(path, value) -> dict:
    spec = copy.deepcopy(GOOD_SPEC)
    if path:
        part = spec
        for k in path[:-1]:
            part = part[k]
        if value is None:
            del part[path[-1]]
        else:
            part[path[-1]] = value
    return spec


def q_spec_checks(spark, sf_dir):
    """One specification for each benchmark item, in turn sound or broken in one place."""
    n = len(SPEC_CASES)
    cases = spark.createDataFrame([(k, json.dumps(spec_with(path, value))) for k, (path, value, _) in enumerate(SPEC_CASES)], "k int, template string")
    items = t(spark, sf_dir, "benchmark").join(cases, F.col("item_id") % n == F.col("k"))
    topic = F.regexp_replace("text", "[^A-Za-z .,]", "")
    got = blueprint.checked(items.select("item_id", F.replace("template", F.lit("@"), topic).alias("spec")), "item_id", profiles=PROFILES)
    return got.select("item_id", "problem", F.array_join(F.json_object_keys(F.get_json_object("translated", "$.extraction.fields")), ",").alias("fields"), fmt.at_path(F.col("translated"), "stop_conditions.priority_strategy").alias("priority"), fmt.at_path(F.col("translated"), "target_topic").alias("topic"), F.get_json_object("translated", "$.extraction.fields.f.transform[0].max_len").cast("long").alias("max_len"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
_ANS = """ans AS (SELECT doc_id, 'u' || doc_id AS url, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE least(100, quality * 100 + doc_id % 7) END AS score, CASE WHEN quality = 1 THEN 'direct' ELSE 'ambiguous' END AS relevance_type, 'a|b' || doc_id AS expansions FROM labels)"""
_LNK = "lnk AS (SELECT 'u' || doc_id AS url, doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN 7 END AS score FROM documents)"
TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
ORACLE_SQL = {
    "tf_regex": r"SELECT doc_id, CASE WHEN regexp_matches(text, '([A-Z][a-z]+)\.') THEN regexp_extract(text, '([A-Z][a-z]+)\.', 1) END AS value FROM documents",
    "tf_regex_extract": "SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+'), ',') AS value FROM documents",
    "tf_lowercase": "SELECT doc_id, lower(text) AS value FROM documents",
    "tf_strip": r"SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS value FROM documents",
    "tf_join": "SELECT doc_id, array_to_string(string_split(text, ' '), '-') AS value FROM documents",
    "tf_truncate": "SELECT doc_id, left(text, 300) AS value FROM documents",
    "tf_deduplicate": r"""WITH w AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS v FROM (SELECT doc_id, string_split(text, ' ') AS x FROM documents)),
      f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(regexp_replace(v, '^\s+', ''), '\s+$', '')) ORDER BY k) AS n FROM w)
      SELECT doc_id, string_agg(v, ' ' ORDER BY k) AS value FROM f WHERE n = 1 GROUP BY doc_id""",
    "tf_chain": "SELECT doc_id, left(lower(array_to_string(regexp_extract_all(text, '[A-Za-z]+'), ' ')), 40) AS value FROM documents",
    "lexical_overlap": f"""WITH s AS (SELECT d.doc_id, b.item_id, {TOKENS.format('d.text')} AS x, {TOKENS.format('b.text')} AS y FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)
      SELECT doc_id, item_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS overlap FROM s""",
    "url_unquote": "SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN md5(url || ' a+bé' || html) END AS url FROM pages",
    "llm_parse": f"WITH {_ANS} SELECT doc_id, url, score::BIGINT AS score, relevance_type, expansions FROM ans",
    "map_results": f"WITH {_ANS}, {_LNK} SELECT l.url, CASE WHEN a.url IS NOT NULL THEN a.score ELSE coalesce(l.score, 0) END::BIGINT AS score, coalesce(a.relevance_type, 'irrelevant') AS relevance_type, coalesce(a.expansions, '') AS expansions FROM lnk l LEFT JOIN ans a USING (url)",
    "map_partial": f"WITH {_ANS}, {_LNK} SELECT url, pos, score::BIGINT AS score, NULL::VARCHAR AS relevance_type FROM lnk UNION ALL SELECT l.url, l.pos + 100000000, CASE WHEN a.url IS NOT NULL THEN a.score ELSE l.score END::BIGINT, a.relevance_type FROM lnk l LEFT JOIN ans a USING (url)",
    "flat_objects": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 4 END::BIGINT AS n, CASE WHEN event_id % 5 <> 0 AND event_id % 4 > 0 THEN (props->>'$.k')::BIGINT END AS k FROM events",
    "scoring_prompts": r"""WITH l AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1) // 2 AS part, '{"url":"' || role || '","anchor":"' || regexp_replace(text, '[\n"\\/]', ' ', 'g') || '","context":"c"}' AS j, role FROM conversations)
      SELECT conv_id, part, count(*) AS n_links, 'Reader' || chr(10) || 'a nurse' || chr(10) || chr(10) || 'Links' || chr(10) || '[' || string_agg(j, ',' ORDER BY turn, role) || ']' || chr(10) || chr(10) || 'Form' || chr(10) || '{"<url>": {"score": 1}}' AS prompt FROM l GROUP BY conv_id, part""",
    "model_answers": """SELECT item_id, CASE WHEN NOT regexp_matches(text, '[0-9]') THEN '{"n": ' || length(text) || '}' END AS answer FROM benchmark""",
    "link_text": "SELECT page_id, '[URL]' || url || ' [ANCHOR]' || CASE WHEN page_id % 3 > 0 THEN page_id::VARCHAR ELSE '' END || ' [CTX]c' AS text FROM pages",
    "crawl_ids": "SELECT event_id, event_type || '-' || strftime(ts, '%Y-%m-%d_%H:%M:%S') AS crawl_id FROM events",
    "dotted_paths": "SELECT event_id, props->>'$.k' AS k, NULL::VARCHAR AS none, NULL::VARCHAR AS broken FROM events",
    "json_lines": "SELECT event_id, unnest([1, 3, 4, 5])::BIGINT AS line_no, unnest([true, false, true, true]) AS ok FROM events",
    "spec_checks": f"SELECT item_id, p.problem, CASE WHEN p.problem IS NULL THEN 'balanced' END AS priority, CASE WHEN p.problem IS NULL THEN regexp_replace(text, '[^A-Za-z .,]', '', 'g') END AS topic, CASE WHEN p.k = 0 THEN 300 END::BIGINT AS max_len, CASE WHEN p.problem IS NULL THEN CASE p.k WHEN 0 THEN 'f' ELSE 't' END END AS fields FROM benchmark JOIN (VALUES {', '.join('(%d, %s)' % (k, 'NULL::VARCHAR' if x is None else chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39)) for k, (_, _, x) in enumerate(SPEC_CASES))}) p(k, problem) ON item_id % {len(SPEC_CASES)} = p.k",
    "build_prompt": r"""WITH l AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1) // 3 AS part, '{"url":"' || role || '","anchor":"' || regexp_replace(text, '[\n"\\/]', ' ', 'g') || '","context":"c"}' AS j, role FROM conversations)
      SELECT conv_id, part, count(*) AS n_links, 'Topic: health' || chr(10) || chr(10) || 'Score every link.' || chr(10) || chr(10) || '[' || string_agg(j, ',' ORDER BY turn, role) || ']' AS prompt FROM l GROUP BY conv_id, part""",
}
