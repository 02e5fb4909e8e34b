"""Queries over pages: extraction, url handling, dedup."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.functions import sql
from loomwork.functions import urls as U
from loomwork.functions.scores import shared_part, tokens
from loomwork.operators import dedup, export
from loomwork.operators.extract import domain_links, extract_items, extract_links
from loomwork.plans.store import shared_dir, written
from loomwork.plans.tables import r6, t

#: Links and their resolution as SQL over the fixture's regular markup; used by several queries.
LINKS_SQL = r"""
links AS (
  SELECT page_id, page_url, pos, href, anchor, CASE WHEN starts_with(href, '/') THEN regexp_extract(page_url, '^[a-z]+://[^/?#]*') || href ELSE href END AS url
  FROM (SELECT page_id, url AS page_url, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)))) AS pos,
               unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
               unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS anchor FROM pages))
"""
#: Test adapter: links of every third page count as seen before.
SEEN_SQL = "seen AS (SELECT DISTINCT url FROM links WHERE page_id % 3 = 0)"


def links_of(spark, sf_dir):
    return extract_links(t(spark, sf_dir, "pages"), "//a[@href]")


def q_extract_links(spark, sf_dir):
    return links_of(spark, sf_dir).select("page_id", "pos", "url", "anchor", "context")


def q_resolve_urls(spark, sf_dir):
    return links_of(spark, sf_dir).select("page_id", "pos", "url", U.hostname(F.col("url")).alias("host"), U.path_and_query(F.col("url")).alias("path"), U.is_absolute(F.col("url")).alias("absolute"))


def q_top_links_per_host(spark, sf_dir):
    """Pages are parsed once, their words told apart once for each page."""
    all_links = written(links_of(spark, sf_dir).select("page_id", "pos", "url", tokens(F.col("anchor")).alias("x")))
    links = dedup.dedup_links(all_links, all_links.where("page_id % 3 = 0").select("url"))
    pages = t(spark, sf_dir, "pages").select("page_id", tokens(F.coalesce("html", F.lit(""))).alias("y"))
    scored = links.join(pages, "page_id").select("page_id", "pos", "url", U.hostname(F.col("url")).alias("host"), r6(shared_part(F.col("x"), F.col("y"))).alias("overlap"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("overlap"), "url", "page_id", "pos"))
    return scored.withColumn("rank", rank.cast("long")).where("rank <= 20").select("host", "rank", "url", "overlap")


DOCUMENT_SPEC = {"mode": "document", "fields": {"title": {"selector": "//title", "type": "scalar"}, "heading": {"selector": "//article/h1", "type": "scalar"}, "missing": {"selector": "//table", "type": "scalar"}}}
CONTAINER_SPEC = {"mode": "container", "container": "//nav/ul/li", "fields": {"label": {"selector": "./a", "type": "scalar"}, "href": {"selector": "./a/@href", "type": "scalar"}}}
LIST_SPEC = {"mode": "document", "fields": {"labels": {"selector": "//nav//a/text()", "type": "list"}, "n": {"selector": "count(//nav//a)", "type": "scalar"}, "none": {"selector": "//video/@src", "type": "list"}}}


def q_items_document(spark, sf_dir):
    return extract_items(t(spark, sf_dir, "pages"), DOCUMENT_SPEC).select("page_id", "item.title", "item.heading", "item.missing")


def q_items_container(spark, sf_dir):
    return extract_items(t(spark, sf_dir, "pages"), CONTAINER_SPEC).select("page_id", F.col("pos").cast("long").alias("pos"), "item.label", "item.href")


def q_sql_links(spark, sf_dir):
    """Links by the table function of plain SQL."""
    sql.register(spark)
    return spark.sql("SELECT page_id, l.* FROM {pages}, LATERAL page_links(html, url) AS l", pages=t(spark, sf_dir, "pages").select("page_id", "url", "html"))


def q_sql_items(spark, sf_dir):
    """Items by the table function, whose spec gives the columns."""
    sql.register(spark)
    text = "SELECT page_id, i.* FROM {pages}, LATERAL page_items(html, :spec) AS i"
    return spark.sql(text, {"spec": json.dumps(CONTAINER_SPEC)}, pages=t(spark, sf_dir, "pages").select("page_id", "html"))


def q_field_scalar_list(spark, sf_dir):
    items = extract_items(t(spark, sf_dir, "pages"), LIST_SPEC)
    return items.select("page_id", F.array_join("item.labels", "|").alias("labels"), F.col("item.n").cast("double").alias("n"), F.size("item.none").cast("long").alias("n_none"))


def _seen(spark, sf_dir):
    links = links_of(spark, sf_dir)
    return links.where("page_id % 3 = 0").select("url"), links.where("page_id % 3 <> 0").select("page_id", "pos", "url", "anchor")


def q_dedup_links_cross_page(spark, sf_dir):
    seen, new = _seen(spark, sf_dir)
    return dedup.dedup_links(new, seen)


def q_dedup_links_strict(spark, sf_dir):
    seen, new = _seen(spark, sf_dir)
    return dedup.dedup_links(new, seen, "strict").select("page_id", "pos", "url", "anchor")


def q_accept_reject_counts(spark, sf_dir):
    seen, new = _seen(spark, sf_dir)
    return dedup.accept_reject_counts(new, seen, "page_id")


def q_found_links_grown(spark, sf_dir):
    seen, new = _seen(spark, sf_dir)
    return dedup.grown(seen.distinct(), dedup.dedup_links(new, seen))


def _items(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    return docs.withColumn("item_hash", dedup.item_hash(["lang", "source"]))


def q_item_hash(spark, sf_dir):
    return _items(spark, sf_dir).select("doc_id", "item_hash")


def q_dedup_items(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").withColumn("item_hash", F.sha2("text", 256))
    return dedup.dedup_items(docs.where("doc_id >= 500").select("doc_id", "item_hash"), docs.where("doc_id < 500"))


def q_raw_documents(spark, sf_dir):
    raw = export.raw_documents(t(spark, sf_dir, "pages"), "loomwork", F.lit("2024-01-01T00:00:00Z"))
    return raw.select("id", "source_type", "source_uri", "title", "language", "retrieved_at", F.col("metadata")["crawler"].alias("crawler"), F.md5("text").alias("digest"))


def q_raw_documents_written(spark, sf_dir):
    """Written as JSON lines and read again."""
    path = shared_dir(spark)
    raw = export.raw_documents(t(spark, sf_dir, "pages"), "loomwork", F.lit("2024-01-01T00:00:00Z"))
    export.write_raw_documents(raw.where("id % 2 = 0"), path)
    export.write_raw_documents(raw.where("id % 2 = 1"), path)
    return spark.read.schema(raw.schema).json(path).select("id", "source_uri", F.md5("text").alias("digest"))


def q_fetch_by_client(spark, sf_dir):
    """Pages by a client that the tasks call: it fails for some addresses and has nothing for others."""
    from loomwork.sources.pages import by_fetching

    def fetch(url):
        if "blog." in url:
            raise OSError("refused")
        return None if url.endswith("#top") else f"<p>{url}</p>"

    return by_fetching(t(spark, sf_dir, "pages").select("page_id", "url"), fetch)


def q_domain_links(spark, sf_dir):
    """Each domain has its own selector and the address that relative links belong to; pages of a third have none."""
    named = [("a", "https://one.example/start/page", "//nav/ul/li/a"), ("b", "http://two.example", "//a[@href]")]
    domains = spark.createDataFrame(named, "domain string, base_url string, link_selector string")
    pages = t(spark, sf_dir, "pages").select("page_id", "html", F.element_at(F.array(*map(F.lit, "abc")), (F.col("page_id") % 3 + 1).cast("int")).alias("domain"))
    return domain_links(pages, domains).select("page_id", "pos", "url", "anchor")


def q_fetch_from_table(spark, sf_dir):
    from loomwork.sources.pages import from_table

    pages = t(spark, sf_dir, "pages")
    front = pages.select(F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("#gone"))).otherwise(F.col("url")).alias("url"))
    return from_table(front, pages).select("url", F.col("html").isNotNull().alias("fetched"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
NEW_SQL = f"WITH {LINKS_SQL}, {SEEN_SQL}, fresh AS (SELECT page_id, pos, url, anchor FROM links WHERE page_id % 3 <> 0)"
TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
PLAIN = "replace(replace(replace(replace(regexp_extract(html, '<{}>([^<]*)<', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
ORACLE_SQL = {
    "extract_links": f"WITH {LINKS_SQL} SELECT page_id, pos, url, anchor, anchor AS context FROM links",
    "sql_links": f"WITH {LINKS_SQL} SELECT page_id, pos, url, anchor, anchor AS context FROM links",
    "sql_items": f"WITH {LINKS_SQL} SELECT page_id, pos, anchor AS label, href FROM links",
    "resolve_urls": f"WITH {LINKS_SQL} SELECT page_id, pos, url, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS host, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) END AS path, regexp_matches(url, '^[a-z]+://') AS absolute FROM links",
    "top_links_per_host": f"""WITH {LINKS_SQL}, {SEEN_SQL}, s AS (SELECT l.page_id, l.pos, l.url, regexp_replace(regexp_extract(l.url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS host, {TOKENS.format('l.anchor')} AS x, {TOKENS.format('p.html')} AS y FROM links l JOIN pages p USING (page_id) WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.url = l.url)),
      o AS (SELECT *, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END, 6) AS overlap FROM s)
      SELECT host, rank, url, overlap FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY overlap DESC, url, page_id, pos) AS rank FROM o) WHERE rank <= 20""",
    "items_document": f"SELECT page_id, {PLAIN.format('title')} AS title, {PLAIN.format('h1')} AS heading, NULL::VARCHAR AS missing FROM pages",
    "items_container": f"WITH {LINKS_SQL} SELECT page_id, pos, anchor AS label, href FROM links",
    "field_scalar_list": f"WITH {LINKS_SQL} SELECT page_id, string_agg(anchor, '|' ORDER BY pos) AS labels, count(*)::DOUBLE AS n, 0::BIGINT AS n_none FROM links GROUP BY page_id",
    "dedup_links_cross_page": f"{NEW_SQL} SELECT * FROM fresh WHERE url NOT IN (SELECT url FROM seen)",
    "dedup_links_strict": f"{NEW_SQL} SELECT page_id, pos, url, anchor FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, pos, anchor) AS k FROM fresh WHERE url NOT IN (SELECT url FROM seen)) WHERE k = 1",
    "accept_reject_counts": f"{NEW_SQL} SELECT page_id, count(*) FILTER (WHERE url NOT IN (SELECT url FROM seen)) AS accepted, count(*) FILTER (WHERE url IN (SELECT url FROM seen)) AS rejected FROM fresh GROUP BY page_id",
    "found_links_grown": f"WITH {LINKS_SQL} SELECT DISTINCT url FROM links",
    "item_hash": """SELECT doc_id, sha256('{"lang": "' || lang || '", "source": "' || source || '"}') AS item_hash FROM documents""",
    "dedup_items": "SELECT doc_id, sha256(text) AS item_hash FROM documents WHERE doc_id >= 500 AND text NOT IN (SELECT text FROM documents WHERE doc_id < 500)",
    "raw_documents": "SELECT page_id::VARCHAR AS id, 'web' AS source_type, url AS source_uri, '' AS title, 'en' AS language, '2024-01-01T00:00:00Z' AS retrieved_at, 'loomwork' AS crawler, md5(html) AS digest FROM pages",
    "raw_documents_written": "SELECT page_id::VARCHAR AS id, url AS source_uri, md5(html) AS digest FROM pages",
    "fetch_by_client": "SELECT page_id, url, CASE WHEN contains(url, 'blog.') OR url LIKE '%#top' THEN NULL ELSE '<p>' || url || '</p>' END AS html FROM pages",
    "domain_links": f"WITH {LINKS_SQL} SELECT page_id, pos, CASE WHEN starts_with(href, '/') THEN CASE page_id % 3 WHEN 0 THEN 'https://one.example' ELSE 'http://two.example' END || href ELSE href END AS url, anchor FROM links WHERE page_id % 3 < 2",
    "fetch_from_table": "SELECT CASE WHEN page_id % 5 = 0 THEN url || '#gone' ELSE url END AS url, page_id % 5 <> 0 AS fetched FROM pages",
}
