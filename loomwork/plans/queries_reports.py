"""Queries of reports and inspection views, formats, the space store and the streaming stop monitor."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomwork.functions import format as fmt
from loomwork.functions import lines
from loomwork.operators import answers, cascade, dedup, export, reports, space, telemetry
from loomwork.plans.queries_events import _E, _events
from loomwork.plans.store import shared_dir, written
from loomwork.plans.tables import r6, t
from loomwork.sources import growth, space_store
from loomwork.streaming import events as S


def q_formats(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    v = F.col("value")
    return e.select("event_id", fmt.percent(F.floor(v) / 1000).alias("share"), fmt.short_id(F.col("props"), 5).alias("short"), fmt.relative_age(F.col("event_id").cast("double") * 3).alias("age"), fmt.preview(F.concat(F.lit("  a\n\tb "), F.col("event_type"), F.lit("  ")), 9).alias("preview"), fmt.duration(F.floor(v).cast("double")).alias("duration"))


def q_error_classes(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    name = F.element_at(F.array(*map(F.lit, ("ReadTimeout", "ClientConnectorError", "ClientResponseError", "ValueError"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(fmt.error_class(name).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def q_rate_limited(spark, sf_dir):
    e = t(spark, sf_dir, "events").where("event_type = 'error'")
    return e.where(fmt.is_rate_limit(F.concat(F.lit("status "), F.col("event_id").cast("string")))).select("event_id")


def q_request_delay(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.select("event_id", r6(fmt.request_delay(F.col("value") / 50, (F.col("event_id") % 4).cast("double"), F.lit(0.1))).alias("delay"))


def q_url_search(spark, sf_dir):
    return t(spark, sf_dir, "pages").where(fmt.matches_search(F.col("url"), " BLOG ")).select("page_id", "url")


def q_event_type_filter(spark, sf_dir):
    return reports.of_kinds(_events(spark, sf_dir), ["view", "click"], keep=False).select("seq", "event_type")


def q_node_errors(spark, sf_dir):
    return reports.errors_of(_events(spark, sf_dir), 7).select("seq", "value")


def q_children(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.floor(F.col("c_custkey") / 2).alias("parent_id"))
    return reports.children_of(c, 33)


def q_state_histogram(spark, sf_dir):
    return reports.state_histogram(telemetry.state_at(_events(spark, sf_dir), "node_id"))


def q_drop_rate(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    decided = o.select("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "dropped").when(F.col("o_orderstatus") == "O", "trusted").otherwise("llm").alias("decision"), (F.col("o_custkey") % 10).alias("accepted"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 7).alias("rejected"))
    return reports.drop_rate(decided, "o_orderpriority", ("accepted", "rejected")).withColumn("rate", r6(F.col("rate")))


def q_candidates_by_parent(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent_id"), "l_linenumber", "l_partkey")
    got = reports.candidates_by_parent(li, "parent_id", "l_linenumber", 3)  # orders have seven lines at most
    return got.withColumn("candidates", F.array_join(F.transform("candidates", lambda c: F.format_string("%d:%d", c.l_linenumber, c.l_partkey)), "|"))


def q_max_abs_signal(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return reports.signal_scale(li.select("l_orderkey", (F.col("l_discount") - 0.05).alias("a"), F.col("l_tax").alias("b")), "l_orderkey", ["a", "b"])


def q_retry_attempts(spark, sf_dir):
    return reports.retry_attempts(reports.of_kinds(_events(spark, sf_dir), ["error"]), "node_id")


def q_buffer_stats(spark, sf_dir):
    """A buffer of 40 for each user: what came, what stayed, what was lost."""
    return reports.buffer_stats(t(spark, sf_dir, "events"), "user_id")


def q_signals_in_order(spark, sf_dir):
    n = t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return reports.in_order(n, "event_type", ["signup", "view", "click"])


def q_visible_edges(spark, sf_dir):
    """Distinct edges both of whose ends are nodes."""
    c = t(spark, sf_dir, "customer").where("c_custkey % 4 <> 3")
    edges = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), F.pmod(F.col("o_orderkey"), F.lit(1500)).alias("b"))
    return reports.visible_edges(edges, c.select(F.col("c_custkey").alias("node_id")))


def q_sampled_union(spark, sf_dir):
    """What the cascade sends to the model, over orders as links of customers."""
    links = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("nlp_score"), cascade.bucket(F.col("o_totalprice"), 100_000, 250_000).alias("bucket"))
    decided = cascade.decisions(links, "o_custkey", "o_orderkey", "seed", low_share=0.3, high_share=0.5, random_share=0.5)
    return reports.seen_by_model(decided).select("o_orderkey", "part")


def q_running_depth(spark, sf_dir):
    """Nodes and largest depth after each node that is added."""
    e = reports.of_kinds(_events(spark, sf_dir), ["signup"]).select("seq", (F.col("node_id") % 40).alias("depth"))
    return reports.running_depth(e, width=700)


def q_table_ddl(spark, sf_dir):
    """A table of the catalogue in the shared folder, made with the kinds of a table's columns and filled by export_rows."""
    p = t(spark, sf_dir, "part")
    name = f"site_{uuid.uuid4().hex}"
    fields = {"p_retailprice": "real", "p_size": "int", "p_type": "json", "p_name": "text"}
    spark.sql(export.ddl(name, fields, shared_dir(spark)))
    rows = p.select(F.col("p_partkey").cast("string").alias("id"), F.lit("c").alias("crawl_id"), F.lit("u").alias("url"), F.lit("2024").alias("created_at"), *fields)
    export.export_rows(rows, fields).write.insertInto(name)
    found = spark.createDataFrame([(c.name, c.dataType, c.name in export.MANDATORY) for c in spark.catalog.listColumns(name)], "name string, type string, mandatory boolean")
    listed = export.list_tables(spark).where(F.col("table_name") == name).select(F.lit(True).alias("listed"))
    sums = written(spark.table(name).agg(F.count("*").alias("n"), F.sum("p_size").alias("size")).crossJoin(listed))
    spark.sql(f"DROP TABLE {name}")
    return found.join(F.broadcast(sums))


def q_space_store(spark, sf_dir):
    """Saved, grown, saved again as the next version; the index tells both."""
    path = shared_dir(spark)
    e = t(spark, sf_dir, "embeddings")
    space = e.select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("vector"), F.lit("seed").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source_url"))
    space_store.save(space, path, "bp", 1)
    items = t(spark, sf_dir, "benchmark").select(F.concat(F.lit("u"), F.col("item_id").cast("string")).alias("url"), F.split("text", r"\.\s*").alias("expansions"))
    space_store.save(space_store.grown(space_store.load(spark, path, "bp", 1), items), path, "bp", 2)
    got = space_store.index(spark, path)
    saved = space_store.load(spark, path, "bp", 2).select(F.lit("bp").alias("blueprint_id"), F.lit(2).alias("version"), "key", "type", F.md5(F.array_join(F.transform("vector", lambda x: F.format_string("%.4f", x)), ",")).alias("digest"))
    old = saved.where("type = 'seed'").groupBy("blueprint_id", "version").agg(F.min("digest").alias("least"), F.max("key").alias("last"))
    return got.join(old, ["blueprint_id", "version"], "left").select("blueprint_id", F.col("version").cast("long").alias("version"), "n_vectors", "least", "last")


def q_space_growth(spark, sf_dir):
    items = t(spark, sf_dir, "benchmark").select(F.concat(F.lit("u"), F.col("item_id").cast("string")).alias("url"), F.split("text", " ").alias("expansions"))
    none = spark.createDataFrame([], "key string, vector array<float>, type string, text string, source_url string")
    return space_store.grown(none, items).select("key", "type", "text", "source_url", F.size("vector").cast("long").alias("dim"))


CAPACITY = 25


def q_space_flushes(spark, sf_dir):
    """Two batches of topics with their sentences into a buffer that holds 25; a full buffer makes a version."""
    items = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq"), F.concat(F.lit("u"), F.col("item_id").cast("string")).alias("url"), F.split("text", " ").alias("expansions"))
    source, path = shared_dir(spark), shared_dir(spark)
    for part in (0, 1):
        items.where(F.col("seq") % 2 == part).write.mode("append").parquet(source)
        growth.grow_stream(spark.readStream.schema(growth.LINKS).parquet(source), path, "bp", f"{path}-state", capacity=CAPACITY, every=1e9, clock=lambda: 0.0)
    return growth.buffer_totals(spark, path).select("batches", "added", "kept", "lost", "flushes", "version", "waiting")


def q_item_hash_exact(spark, sf_dir):
    docs = t(spark, sf_dir, "documents")
    items = docs.select("doc_id", F.struct(F.col("source").alias("b"), F.array("lang", F.lit("é")).alias("a")).alias("item"))
    return dedup.with_item_hash(items).select("doc_id", "item_hash")


def q_traced_minimal(spark, sf_dir):
    return telemetry.traced(t(spark, sf_dir, "events"), "minimal", "event_id").select("event_id", "event_type")


def q_stream_upsert(spark, sf_dir):
    """Two batches of a stream into one table; the last event of each user and type stays."""
    e, out, source = t(spark, sf_dir, "events"), shared_dir(spark), shared_dir(spark)
    rows = e.select("user_id", "event_type", F.col("event_id").alias("seq"), "value")
    rows.where("seq % 2 = 0").write.parquet(source)
    stream = lambda: S.read_events(spark, source, rows.schema)
    S.upsert_stream(stream(), out, f"{out}-state", ["user_id", "event_type"], "seq")
    rows.where("seq % 2 = 1").write.mode("append").parquet(source)
    S.upsert_stream(stream(), out, f"{out}-state", ["user_id", "event_type"], "seq")
    return export.upserted(spark, out, rows.schema)


def q_debug_lines(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return telemetry.debug_lines(e, F.lit("scoring"), F.col("event_type"), {"value": F.floor("value")}, {"url": F.concat(F.lit("a%20b+"), F.col("user_id").cast("string"))}, "event_id")


def _typed(spark, sf_dir, types):
    """Events with a type out of a list by their number, and made-up fields."""
    e = t(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, types)), (F.col("event_id") % len(types) + 1).cast("int"))
    some = lambda n: F.sequence(F.lit(1), (F.col("user_id") % n + 1).cast("int"))
    url = F.concat(F.lit("http://h/a%20b/"), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).otherwise(""))
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3).alias("worker"), kind.alias("type"), F.col("user_id").alias("node_id"), (F.col("user_id") + 1_000_000).alias("parent_id"), url.alias("url"), F.lit(2).alias("depth"), some(5).alias("links"), some(3).alias("items"), some(4).alias("nodes"), some(2).alias("candidates"),
                    F.lit("t").alias("table"), F.lit(7).alias("n"), (F.floor("value") / 4).alias("duration"), (F.floor("value") / 4).alias("priority"), F.lit("IDLE").alias("reason"), F.lit("S").alias("state"), F.lit("scoring").alias("stage"), F.col("event_type").alias("phase"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("detail"), F.when(F.col("user_id") % 2 == 0, "dropped").alias("decision"), F.lit("boom").alias("error"))


def q_narrative(spark, sf_dir):
    return lines.narrative(_typed(spark, sf_dir, [*lines.NARRATIVE, "OTHER"]))


def q_event_summaries(spark, sf_dir):
    e = _typed(spark, sf_dir, [*lines.SUMMARY, "CANDIDATE_EVALUATED", "OTHER"])
    return e.select("seq", lines.clock_time(F.col("ts")).alias("at"), lines.summary(e).alias("summary"))


def q_valid_messages(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit('"}'))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.lit("{broken"))
    return telemetry.valid_messages(e.select("event_id", line.alias("value"))).select("event_id", "type")


def q_expansion_prompts(spark, sf_dir):
    """Six blocks: who answers, the topic, how many, how long, what about, and the form."""
    topics = t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("topic"))
    blocks = [("", "A catalogue clerk fills in cards."), ("Card", F.col("topic")), ("Lines", "5"), ("Length", "twelve words"), ("Sides", "use, origin, price"), ("Form", '["...", "..."]')]
    return answers.expansion_prompts(topics, blocks).select("item_id", "prompt")



def q_export_json(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.lit("c").alias("crawl_id"), F.lit("u").alias("url"), F.lit("2024").alias("created_at"), "props", F.array("event_type", F.lit("é")).alias("kinds"), F.array("value").alias("list"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("{"), "event_type")).otherwise("null").alias("note"))
    return export.export_rows(rows, {"props": "json", "kinds": "text", "list": "int", "note": "json"})


def q_cluster_entries(spark, sf_dir):
    v = t(spark, sf_dir, "embeddings").select("vec_id", "label")
    return space.cluster_entries(v, v.select("vec_id", F.when(F.col("label") < 3, -1).otherwise(F.col("label")).alias("cluster")), "vec_id").select("vec_id", "cluster")


def q_edges(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    return telemetry.edges_of(c.select((F.col("c_custkey") % 200).alias("node_id"), F.when(F.col("c_custkey") > 1, F.col("c_custkey") % 10).alias("parent_id")))


def q_stream_stop(spark, sf_dir):
    """The stateful stop monitor over what is there, one crawl for each remainder of the user: nodes, time, target or idleness ends it."""
    e, out = t(spark, sf_dir, "events"), shared_dir(spark)
    stream = S.read_events(spark, f"{sf_dir}/events.parquet*", e.schema).select((F.col("user_id") % 5).alias("crawl_id"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_type") == "signup", "node_added").otherwise("other").alias("type"), F.lit(0).alias("depth"), F.concat(F.lit("/u/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string")).alias("url"))
    S.run_to(S.stop_monitor(stream, 300, 9, 25 * 86400.0, "/u/3/8", 9000), out, f"{out}-state")
    return spark.read.schema("crawl_id long, stop_seq long, reason string").parquet(out)


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
ORACLE_SQL = {
    "formats": """SELECT event_id, printf('%.1f%%', floor(value) / 1000 * 100) AS share, CASE WHEN length(props) > 5 THEN left(props, 5) || '…' ELSE props END AS short,
      CASE WHEN event_id * 3 < 60 THEN round(event_id * 3.0::DOUBLE)::BIGINT || 's ago' WHEN event_id * 3 < 3600 THEN round(event_id * 3.0::DOUBLE / 60)::BIGINT || 'm ago' ELSE round(event_id * 3.0::DOUBLE / 3600)::BIGINT || 'h ago' END AS age,
      CASE WHEN length('a b ' || event_type) > 9 THEN left('a b ' || event_type, 9) || '…' ELSE 'a b ' || event_type END AS preview,
      CASE WHEN floor(value) < 1000 THEN floor(value)::BIGINT || ' ms' ELSE printf('%.1f s', floor(value) / 1000) END AS duration FROM events""",
    "error_classes": "SELECT CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'connection' WHEN 2 THEN 'http_error' ELSE 'unknown' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "rate_limited": "SELECT event_id FROM events WHERE event_type = 'error' AND contains(event_id::VARCHAR, '429')",
    "request_delay": "SELECT event_id, round(greatest(1 - value / 50, 0) + (event_id % 4)::DOUBLE + 0.1::DOUBLE, 6) AS delay FROM events",
    "url_search": "SELECT page_id, url FROM pages WHERE contains(lower(url), 'blog')",
    "event_type_filter": "SELECT event_id AS seq, event_type FROM events WHERE event_type NOT IN ('view', 'click')",
    "node_errors": "SELECT event_id AS seq, value FROM events WHERE user_id = 7 AND event_type = 'error'",
    "children": "SELECT c_custkey AS node_id, c_custkey // 2 AS parent_id FROM customer WHERE c_custkey // 2 = 33",
    "state_histogram": f"WITH {_E} SELECT state, count(*) AS n FROM (SELECT node_id, max_by(state, seq) AS state FROM e GROUP BY node_id) GROUP BY state",
    "drop_rate": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS dropped, count(*) FILTER (WHERE o_orderstatus = 'O') AS trusted, round(coalesce(count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / nullif(count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')), 0), 0), 6) AS rate, sum(o_custkey % 10)::BIGINT AS accepted, (sum(o_custkey % 7) FILTER (WHERE o_custkey % 3 > 0))::BIGINT AS rejected FROM orders GROUP BY 1",
    "candidates_by_parent": "SELECT l_orderkey AS parent_id, part, n, string_agg(printf('%d:%d', l_linenumber, l_partkey), '|' ORDER BY l_linenumber, l_partkey) AS candidates FROM (SELECT l_orderkey, l_linenumber, l_partkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1) // 3 AS part, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY 1, 2, 3",
    "max_abs_signal": "SELECT l_orderkey, greatest(0.001::DOUBLE, max(greatest(abs(l_discount - 0.05::DOUBLE), abs(l_tax)))) AS scale FROM lineitem GROUP BY 1",
    "retry_attempts": "SELECT user_id AS node_id, count(*) AS attempts, least(count(*), 3) AS retried FROM events WHERE event_type = 'error' GROUP BY 1",
    "buffer_stats": "SELECT user_id, count(*) AS added, least(count(*), 40) AS kept, greatest(count(*) - 40, 0) AS lost FROM events GROUP BY 1",
    "signals_in_order": "SELECT event_type, CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 99 END::BIGINT AS place, count(*) AS n FROM events GROUP BY 1",
    "visible_edges": "SELECT DISTINCT o_custkey AS a, o_orderkey % 1500 AS b FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 3) AND o_orderkey % 1500 IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 3)",
    "sampled_union": """WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice > 250000 THEN 'high' ELSE 'mid' END AS bucket FROM orders),
      n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, bucket) AS n, row_number() OVER (PARTITION BY o_custkey, bucket ORDER BY md5('seed' || o_orderkey), o_orderkey) AS k FROM o),
      h AS (SELECT *, floor(n * 0.5::DOUBLE) AS h, floor(floor(n * 0.5::DOUBLE) * 0.5::DOUBLE) AS rnd FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, bucket, k <= rnd ORDER BY o_totalprice DESC, o_orderkey) AS r FROM h)
      SELECT o_orderkey, CASE bucket WHEN 'mid' THEN 'mid' ELSE bucket || '_sample' END AS part FROM r WHERE bucket = 'mid' OR bucket = 'low' AND k <= floor(n * 0.3::DOUBLE) OR bucket = 'high' AND (k <= rnd OR r <= h - rnd)""",
    "running_depth": "SELECT event_id AS seq, user_id % 40 AS depth, count(*) OVER (ORDER BY event_id) AS nodes, max(user_id % 40) OVER (ORDER BY event_id) AS top_depth FROM events WHERE event_type = 'signup'",
    "table_ddl": "SELECT unnest(['id', 'crawl_id', 'url', 'created_at', 'p_retailprice', 'p_size', 'p_type', 'p_name']) AS name, unnest(['string', 'string', 'string', 'string', 'double', 'bigint', 'string', 'string']) AS type, unnest([true, true, true, true, false, false, false, false]) AS mandatory, n, size, true AS listed FROM (SELECT count(*) AS n, sum(p_size)::BIGINT AS size FROM part)",
    "space_store": r"WITH e AS (SELECT count(*) AS n, min(md5(array_to_string(list_transform(embedding, lambda x: printf('%.4f', x::DOUBLE)), ','))) AS least, max(vec_id::VARCHAR) AS last FROM embeddings) SELECT 'bp' AS blueprint_id, 1::BIGINT AS version, n AS n_vectors, NULL::VARCHAR AS least, NULL::VARCHAR AS last FROM e UNION ALL SELECT 'bp', 2, n + (SELECT sum(len(regexp_split_to_array(text, '\.\s*'))) FROM benchmark)::BIGINT, least, last FROM e",
    "space_growth": "SELECT 'u' || item_id || '::exp::' || k AS key, 'expansion' AS type, w AS text, 'u' || item_id AS source_url, 64::BIGINT AS dim FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS k FROM benchmark)",
    "space_flushes": f"""WITH n AS (SELECT count(*) FILTER (WHERE item_id % 2 = 0) AS a, count(*) FILTER (WHERE item_id % 2 = 1) AS b FROM benchmark), k AS (SELECT *, least(a, {CAPACITY}) AS k1, a >= {CAPACITY} AS f1 FROM n),
      m AS (SELECT *, CASE WHEN f1 THEN 0 ELSE k1 END AS held, least(b, {CAPACITY} - CASE WHEN f1 THEN 0 ELSE k1 END) AS k2 FROM k), f AS (SELECT *, held + k2 >= {CAPACITY} AS f2 FROM m)
      SELECT 2::BIGINT AS batches, a + b AS added, k1 + k2 AS kept, a + b - k1 - k2 AS lost, f1::BIGINT + f2::BIGINT AS flushes, f1::BIGINT + f2::BIGINT AS version, CASE WHEN f2 THEN 0 ELSE held + k2 END AS waiting FROM f""",
    "item_hash_exact": """SELECT doc_id, sha256('{"a": ["' || lang || '", "\\u00e9"], "b": "' || source || '"}') AS item_hash FROM documents""",
    "traced_minimal": "SELECT event_id, event_type FROM events WHERE event_type IN ('signup', 'error')",
    "stream_upsert": "SELECT user_id, event_type, max(event_id) AS seq, max_by(value, event_id) AS value FROM events GROUP BY 1, 2",
    "debug_lines": "SELECT event_id, '[SCORING] ' || event_type || ' value=' || floor(value)::BIGINT || '.0000 url=a b+' || user_id AS line FROM events",
    "narrative": r"""WITH e AS (SELECT *, event_id % 10 AS k, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || '][W' || event_id % 3 || '] ' AS p, regexp_replace(printf('%.2f', floor(value) / 4), '\.?0+$', '') AS d, user_id % 5 + 1 AS l, user_id % 3 + 1 AS i FROM events)
      SELECT event_id AS seq, p || CASE k WHEN 0 THEN '[NODE] id=' || user_id || ' → CREATED url=http://h/a b/' || CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR ELSE '' END || ' depth=2' WHEN 1 THEN '[NODE] id=' || user_id || ' → FETCHED'
        WHEN 2 THEN '[NODE] id=' || user_id || ' → FILTERED (links=' || l || ', items=' || i || ')' WHEN 3 THEN '[NODE] id=' || user_id || ' → TRANSFORMED (items=' || i || ')' WHEN 4 THEN '[NODE] id=' || user_id || ' → SCORED (links=' || l || ')'
        WHEN 5 THEN '[NODE] id=' || user_id || ' → EXPANDED (children=' || l || ')' WHEN 6 THEN '[EXPORT] COMPLETED table=t inserted=7 duration_ms=' || d WHEN 7 THEN '[SCORE_RESCHEDULE] [NODE] id=' || user_id || ' new_priority=' || (floor(value) / 4)::DOUBLE
        ELSE '[CRAWL] STOPPED reason=IDLE nodes=7 depth=2 duration=' || d || 's' END AS line FROM e WHERE k < 9""",
    "event_summaries": """WITH e AS (SELECT *, event_id % 10 AS k FROM events)
      SELECT event_id AS seq, strftime(ts, '%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') AS at, CASE k WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN left(user_id::VARCHAR, 6) || '… → S' WHEN 2 THEN left((user_id + 1000000)::VARCHAR, 6) || '… → 7 children'
        WHEN 3 THEN (user_id % 4 + 1) || ' nodes' WHEN 4 THEN 'IDLE' WHEN 5 THEN 'scoring ' || event_type || CASE WHEN event_id % 4 = 0 THEN ' — ' || event_type ELSE '' END WHEN 6 THEN left(user_id::VARCHAR, 6) || '… priority=' || printf('%.2f', floor(value) / 4) WHEN 7 THEN 'scoring: boom'
        WHEN 8 THEN CASE WHEN user_id % 2 = 0 THEN '1 link dropped' ELSE '2 links trusted' END ELSE '' END AS summary FROM e""",
    "valid_messages": "SELECT event_id, event_type AS type FROM events WHERE event_id % 3 = 0",
    "expansion_prompts": """SELECT item_id, 'A catalogue clerk fills in cards.' || chr(10) || chr(10) || 'Card' || chr(10) || text || chr(10) || chr(10) || 'Lines' || chr(10) || '5' || chr(10) || chr(10) || 'Length' || chr(10) || 'twelve words' || chr(10) || chr(10) || 'Sides' || chr(10) || 'use, origin, price' || chr(10) || chr(10) || 'Form' || chr(10) || '["...", "..."]' AS prompt FROM benchmark""",
    "export_json": """SELECT event_id::VARCHAR AS id, 'c' AS crawl_id, 'u' AS url, '2024' AS created_at, props, '["' || event_type || '", "é"]' AS kinds, NULL::BIGINT AS list, CASE WHEN event_id % 2 = 0 THEN '"{' || event_type || '"' END AS note FROM events""",
    "cluster_entries": "SELECT vec_id, label AS cluster FROM embeddings WHERE label >= 3",
    "edges": "SELECT DISTINCT c_custkey % 10 AS a, c_custkey % 200 AS b FROM customer WHERE c_custkey > 1",
    "stream_stop": """WITH r AS (SELECT user_id % 5 AS crawl_id, event_id, event_type, user_id, lag(event_id) OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS prev,
        (epoch_us(ts) - epoch_us(max(ts) OVER (PARTITION BY user_id % 5 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))) / 1000000.0::DOUBLE AS gap, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS n, (epoch_us(ts) - epoch_us(first_value(ts) OVER (PARTITION BY user_id % 5 ORDER BY event_id))) / 1000000.0::DOUBLE AS el FROM events),
      s AS (SELECT crawl_id, event_id, CASE WHEN gap >= 9000 THEN prev ELSE event_id END AS stop, CASE WHEN gap >= 9000 THEN 'NO_PROGRESS' WHEN event_type = 'signup' AND n >= 300 THEN 'MAX_NODES' WHEN event_type = 'signup' AND starts_with('/u/' || user_id || '/' || event_id, '/u/3/8') THEN 'TARGET_REACHED' WHEN el >= 25 * 86400 THEN 'MAX_TIME' END AS reason FROM r)
      SELECT crawl_id, arg_min(stop, event_id) AS stop_seq, arg_min(reason, event_id) AS reason FROM s WHERE reason IS NOT NULL GROUP BY crawl_id""",
}
