"""Queries over vectors: neighbours, densities, clusters, features, the cascade and priorities.

Test adapter: all vectors are the space; those whose id is divisible by 20 are the candidate links that are looked
up in it, of node (vec_id / 20) modulo NODES."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import scores, sql
from loomwork.operators import cascade, graph, space
from loomwork.plans.store import written
from loomwork.plans.tables import r6, t

QUERY, NODES = 20, 10
#: Documents that are parents of links where features are asked for; the smallest table has as many.
PARENTS = 200
RADIUS = 0.65
EPS = 0.62
LOW, HIGH, NEAR = 0.675, 0.69, 0.35
#: Budgets that aren't zero for the small groups of the fixture.
SHARES = {"low_share": 0.5, "high_share": 0.6, "random_share": 0.4}


def _vectors(spark, sf_dir):
    df = t(spark, sf_dir, "embeddings")
    return df.where(F.col("vec_id") % QUERY == 0), df


def _node():
    return F.floor(F.col("vec_id") / QUERY) % NODES


def _stats(spark, sf_dir):
    links, basis = _vectors(spark, sf_dir)
    return space.space_stats(links, basis, "vec_id", "vec_id", "embedding", RADIUS)


def q_knn(spark, sf_dir):
    links, basis = _vectors(spark, sf_dir)
    found = space.neighbours(links, basis.withColumnRenamed("vec_id", "basis_id"), "vec_id", "basis_id", "embedding", 5, NEAR)
    return found.select("vec_id", "rank", "basis_id", r6(F.col("similarity")).alias("similarity"))


def q_target_similarity(spark, sf_dir):
    return _stats(spark, sf_dir).select("vec_id", r6(space.target_similarity()).alias("value"))


def q_mean_similarity(spark, sf_dir):
    return _stats(spark, sf_dir).select("vec_id", r6(space.mean_similarity()).alias("value"))


def q_region_density(spark, sf_dir):
    return _stats(spark, sf_dir).select("vec_id", r6(space.region_density()).alias("value"))


def q_novelty_injection(spark, sf_dir):
    return _stats(spark, sf_dir).select("vec_id", r6(space.novelty_injection()).alias("value"))


def q_space_novelty(spark, sf_dir):
    return _stats(spark, sf_dir).select("vec_id", r6(space.space_novelty()).alias("value"))


def q_space_density(spark, sf_dir):
    d = space.region_density()
    return _stats(spark, sf_dir).select("vec_id", r6(d).alias("density"), r6(1 - d).alias("coverage_gap"))


def q_centroids(spark, sf_dir):
    c = space.centroids(t(spark, sf_dir, "embeddings"), "label", "embedding")
    return c.select(F.col("label").cast("long").alias("label"), F.posexplode("centroid").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), r6(F.col("x")).alias("x"))


def q_sql_centroids(spark, sf_dir):
    """Centroids by the aggregate of plain SQL."""
    sql.register(spark)
    got = spark.sql("SELECT label, vector_mean(embedding) AS centroid FROM {e} GROUP BY label", e=t(spark, sf_dir, "embeddings"))
    return got.select(F.col("label").cast("long").alias("label"), F.posexplode("centroid").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), r6(F.col("x")).alias("x"))


def q_cluster_distance(spark, sf_dir):
    links, basis = _vectors(spark, sf_dir)
    c = written(space.centroids(basis, "label", "embedding"))
    return space.cluster_distance(links, c, "vec_id", "embedding").select("vec_id", r6(F.col("cluster_distance")).alias("value"))


def q_dbscan(spark, sf_dir):
    return space.dbscan(t(spark, sf_dir, "embeddings"), "vec_id", "embedding", EPS)


def q_dbscan_shared(spark, sf_dir):
    """Every vector three times, in several blocks: copies are one cluster whatever else is near."""
    e = t(spark, sf_dir, "embeddings")
    rows = e.select(F.explode(F.array(*[F.col("vec_id") * 3 + k for k in range(3)])).alias("vec_id"), "embedding")
    return space.dbscan(rows, "vec_id", "embedding", 0.3, block=64)


def q_dbscan_members(spark, sf_dir):
    labels = space.dbscan(t(spark, sf_dir, "embeddings"), "vec_id", "embedding", EPS).where("cluster >= 0")
    return labels.groupBy("cluster").agg(F.count("*").alias("n"), F.max("vec_id").alias("last"))


def q_dbscan_dense(spark, sf_dir):
    """Cores have five vectors within eps; border vectors go to the nearest core."""
    return space.dbscan(t(spark, sf_dir, "embeddings"), "vec_id", "embedding", EPS, 5)


def _links(spark, sf_dir):
    """Candidates with their parent's vector, an anchor and the parent's text."""
    links, basis = _vectors(spark, sf_dir)
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"), F.col("text").alias("parent_text"))
    parents = basis.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("parent")).join(docs, "node_id")
    topics = t(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("anchor"))
    n = topics.agg(F.count("*").alias("n"))
    return links.withColumn("node_id", F.floor(F.col("vec_id") / QUERY) % PARENTS).join(parents, "node_id").join(F.broadcast(n)).join(topics, F.expr("vec_id % n = item_id")).select("vec_id", "node_id", "label", "embedding", "parent", "anchor", "parent_text")


def _features(spark, sf_dir):
    _, basis = _vectors(spark, sf_dir)
    centers = written(space.centroids(basis, "label", "embedding"))
    links = _links(spark, sf_dir)
    feats = space.link_features(links, basis.withColumnRenamed("vec_id", "space_key"), centers, "vec_id", "embedding", "parent", RADIUS)
    return feats.join(links.select("vec_id", "node_id", "label"), "vec_id")


def _feature(name):
    return lambda spark, sf_dir: _features(spark, sf_dir).select("vec_id", r6(F.col(name)).alias("value"))


q_coverage_gap, q_semantic_delta, q_contextual_consistency = map(_feature, ("coverage_gap", "semantic_delta", "contextual_consistency"))


def q_composite_score(spark, sf_dir):
    return _features(spark, sf_dir).select("vec_id", r6(F.col("nlp_score")).alias("nlp_score"))


def _bucketed(spark, sf_dir):
    return _stats(spark, sf_dir).select("vec_id", _node().alias("node_id"), r6(space.target_similarity()).alias("nlp_score")).withColumn("bucket", cascade.bucket(F.col("nlp_score"), LOW, HIGH))


def q_bucket(spark, sf_dir):
    return _bucketed(spark, sf_dir)


def q_bucket_budgets(spark, sf_dir):
    return cascade.budgets(_bucketed(spark, sf_dir), "node_id", **SHARES)


def q_cascade_decisions(spark, sf_dir):
    return cascade.decisions(_bucketed(spark, sf_dir), "node_id", "vec_id", "seed", **SHARES)


def _priority(name):
    def run(spark, sf_dir):
        quality = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), (F.col("quality") * 100).alias("score"))
        df = _features(spark, sf_dir).join(quality, "vec_id", "left")
        return df.select("vec_id", scores.priority(name, F.col("score"), F.col("label")).alias("priority"))

    return run


q_priority_aggressive, q_priority_balanced, q_priority_exploration = map(_priority, ("aggressive", "balanced", "exploration"))


def q_priority_custom(spark, sf_dir):
    scores.register_strategy("depth_first", lambda score, depth, nlp, llm: F.round(nlp * depth + llm * scores.model_share(score), 6))
    quality = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), (F.col("quality") * 100).alias("score"))
    df = t(spark, sf_dir, "embeddings").join(quality, "vec_id", "left")
    return df.select("vec_id", scores.priority("depth_first", F.col("score"), F.col("label")).alias("priority"))


def q_frontier_order(spark, sf_dir):
    nodes = _bucketed(spark, sf_dir).select(F.col("vec_id").alias("node_id"), F.col("nlp_score").alias("priority"))
    return graph.frontier(nodes, 50)


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
_SIMS = f"""WITH RECURSIVE cand AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings WHERE vec_id % {QUERY} = 0), basis AS (SELECT vec_id AS bid, label, embedding::DOUBLE[] e FROM embeddings),
  sims AS (SELECT c.vec_id, b.bid, list_cosine_similarity(c.e, b.e) AS s FROM cand c, basis b),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, bid) AS rank FROM sims)"""
_FEATS = f""", cen AS (SELECT label, list(x ORDER BY dim) AS e FROM (SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(range(len(e))) AS dim, unnest(e) AS x FROM basis) GROUP BY label, dim) GROUP BY label),
  far AS (SELECT c.vec_id, min(1 - list_cosine_similarity(c.e, k.e)) AS cluster_distance FROM cand c, cen k GROUP BY c.vec_id),
  near AS (SELECT vec_id, coalesce(avg(s) FILTER (WHERE rank <= 2 AND s >= 0), 0) AS target_similarity, avg(CASE WHEN 1 - s <= {RADIUS} THEN 1.0::DOUBLE ELSE 0 END) AS region_density, 1 - avg(s) FILTER (WHERE rank <= 5) AS novelty_injection FROM ranked GROUP BY vec_id),
  own AS (SELECT c.vec_id, c.label, list_cosine_similarity(c.e, b.e) AS s, list_distinct(regexp_extract_all(lower(t.text), '[\\p{{L}}\\p{{N}}_]+')) AS x, list_distinct(regexp_extract_all(lower(d.text), '[\\p{{L}}\\p{{N}}_]+')) AS y
          FROM cand c JOIN basis b ON b.bid = c.vec_id // {QUERY} % {PARENTS} JOIN documents d ON d.doc_id = b.bid JOIN benchmark t ON t.item_id = c.vec_id % (SELECT count(*) FROM benchmark)),
  f AS (SELECT *, target_similarity * (1 - region_density) AS coverage_gap, 1 - s AS semantic_delta, greatest(0, s) AS contextual_consistency,
          CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) END AS lexical_overlap FROM near JOIN far USING (vec_id) JOIN own USING (vec_id))"""
_B = f", b AS (SELECT vec_id, vec_id // {QUERY} % {NODES} AS node_id, round(target_similarity, 6) AS nlp_score, CASE WHEN round(target_similarity, 6) < {LOW} THEN 'low' WHEN round(target_similarity, 6) > {HIGH} THEN 'high' ELSE 'mid' END AS bucket FROM (SELECT vec_id, coalesce(avg(s) FILTER (WHERE rank <= 2 AND s >= 0), 0) AS target_similarity FROM ranked GROUP BY vec_id))"
_BUD = f", n AS (SELECT node_id, count(*) FILTER (WHERE bucket = 'low') AS n_low, count(*) FILTER (WHERE bucket = 'mid') AS n_mid, count(*) FILTER (WHERE bucket = 'high') AS n_high FROM b GROUP BY node_id), m AS (SELECT *, floor(n_low * {SHARES['low_share']}::DOUBLE)::BIGINT AS low_budget, floor(n_high * {SHARES['high_share']}::DOUBLE)::BIGINT AS hb FROM n), bud AS (SELECT node_id, n_low, n_mid, n_high, low_budget, floor(hb * {SHARES['random_share']}::DOUBLE)::BIGINT AS random_budget, hb - floor(hb * {SHARES['random_share']}::DOUBLE)::BIGINT AS top_budget FROM m)"


def _pri_sql(weights, depth):
    inner = " + ".join(f"{w}::DOUBLE * {k}" for k, w in weights.items())
    return f"{_SIMS}{_FEATS} SELECT f.vec_id, round(greatest(0, CASE WHEN coalesce(l.quality, 0) <> 0 THEN 60 ELSE 1 END * ({inner} - {depth}::DOUBLE * f.label) + CASE WHEN coalesce(l.quality, 0) <> 0 THEN 40 ELSE 0 END * coalesce(l.quality, 0)::DOUBLE), 6) AS priority FROM f LEFT JOIN labels l ON l.doc_id = f.vec_id"


_DB = f""", allv AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings), edge AS (SELECT a.vec_id AS a, b.vec_id AS b FROM allv a, allv b WHERE a.vec_id <> b.vec_id AND 1 - list_cosine_similarity(a.e, b.e) <= {EPS}),
  reach AS (SELECT a AS node, a AS root FROM edge UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.node), lab AS (SELECT node, min(root) AS cluster FROM reach GROUP BY node)"""
ORACLE_SQL = {
    "knn": f"{_SIMS} SELECT vec_id, rank, bid AS basis_id, round(s, 6) AS similarity FROM ranked WHERE rank <= 5 AND s >= {NEAR}",
    "target_similarity": f"{_SIMS} SELECT vec_id, round(coalesce(avg(s) FILTER (WHERE rank <= 2 AND s >= 0), 0), 6) AS value FROM ranked GROUP BY vec_id",
    "mean_similarity": f"{_SIMS} SELECT vec_id, round(avg(s), 6) AS value FROM ranked GROUP BY vec_id",
    "region_density": f"{_SIMS} SELECT vec_id, round(avg(CASE WHEN 1 - s <= {RADIUS} THEN 1.0::DOUBLE ELSE 0 END), 6) AS value FROM ranked GROUP BY vec_id",
    "novelty_injection": f"{_SIMS} SELECT vec_id, round(1 - avg(s) FILTER (WHERE rank <= 5), 6) AS value FROM ranked GROUP BY vec_id",
    "space_novelty": f"{_SIMS} SELECT vec_id, round(CASE WHEN max(s) >= 0 THEN 1 - max(s) ELSE 1 END, 6) AS value FROM ranked GROUP BY vec_id",
    "space_density": f"{_SIMS} SELECT vec_id, round(avg(CASE WHEN 1 - s <= {RADIUS} THEN 1.0::DOUBLE ELSE 0 END), 6) AS density, round(1 - avg(CASE WHEN 1 - s <= {RADIUS} THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage_gap FROM ranked GROUP BY vec_id",
    "coverage_gap": f"{_SIMS}{_FEATS} SELECT vec_id, round(coverage_gap, 6) AS value FROM f",
    "centroids": "SELECT label::BIGINT AS label, dim, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY label, dim",
    "sql_centroids": "SELECT label::BIGINT AS label, dim, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY label, dim",
    "cluster_distance": f"{_SIMS}{_FEATS} SELECT vec_id, round(cluster_distance, 6) AS value FROM far",
    "dbscan": f"{_SIMS}{_DB} SELECT vec_id, coalesce(cluster, -1)::BIGINT AS cluster FROM allv LEFT JOIN lab ON node = vec_id",
    "dbscan_dense": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings), pair AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a, v b WHERE 1 - list_cosine_similarity(a.e, b.e) <= {EPS}),
      core AS (SELECT a AS k FROM pair GROUP BY a HAVING count(*) >= 5), edge AS (SELECT a, b FROM pair WHERE a IN (FROM core) AND b IN (FROM core)),
      reach AS (SELECT k AS node, k AS root FROM core UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.node), lab AS (SELECT node, min(root) AS cluster FROM reach GROUP BY node),
      border AS (SELECT a, arg_min(b, (-round(s, 12), b)) AS b FROM pair WHERE a NOT IN (FROM core) AND b IN (FROM core) GROUP BY a)
      SELECT v.vec_id, coalesce(l.cluster, m.cluster, -1)::BIGINT AS cluster FROM v LEFT JOIN lab l ON l.node = v.vec_id LEFT JOIN border ON border.a = v.vec_id LEFT JOIN lab m ON m.node = border.b""",
    "dbscan_shared": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings), edge AS (SELECT a.vec_id AS a, min(b.vec_id) AS b FROM v a, v b WHERE 1 - list_cosine_similarity(a.e, b.e) <= 0.3 GROUP BY 1)
      SELECT a * 3 + unnest([0, 1, 2]) AS vec_id, b * 3 AS cluster FROM edge""",
    "dbscan_members": f"{_SIMS}{_DB} SELECT cluster, count(*) AS n, max(node) AS last FROM lab GROUP BY cluster",
    "semantic_delta": f"{_SIMS}{_FEATS} SELECT vec_id, round(semantic_delta, 6) AS value FROM f",
    "contextual_consistency": f"{_SIMS}{_FEATS} SELECT vec_id, round(contextual_consistency, 6) AS value FROM f",
    "composite_score": f"{_SIMS}{_FEATS} SELECT vec_id, round(least(1, greatest(0, " + " + ".join(f"({w}::DOUBLE) * {k}" for k, w in scores.COMPOSITE.items()) + ")), 6) AS nlp_score FROM f",
    "bucket": f"{_SIMS}{_B} SELECT vec_id, node_id, nlp_score, bucket FROM b",
    "bucket_budgets": f"{_SIMS}{_B}{_BUD} SELECT * FROM bud",
    "cascade_decisions": f"""{_SIMS}{_B}{_BUD}, c AS (SELECT b.*, low_budget, random_budget, top_budget, row_number() OVER (PARTITION BY node_id, bucket ORDER BY md5('seed' || vec_id), vec_id) AS k FROM b JOIN bud USING (node_id)),
      p AS (SELECT *, bucket = 'high' AND k <= random_budget AS picked FROM c), s AS (SELECT *, row_number() OVER (PARTITION BY node_id, bucket, picked ORDER BY nlp_score DESC, vec_id) AS r FROM p)
      SELECT vec_id, node_id, nlp_score, bucket, CASE WHEN bucket = 'mid' THEN 'llm' WHEN bucket = 'low' THEN CASE WHEN k <= low_budget THEN 'llm' ELSE 'dropped' END WHEN picked OR r <= top_budget THEN 'llm' ELSE 'trusted' END AS decision FROM s""",
    "priority_aggressive": _pri_sql(scores.AGGRESSIVE, 0.08),
    "priority_balanced": _pri_sql(scores.BALANCED, 0.05),
    "priority_exploration": _pri_sql(scores.EXPLORATION, 0.03),
    "priority_custom": "SELECT vec_id, CASE WHEN coalesce(quality, 0) <> 0 THEN 60.0::DOUBLE * label + 40.0::DOUBLE ELSE label::DOUBLE END AS priority FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id",
    "frontier_order": f"{_SIMS}{_B} SELECT vec_id AS node_id, nlp_score AS priority FROM b ORDER BY nlp_score, vec_id LIMIT 50",
}
