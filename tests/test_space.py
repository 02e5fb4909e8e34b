"""The vector space's index and clusters against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwork.operators import space


def clustered(rng, n, dim=8):
    """Vectors around six centres, equal ones, zeros, and rows without a whole vector."""
    centres = rng.normal(size=(6, dim))
    vectors = [(centres[k % 6] + rng.normal(size=dim) * (0.05 + 0.2 * (k % 3))).tolist() for k in range(n)]
    return vectors + [vectors[0]] * 3 + [[0.0] * dim] * 2 + [rng.normal(size=dim).tolist() for _ in range(20)]


def frame(spark, rng, vectors):
    keys = rng.permutation(1000)[: len(vectors)].tolist()
    odd = [(5000, None), (5001, [1.0, None] + [0.0] * 6), (5002, [float("nan")] + [0.0] * 7)]
    return keys, spark.createDataFrame([*zip(keys, vectors, strict=True), *odd], "k long, v array<double>")


def unit(vectors):
    m = np.array(vectors)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


@pytest.mark.parametrize(("pivots", "block"), [(4096, 4096), (5, 16), (1, 4096)])
def test_search_equals_brute_force(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(space, "BLOCK", block)
    monkeypatch.setattr(space, "SLOT", block)
    rng = np.random.default_rng(4)
    vectors = clustered(rng, 300)
    keys, df = frame(spark, rng, vectors)
    sims = unit(vectors) @ unit(vectors).T
    some = df.where("k % 3 = 0 or k >= 5000")
    got = {}
    for r in space.neighbours(some, df.withColumnRenamed("k", "other"), "k", "other", "v", 5, None, pivots).collect():
        got.setdefault(r.k, []).append((r["rank"], r.other, round(r.similarity, 9)))
    want = {}
    for k, row in zip(keys, sims, strict=True):
        if k % 3 == 0:
            order = sorted(range(len(keys)), key=lambda j: (-round(row[j], 12), keys[j]))[:5]
            want[k] = [(n + 1, keys[j], round(row[j], 9)) for n, j in enumerate(order)]
    assert {k: sorted(v) for k, v in got.items()} == want
    for radius in (0.1, 0.5, 1.2):
        stats = {r.k: (r.n, round(r.similarity_sum, 6), r.within, [round(x, 9) for x in r.top]) for r in space.space_stats(some, df.withColumnRenamed("k", "other"), "k", "other", "v", radius, pivots).collect()}
        assert stats == {k: (len(keys), round(sims[j].sum(), 6), int((1 - sims[j] <= radius).sum()), [x[2] for x in want[k]]) for j, k in enumerate(keys) if k in want}


def test_search_visits_few_cells(spark):
    """Where vectors lie in clusters, a candidate is compared with a part of the space, however it is cut into blocks."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    vectors = [(centres[k % 40] + rng.normal(size=16) * 0.05).tolist() for k in range(2000)]
    df = spark.createDataFrame(list(enumerate(vectors)), "k long, v array<double>")
    index = space.cells(df)
    held = (index.pivots, index.radius, index.sizes)
    m = unit(vectors)
    low, _ = space._bounds(m, *held)
    kth = np.sort(m @ m.T, axis=1)[:, -5]
    visited = ((low <= np.arccos(np.clip(kth, -1, 1))[:, None]) * index.sizes).sum(axis=1)
    assert visited.mean() < 0.2 * len(vectors)


def test_search_copies_a_candidate_to_few_bundles(spark, monkeypatch):
    """Where angles close nothing, a candidate is sent to bundles, not to each of the cells, and to none twice."""
    rng = np.random.default_rng(9)
    m = rng.normal(size=(2000, 32))
    df = spark.createDataFrame(list(enumerate(m.tolist())), "k long, v array<double>")
    sent = []
    monkeypatch.setattr(space, "_visit", lambda visits, *a, visit=space._visit: sent.append(visits.groupBy("k").count().toArrow()) or visit(visits, *a))
    got = {r.k: [b.key for b in r.best] for r in space.search(df.where("k % 20 = 0").select("k", "v"), space.cells(df)).collect()}
    sims = unit(m) @ unit(m).T
    assert got == {k: np.argsort(-sims[k])[:5].tolist() for k in range(0, 2000, 20)}
    assert sum(sum(t.column("count").to_pylist()) for t in sent) <= 100 * (2000 // 512 + 2)


def test_empty_spaces(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "k long, v array<double>")
    none = df.where("false").withColumnRenamed("k", "other")
    assert [(r.k, r.n, r.similarity_sum, r.within, r.top) for r in space.space_stats(df, none, "k", "other", "v", 0.3).collect()] == [(1, 0, 0.0, 0, [])]
    assert space.neighbours(df, none, "k", "other", "v").count() == 0
    assert space.neighbours(df.where("false"), df.withColumnRenamed("k", "other"), "k", "other", "v").count() == 0


def brute_dbscan(keys, vectors, eps, least):
    m = unit(vectors)
    sims = m @ m.T
    near = 1 - sims <= eps
    np.fill_diagonal(near, False)
    core = near.sum(axis=1) + 1 >= least
    label = {k: keys[k] for k in range(len(keys)) if core[k]}
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(near), strict=True):
            if core[a] and core[b] and label[b] < label[a]:
                label[a], changed = label[b], True
    out = {}
    for k in range(len(keys)):
        if core[k]:
            out[keys[k]] = label[k]
        else:
            found = sorted((-round(sims[k, j], 12), keys[j], label[j]) for j in range(len(keys)) if core[j] and near[k, j])
            out[keys[k]] = found[0][2] if found else -1
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_dbscan_equals_brute_force(spark, least):
    rng = np.random.default_rng(5)
    vectors = clustered(rng, 150)
    vectors += [vectors[7]] * 40  # a hot cell of equal vectors
    keys, df = frame(spark, rng, vectors)
    for eps in (0.02, 0.2):
        want = brute_dbscan(keys, vectors, eps, least) | dict.fromkeys((5000, 5001, 5002), -1)
        for block, pivots in ((4096, 256), (16, 4)):
            assert {r.k: r.cluster for r in space.dbscan(df, "k", "v", eps, least, block, pivots).collect()} == want
    assert space.dbscan(df.where("false"), "k", "v", 0.1, least).count() == 0


def test_dbscan_in_many_shares_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(space, "SHARE", (8, 16))
    monkeypatch.setattr(space, "TILE", (5, 7))
    rng = np.random.default_rng(6)
    vectors = clustered(rng, 90)
    keys, df = frame(spark, rng, vectors)
    for eps, least in ((0.02, 2), (0.2, 4)):
        want = brute_dbscan(keys, vectors, eps, least) | dict.fromkeys((5000, 5001, 5002), -1)
        assert {r.k: r.cluster for r in space.dbscan(df, "k", "v", eps, least, pivots=12).collect()} == want


def test_batches_are_cut_by_their_cells():
    """Many cells take a copy of a vector each: what a task holds doesn't grow with their number."""
    rng = np.random.default_rng(1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(rng.normal(size=(10_000, 2)).tolist())], names=["k", "v"])
    for n in (1, 300, 100_000):
        parts = list(space._cut([batch], n))
        assert sum(p.num_rows for p in parts) == 10_000 and max(p.num_rows for p in parts) * n <= max(n, space.PAIRS)


def test_small_spaces_have_no_centroids(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [3.0]), (1, [5.0])], "label long, v array<double>")
    assert {r.label: r.centroid for r in space.centroids(df, "label", "v").collect()} == {0: [2.0], 1: [5.0]}
    assert space.centroids(df.limit(2), "label", "v").count() == 0
    assert space.centroids(df.where(F.lit(False)), "label", "v").count() == 0
