"""The vector space: an index of cells, neighbours, densities, centroids, clusters and link features.

A space is dealt to cells: each vector's home is the nearest of a bounded number of pivots, and a cell has a radius,
the largest angle between its pivot and a member. A vector at an angle t from a pivot is at least t less the radius
from all members of its cell. Cells are bundled, neighbours together. A search visits the bundle of the nearest cell and
then those with a cell that the best found so far don't close, so results are exact; a candidate is sent once to each bundle
that it visits, and a bundle's members once for every SLOT candidates that visit it. Pivots and one radius and size for
each are all that is broadcast.

Rows whose vector is null, has a null or a NaN among its numbers are left out; vectors must have one length. Vectors
of zeros have no direction: they have a cell that everybody visits, and visit all cells. Candidates' keys are unique.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.scores import composite, cosine, jaccard
from loomwork.operators.graph import components
from loomwork.plans.store import discard, written

#: Members and candidates that a task of a search compares, at most.
BLOCK, SLOT = 16_384, 8192
TOP = 5
#: Pivots of a space, at most; fewer in small ones.
PIVOTS = 4096
#: What angles are widened by, far more than their rounding.
SLACK = 1e-9
#: Pairs of a vector and a cell that a task holds at a time; a batch is cut by it, as each of the pairs takes a copy of the vector.
PAIRS = 1 << 16
#: Members of a bundle of cells that dbscan compares in one task, at least and at most, and into how many bundles a space is cut between.
SHARE, BUNDLES = (512, 16_384), 24
#: Rows and columns of the similarities that dbscan holds at a time, and similarities that a search does.
TILE, HELD = (1024, 4096), 1 << 20


def _unit(column) -> np.ndarray:
    """Rows of unit length out of an array column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _cut(batches, n: int):
    """The batches in parts of PAIRS // n rows, one at least."""
    for b in batches:
        for at in range(0, b.num_rows, step := max(1, PAIRS // max(n, 1))):
            yield b.slice(at, step)


def _angle(sims: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(sims, -1, 1))


def _vectors(df: DataFrame, key: str, value: str) -> DataFrame:
    """(k, v) of the rows that have a whole vector."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(value).cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))


@dataclass
class Cells:
    """A space in a written table (k, v, cell), and what is broadcast of it: pivots, radius and size of each cell."""

    placed: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    sizes: np.ndarray

    def total(self) -> np.ndarray:
        """The sum of all unit vectors."""

        def add(batches):
            total = None
            for b in batches:
                if b.num_rows:
                    part = _unit(b.column("v")).sum(axis=0)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["dim", "x"])

        sums = self.placed.select("v").mapInArrow(add, "dim long, x double").groupBy("dim").agg(F.sum("x").alias("x")).toArrow()  # a row for each dimension
        return sums.sort_by("dim").column("x").to_numpy()


def _placing(held):
    """Batches of (k, v) -> (k, v, cell, far): the home of each vector; the last cell is that of the zeros."""

    def run(batches):
        pivots = held.value
        for b in _cut(batches, len(pivots)):
            if b.num_rows:
                m = _unit(b.column("v"))
                angle = _angle(m @ pivots.T) if len(pivots) else np.zeros((len(m), 0))
                zero = ~m.any(axis=1)
                home = np.where(zero, len(pivots), angle.argmin(axis=1) if len(pivots) else 0)
                far = np.where(zero, np.pi, angle.min(axis=1) if len(pivots) else 0)
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("v"), pa.array(home.astype(np.int32)), pa.array(far)], names=["k", "v", "cell", "far"])

    return run


def cells(rows: DataFrame, pivots: int = PIVOTS) -> Cells:
    """The index of (k, v) rows. Pivots are the first by a hash of their key, about the root of the number of rows."""
    some = rows.where(F.exists("v", lambda x: x != 0))
    chosen = some.orderBy(F.xxhash64("k"), "k").limit(pivots).toArrow()
    n = len(chosen) if len(chosen) < pivots else some.count()
    unit = _unit(chosen.column("v").slice(0, int(np.ceil(np.sqrt(n))))) if n else np.zeros((0, 0))
    # Cells near the same of the first few pivots follow each other, so that bundles hold neighbours.
    unit = unit[np.argsort((unit @ unit[:BUNDLES].T).argmax(axis=1), kind="stable")] if n else unit
    held = rows.sparkSession.sparkContext.broadcast(unit)
    placed = written(rows.mapInArrow(_placing(held), "k long, v array<double>, cell int, far double"))
    radius, sizes = np.zeros(len(unit) + 1), np.zeros(len(unit) + 1, np.int64)
    for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row for each pivot at most
        radius[r.cell], sizes[r.cell] = r.far, r.n

    return Cells(placed, unit, radius, sizes)


def _bounds(unit: np.ndarray, pivots: np.ndarray, radius: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest angle to a member of each cell; empty cells are out of reach."""
    angle = _angle(unit @ pivots.T) if len(pivots) else np.zeros((len(unit), 0))
    low, high = np.zeros((len(unit), len(sizes))), np.full((len(unit), len(sizes)), np.pi)
    directed = unit.any(axis=1)
    low[:, :-1][directed] = np.maximum(0, angle[directed] - radius[:-1])
    high[:, :-1][directed] = angle[directed] + radius[:-1]
    low[:, sizes == 0] = 10.0
    return low, high


def _best(sims: np.ndarray, keys: np.ndarray, k: int) -> tuple[list, list]:
    """For each row the k largest, those with the smallest keys among equals: keys and values, best first."""
    rounded = np.round(sims, 12)
    if sims.shape[1] > k:
        least = -np.partition(-rounded, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero(rounded >= least)
    else:
        row, col = np.nonzero(np.ones(sims.shape, bool))
    order = np.lexsort((keys[col], -rounded[row, col], row))
    row, col = row[order], col[order]
    starts = np.searchsorted(row, np.arange(len(sims) + 1))
    cut = [slice(a, min(b, a + k)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    ids, values = keys[col], sims[row, col]
    return [ids[c] for c in cut], [values[c] for c in cut]


VISITED = "k long, within long, keys array<bigint>, sims array<double>"


def _visit(visits: DataFrame, members: DataFrame, sizes: np.ndarray, share: int, k: int, radius: float, few: bool) -> DataFrame:
    """visits(k, v, bundle), members(k, v, bundle) -> VISITED, a row for each visit of a part of a bundle; few: no bundle has more than SLOT visitors."""
    visits = visits if few else written(visits)
    spark = visits.sparkSession
    schema = pa.schema([("k", pa.int64()), ("within", pa.int64()), ("keys", pa.list_(pa.int64())), ("sims", pa.list_(pa.float64()))])
    sent = dict.fromkeys(np.flatnonzero(sizes).tolist(), 1) if few else {r.bundle: r["count"] for r in visits.groupBy("bundle").count().collect()}  # a row for each bundle
    shape = [(int(c), int(-(-sizes[c] // share)), int(-(-n // SLOT))) for c, n in sent.items()]
    parts = F.broadcast(spark.createDataFrame(shape, "bundle int, n_parts int, n_slots int"))
    slot = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(parts, "bundle").select("k", "v", "bundle", slot("n_slots").alias("slot"), every("n_parts").alias("part"))
    right = members.join(parts, "bundle").select("k", "v", "bundle", every("n_slots").alias("slot"), slot("n_parts").alias("part"))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        unit, keys, out = _unit(y.column("v")).T, y.column("k").to_numpy(), []
        step = max(1, HELD // y.num_rows)
        for at in range(0, x.num_rows, step):
            some = x.slice(at, step)
            sims = _unit(some.column("v")) @ unit
            ids, values = _best(sims, keys, k)
            out.append(pa.Table.from_arrays([some.column("k"), pa.array((1 - sims <= radius).sum(axis=1)), pa.array(ids, schema.field("keys").type), pa.array(values, schema.field("sims").type)], schema=schema))
        return pa.concat_tables(out)

    by = ["bundle", "part", "slot"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, VISITED)


def _merged(visited: DataFrame, k: int) -> DataFrame:
    """(k, within, best): visits of a candidate together; best has the k most similar as structs."""
    pairs = F.flatten(F.collect_list(F.arrays_zip("sims", "keys")))
    order = F.transform(F.sort_array(F.transform(pairs, lambda p: F.struct((-F.round(p["sims"], 12)).alias("minus"), p["keys"].alias("key"), p["sims"].alias("sim")))), lambda p: F.struct(p["key"].alias("key"), p["sim"].alias("sim")))
    sums = [F.sum("similarity_sum").alias("similarity_sum")] if "similarity_sum" in visited.columns else []
    return visited.groupBy("k").agg(F.sum("within").alias("within"), F.slice(order, 1, k).alias("best"), *sums)


def search(candidates: DataFrame, index: Cells, k: int = TOP, radius: float | None = None, summed: bool = False) -> DataFrame:
    """candidates(k, v) -> (k, within, best, similarity_sum): the k most similar members, best first, how many are no farther
    than radius, and, if ``summed``, the sum of all similarities, which is the product with the sum of the space's unit vectors.

    The bundle of the nearest cell gives each candidate the similarity of its k-th best; the second visit goes to all bundles
    with a cell whose bound is below that, or that the radius cuts. Of the others, cells wholly within the radius are counted
    by their size. The candidates are read three times, so they should be a table."""
    found_radius = -1.0 if radius is None else radius
    limit = None if radius is None else float(_angle(np.array(1 - radius)))
    share = max(1, min(BLOCK, max(SHARE[0], int(index.sizes.sum()) // BUNDLES)))
    starts = _bundles(index.sizes, share)
    of_cell = np.searchsorted(starts, np.arange(len(index.sizes)), side="right") - 1
    sizes_of = np.add.reduceat(index.sizes, starts)
    members = index.placed.select("k", "v", F.element_at(F.lit(of_cell.tolist()), F.col("cell") + 1).cast("int").alias("bundle"))
    held = candidates.sparkSession.sparkContext.broadcast((index.pivots, index.radius, index.sizes, index.total() if summed else np.zeros(0), starts, of_cell))
    few = candidates.count() <= SLOT

    def home(low, high):
        """The nearest cell of each candidate, by its farthest member; empty cells are no one's."""
        return np.where(low < 10, high, np.inf).argmin(axis=1)

    def first(batches):
        pivots, far, sizes, _, _, bundle = held.value
        for b in _cut(batches, len(sizes)):
            if b.num_rows and sizes.any():
                at = bundle[home(*_bounds(_unit(b.column("v")), pivots, far, sizes))]
                yield pa.RecordBatch.from_arrays([b.column("k"), b.column("v"), pa.array(at.astype(np.int32))], names=["k", "v", "bundle"])

    near = written(_merged(_visit(candidates.mapInArrow(first, "k long, v array<double>, bundle int"), members, sizes_of, share, k, found_radius, few), k))
    known = candidates.join(near.select(F.col("k").alias("of"), F.when(F.size("best") >= k, F.element_at("best", k)["sim"]).alias("kth")), F.col("k") == F.col("of"), "left").select("k", "v", "kth")

    def second(batches):
        pivots, far, sizes, total, firsts, bundle = held.value
        for b in _cut(batches, len(sizes)):
            if not b.num_rows:
                continue
            unit = _unit(b.column("v"))
            low, high = _bounds(unit, pivots, far, sizes)
            own, nearest = np.arange(len(unit)), bundle[home(low, high)]
            kth = b.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
            open_ = np.where(np.isnan(kth), np.pi, _angle(np.nan_to_num(kth)))[:, None]
            go = low <= open_ + SLACK
            inside = np.zeros(go.shape, bool)
            if limit is not None:
                inside = high <= limit - SLACK
                go |= (low <= limit + SLACK) & ~inside
            go = np.logical_or.reduceat(go & (sizes > 0), firsts, axis=1)
            go[own, nearest] = True
            whole = ((inside & ~go[:, bundle]) * sizes).sum(axis=1)
            go[own, nearest] = False
            at, to = np.nonzero(go)
            zeros = np.zeros(len(at))
            # One row without a bundle for each candidate: what it has without a visit.
            sums = unit @ total if len(total) else np.zeros(len(unit))
            at, to = np.concatenate((own, at)), np.concatenate((np.full(len(own), -1), to))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("k").take(take), b.column("v").take(take), pa.array(to.astype(np.int32)), pa.array(np.concatenate((whole, zeros.astype(np.int64)))), pa.array(np.concatenate((sums, zeros)))], names=["k", "v", "bundle", "whole", "total"])

    routed = written(known.mapInArrow(second, "k long, v array<double>, bundle int, whole long, total double"))
    lists = [F.array().cast("array<bigint>").alias("keys"), F.array().cast("array<double>").alias("sims")]
    counted = routed.where("bundle < 0").select("k", F.col("whole").alias("within"), *lists, F.col("total").alias("similarity_sum"))
    none = F.lit(0.0).alias("similarity_sum")
    before = near.select("k", "within", F.transform("best", lambda b: b["key"]).alias("keys"), F.transform("best", lambda b: b["sim"]).alias("sims"), none)
    return _merged(_visit(routed.where("bundle >= 0").select("k", "v", "bundle"), members, sizes_of, share, k, found_radius, few).select("*", none).union(before).union(counted), k)


def neighbours(candidates: DataFrame, space: DataFrame, key: str, space_key: str, value: str, k: int = TOP, threshold: float | None = 0.0, pivots: int = PIVOTS) -> DataFrame:
    """(key, rank, space_key, similarity): the k most similar space vectors of each candidate, ties by key."""
    found = search(_vectors(candidates, key, value), cells(_vectors(space, space_key, value), pivots), k)
    flat = found.select("k", F.posexplode("best").alias("pos", "b")).select(F.col("k").alias(key), (F.col("pos") + 1).cast("long").alias("rank"), F.col("b.key").alias(space_key), F.col("b.sim").alias("similarity"))
    return flat if threshold is None else flat.where(F.col("similarity") >= threshold)


def space_stats(candidates: DataFrame, space: DataFrame, key: str, space_key: str, value: str, radius: float, pivots: int = PIVOTS) -> DataFrame:
    """For each candidate: n, similarity_sum, within (vectors no farther than radius) and top (best similarities).

    The sum needs no pairs: it is the product with the sum of the space's unit vectors."""
    index = cells(_vectors(space, space_key, value), pivots)
    found = search(_vectors(candidates, key, value), index, TOP, radius, summed=True)
    n = F.lit(int(index.sizes.sum())).cast("long")
    return found.select(F.col("k").alias(key), n.alias("n"), "similarity_sum", "within", F.transform("best", lambda b: b["sim"]).alias("top"))


def _mean(values):
    return F.when(F.size(values) == 0, 0.0).otherwise(F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def target_similarity():
    """Mean of the two best similarities that aren't negative; 0 without one."""
    return _mean(F.slice(F.filter("top", lambda x: x >= 0), 1, 2))


def mean_similarity():
    return F.when(F.col("n") == 0, 0.0).otherwise(F.col("similarity_sum") / F.col("n"))


def region_density():
    return F.when(F.col("n") == 0, 0.0).otherwise(F.col("within") / F.col("n"))


def novelty_injection():
    return F.when(F.col("n") == 0, 1.0).otherwise(1 - _mean(F.col("top")))


def space_novelty():
    """One less the best similarity that isn't negative; 1 without one."""
    best = F.try_element_at("top", F.lit(1))
    return F.when(best >= 0, 1 - best).otherwise(1.0)


#: Fixed value: entries below which a space has no centroids.
LEAST_ENTRIES = 3


def centroids(members: DataFrame, label: str, value: str) -> DataFrame:
    """(label, centroid): element-wise means of clusters; noise (-1) has none, and a space of fewer than three entries has no centroids."""
    enough = members.limit(LEAST_ENTRIES).agg((F.count("*") >= LEAST_ENTRIES).alias("enough"))
    flat = members.where(F.col(label) >= 0).join(F.broadcast(enough)).where("enough").select(label, F.posexplode(value).alias("dim", "x"))
    means = flat.groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s.x).alias("centroid"))


def cluster_entries(vectors: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """Entries of the space that clusters(key, cluster) names, noise left out."""
    return vectors.join(clusters.where("cluster >= 0"), key)


def cluster_distance(candidates: DataFrame, centers: DataFrame, key: str, value: str) -> DataFrame:
    """(key, cluster_distance): the least cosine distance to a centroid; 1 without centroids."""
    named = centers.select(F.monotonically_increasing_id().alias("__c"), F.col("centroid").alias(value))
    stats = space_stats(candidates, named, key, "__c", value, 0.0)
    return stats.select(key, F.coalesce(1 - F.try_element_at("top", F.lit(1)), F.lit(1.0)).alias("cluster_distance"))


def _spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) edges of near[row, column], enough to join what it joins: one component after the other."""
    rows, cols = [], []
    left = np.ones(len(near), bool)
    for start in range(len(near)):
        if not left[start]:
            continue
        left[start] = False
        front, reached = np.array([start]), np.zeros(near.shape[1], bool)
        while len(front):
            hit = near[front] & ~reached
            new = np.flatnonzero(hit.any(axis=0))
            rows.append(front[hit[:, new].argmax(axis=0)])
            cols.append(new)
            reached[new] = True
            others = np.flatnonzero(left)
            joined = near[np.ix_(others, new)]
            more = joined.any(axis=1)
            front = others[more]
            rows.append(front)
            cols.append(new[joined[more].argmax(axis=1)] if len(front) else np.zeros(0, int))
            left[front] = False
    return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(cols or [np.zeros(0, int)])


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b) make a spanning forest, the first that join what wasn't joined."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    up, keep = list(range(len(nodes))), np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True)):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[x], keep[k] = y, True
    return keep


def _bundles(sizes: np.ndarray, share: int) -> np.ndarray:
    """The first cell of each bundle: cells that follow each other until they have ``share`` members."""
    starts, held = [0], 0
    for cell, n in enumerate(sizes.tolist()):
        if held and held + n > share:
            starts.append(cell)
            held = 0
        held += n
    return np.array(starts)


def dbscan(vectors: DataFrame, key: str, value: str, eps: float, min_samples: int = 2, block: int = BLOCK, pivots: int = 256) -> DataFrame:
    """(key, cluster): density clusters under cosine distance; a cluster is named by the smallest key of its cores, noise by -1.

    A core has min_samples vectors within eps, itself and its equals included. Cores within eps of each other are one
    cluster; a vector that is no core goes to its nearest core within eps, the smallest key of equally near ones, and
    without one it is noise, as are rows without a whole vector. Equal vectors enter once, with their number.

    Each vector has a home among the cells of ``pivots`` pivots. Cells are bundled, and a vector is copied to all bundles
    with a cell whose members it may reach, which loses no pair. A task compares a share of a bundle with a share of its
    copies, ``block`` rows at a time and no more than TILE, so its memory doesn't grow. A first pass counts neighbours, which two
    as a number of samples don't need; a second gives the edges of spanning forests of cores, not all pairs, and each
    other vector's nearest core of a share. Where angles close nothing, the pairs compared are quadratic."""
    rows = written(_vectors(vectors, key, value))
    # Vectors of zeros, which have no direction, are 1 apart from each other.
    lone = F.when(F.lit(eps < 1) & ~F.exists("v", lambda x: x != 0), F.col("k"))
    once = written(rows.groupBy("v", lone.alias("lone")).agg(F.min("k").alias("k"), F.count("*").alias("n")))
    index = cells(once.select("k", "v"), pivots)
    reach = float(_angle(np.array(1 - eps))) + SLACK
    share = max(SHARE[0], min(SHARE[1], int(index.sizes.sum()) // BUNDLES))
    starts = _bundles(index.sizes, share)
    members = np.add.reduceat(index.sizes, starts)
    bundle = F.element_at(F.lit((np.searchsorted(starts, np.arange(len(index.sizes)), side="right") - 1).tolist()), F.col("cell") + 1)
    held = vectors.sparkSession.sparkContext.broadcast((index.pivots, index.radius, index.sizes, starts))
    tile_x, tile_y = min(block, TILE[0]), TILE[1]

    def copies(batches):
        centres, radius, sizes, firsts = held.value
        for b in _cut(batches, len(sizes)):
            if b.num_rows:
                low, _ = _bounds(_unit(b.column("v")), centres, radius, sizes)
                # A pair is found in the later one of its two homes.
                home = b.column("cell").to_numpy()
                near = np.logical_or.reduceat(low <= reach, firsts, axis=1)
                at, cell = np.nonzero(near & (np.arange(len(firsts)) >= home[:, None]))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column("k").take(take), b.column("v").take(take), b.column("n").take(take), b.column("core").take(take), pa.array(home[at]), pa.array(cell.astype(np.int32))], names=["k", "v", "n", "core", "home", "cell"])

    def paired(flags: DataFrame, compare, ddl: str) -> DataFrame:
        """compare(home block, block of copies) over all cells; flags: k, v, n, core, cell."""
        copied = written(flags.mapInArrow(copies, "k long, v array<double>, n long, core boolean, home int, cell int"))
        counts = {r.cell: r["count"] for r in copied.groupBy("cell").count().collect()}  # a row for each pivot at most
        shape = [(int(c), max(1, int(-(-members[c] // share))), int(-(-n // share))) for c, n in counts.items()]
        parts = F.broadcast(flags.sparkSession.createDataFrame(shape, "cell int, n_a int, n_b int"))
        slot = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = flags.join(parts, "cell").select("k", "v", "n", "core", "cell", slot("n_a").alias("a"), every("n_b").alias("b"))
        right = copied.join(parts, "cell").select("k", "v", "n", "core", "home", "cell", every("n_a").alias("a"), slot("n_b").alias("b"))
        by = ["cell", "a", "b"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, ddl)

    def tiles(x: pa.Table, y: pa.Table):
        """Slices of both with the similarities of their rows."""
        right = [(slice(at, at + tile_y), _unit(y.column("v").slice(at, tile_y))) for at in range(0, y.num_rows, tile_y)]
        for at in range(0, x.num_rows, tile_x):
            left = _unit(x.column("v").slice(at, tile_x))
            for of_y, m in right:
                yield slice(at, at + tile_x), of_y, left @ m.T

    counted = pa.schema([("k", pa.int64()), ("n", pa.int64())])

    def count(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return counted.empty_table()
        a, b, n_a, n_b = (t.column(c).to_numpy() for c in ("k", "n") for t in (x, y))
        away = y.column("home").to_numpy() != y.column("cell").to_numpy()
        ahead, back = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for i, j, sims in tiles(x, y):
            near = 1 - sims <= eps
            if not away[j].all():
                near &= a[i, None] != b[j]
            ahead[i] += near @ n_b[j]
            back[j] += near.T @ n_a[i]
        return pa.Table.from_arrays([pa.array(np.concatenate((a, b[away]))), pa.array(np.concatenate((ahead, back[away])))], schema=counted)

    linked = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())])

    def link(x: pa.Table, y: pa.Table) -> pa.Table:
        """Core edges without a similarity; with one, a vector that is no core and its nearest core among those compared."""
        if not x.num_rows or not y.num_rows:
            return linked.empty_table()
        a, b = x.column("k").to_numpy(), y.column("k").to_numpy()
        core_a, core_b = (t.column("core").to_numpy().astype(bool) for t in (x, y))
        away = y.column("home").to_numpy() != y.column("cell").to_numpy()
        edges, offers = [np.zeros((2, 0), np.int64)], []
        for i, j, sims in tiles(x, y):
            near = 1 - sims <= eps
            if not away[j].all():
                near &= a[i, None] != b[j]
            cores = near & core_a[i, None] & core_b[j]
            rows_, cols_ = np.flatnonzero(cores.any(axis=1)), np.flatnonzero(cores.any(axis=0))
            one, two = _spanning(cores[np.ix_(rows_, cols_)])
            edges.append(np.stack((a[i][rows_[one]], b[j][cols_[two]])))
            for own, other, keys, others, grid, ok in ((~core_a[i], core_b[j], a[i], b[j], sims, near), (away[j] & ~core_b[j], core_a[i], b[j], a[i], sims.T, near.T)):
                if own.any() and other.any():
                    own = np.flatnonzero(own)[ok[own][:, other].any(axis=1)]
                    ids, best = _best(np.where(ok[own][:, other], grid[own][:, other], -2), others[other], 1)
                    if len(own):
                        offers.append((keys[own], np.concatenate(ids), np.concatenate(best)))
        one, two = np.concatenate(edges, axis=1)
        keep = _forest(one, two)
        out = [(one[keep], two[keep], np.full(keep.sum(), np.nan))]
        if offers:
            own, core, sim = map(np.concatenate, zip(*offers, strict=True))
            order = np.lexsort((core, -np.round(sim, 12), own))
            first = order[np.concatenate(([True], np.diff(own[order]) != 0))]
            out.append((own[first], core[first], sim[first]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.Table.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], from_pandas=True)], schema=linked)

    weight = once.select(F.col("k").alias("of"), "n")
    placed = written(index.placed.join(weight, F.col("k") == F.col("of")).select("k", "v", "n", F.lit(True).alias("core"), bundle.alias("cell")))
    if min_samples > 2:
        others = paired(placed, count, "k long, n long").groupBy(F.col("k").alias("of")).agg(F.sum("n").alias("others"))
        flags = placed.join(others, F.col("k") == F.col("of"), "left").withColumn("core", F.col("n") + F.coalesce("others", F.lit(0)) >= min_samples)
        flags = written(flags.select("k", "v", "n", "core", "cell"))
    else:
        flags = placed
    found = written(paired(flags, link, "a long, b long, sim double"))
    labels = components(found.where("sim is null").select("a", "b"))
    # A core without another is a cluster of its own; without a first pass only one that stands for enough equals is a core.
    alone = F.col("k") if min_samples > 2 else F.when(F.col("n") >= min_samples, F.col("k"))
    cores = flags.where("core").join(labels, F.col("k") == F.col("node"), "left").select("k", F.coalesce("label", alone).alias("cluster"))
    offers = found.where("sim is not null").groupBy("a").agg(F.min(F.struct((-F.round("sim", 12)).alias("minus"), F.col("b").alias("core"))).alias("best")).select("a", F.col("best.core").alias("to"))
    border = offers.join(cores, F.col("to") == F.col("k")).select(F.col("a"), "cluster")
    named = written(cores.where("cluster is not null").union(border))
    discard(found, placed, index.placed, labels, *([flags] if flags is not placed else []))
    of_equals = once.select("v", "lone", F.col("k").alias("first")).join(named, F.col("first") == F.col("k")).select(F.col("v").alias("w"), "lone", "cluster")
    whole = written(rows.join(of_equals, (F.col("v") == F.col("w")) & lone.eqNullSafe(F.col("lone"))).select(F.col("k").alias("__k"), "cluster"))
    discard(rows, once, named)
    return vectors.select(F.col(key).cast("long").alias(key)).join(whole, F.col(key) == F.col("__k"), "left").select(key, F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def link_features(links: DataFrame, space: DataFrame, centers: DataFrame, key: str, value: str, parent: str, radius: float) -> DataFrame:
    """The eight features of each link and their composite score.

    links: key, value (vector), parent (vector), anchor and parent_text. The link's own vector stands for
    its context's."""
    stats = space_stats(links, space, key, "space_key", value, radius)
    far = cluster_distance(links, centers, key, value)
    near = stats.select(key, target_similarity().alias("target_similarity"), region_density().alias("region_density"), novelty_injection().alias("novelty_injection")).join(far, key)
    similar = cosine(F.col(value), F.col(parent))
    own = links.select(key, (1 - similar).alias("semantic_delta"), F.coalesce(F.greatest(F.lit(0.0), similar), F.lit(0.0)).alias("contextual_consistency"), jaccard(F.col("anchor"), F.col("parent_text")).alias("lexical_overlap"))
    out = near.join(own, key).withColumn("coverage_gap", F.col("target_similarity") * (1 - F.col("region_density")))
    return out.withColumn("nlp_score", composite())
