"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has eight bytes; three differing bits touch three of them at most, so two linked
fingerprints share five positional bytes at least. Postings of single positional bytes would hold 1/256 of
all rows each, so the index has postings for sets of four positions: 28 sets in which any five positions
hold exactly two, and any four at most one. Each posting in which a pair meets is tallied; pairs that share
five positional bytes or more are those tallied at least twice, the guaranteed minimum. They are kept and
verified by their differing bits. A posting of more than HEAVY fingerprints isn't paired: each of its
members offers itself to all points within two bits, and what meets at a point that one member reaches
within one bit is linked in a star; that keeps every link and grows with the posting's size.

Copies share one fingerprint and enter once. Null and empty texts have fingerprint zero and are linked
like others. Rows with equal doc_id are rows of their own, in keep_first() too; further columns are ignored
by near_duplicates() and kept by keep_first(). A text's shingles are hashed STRETCH at a time.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_rows, discard, fresh, materialise, numbered, split_words
from loomwork.operators.graph import components

SEED = 42
WORDS = 3
BITS = 3
SHARED = 8 - BITS
#: In how many postings a pair meets that shares SHARED positional bytes.
MEETINGS = 2
HEAVY = 300
STRETCH = 1 << 16


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


#: The 14 sets of four positions whose numbers xor to zero: any three positions are in one of them, any five hold one.
PLANES = [s for s in itertools.combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]


def _other_planes() -> list[tuple[int, ...]]:
    """The first renumbering of PLANES that has none of them."""
    for order in itertools.permutations(range(8)):
        turned = sorted(tuple(sorted(order[p] for p in s)) for s in PLANES)
        if not set(turned) & set(PLANES):
            return turned
    raise AssertionError


SETS = [*PLANES, *_other_planes()]
MASKS = [_signed(sum(255 << (8 * p) for p in s)) for s in SETS]


def fingerprint(text: str | None) -> int:
    """64 bits, as a signed number; shingles of three words with repeats, lower-cased A-Z."""
    words = split_words((text or "").encode().lower())
    if not words:
        return 0
    of, joined, n = xxhash.xxh64_intdigest, b" ".join(words), max(1, len(words) - WORDS + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n]
    stops = ends[min(WORDS, len(words)) - 1 :] - 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, STRETCH):
        h = np.array([of(joined[a:b], SEED) for a, b in zip(starts[at : at + STRETCH].tolist(), stops[at : at + STRETCH].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys, which are long, and fp."""
    schema = pa.schema([(k, pa.int64()) for k in (*keys, "fp")])

    def of(batch: pa.RecordBatch) -> dict:
        return {k: batch.column(k) for k in keys} | {"fp": [fingerprint(t) for t in batch.column("text").to_pylist()]}

    return rows.select(*keys, "text").mapInArrow(arrow_rows(schema, of), ", ".join(f"{k} long" for k in (*keys, "fp")))


def links(fps: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp: all links but for heavy postings, which get stars."""
    index = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("s"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(MASKS)])).alias("e")).select("fp", "e.s", "e.key")
    large = materialise(index.groupBy("s", "key").count().where(F.col("count") > heavy).select("s", "key"))
    dense = not large.isEmpty()
    paired = index.join(large, ["s", "key"], "left_anti") if dense else index
    left, right = paired.select("s", "key", F.col("fp").alias("a")), paired.select("s", "key", F.col("fp").alias("b"))
    # Spark takes an exploded index for a small table, and would send 28 rows for each fingerprint through the driver.
    tallied = left.hint("merge").join(right.hint("merge"), ["s", "key"]).where(F.col("a") < F.col("b")).groupBy("a", "b").count()
    edges = tallied.where(F.col("count") >= MEETINGS).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")
    if dense:
        free = [[b for b in range(64) if not (m >> b) & 1] for m in MASKS]
        deltas = [(k, _signed(sum(1 << b for b in bits)), n) for k, at in enumerate(free) for n in range(3) for bits in itertools.combinations(at, n)]
        ball = fps.sparkSession.createDataFrame(deltas, "s int, delta long, steps int")
        points = index.join(large, ["s", "key"], "left_semi").join(F.broadcast(ball), "s").select("s", F.col("fp").bitwiseXOR(F.col("delta")).alias("point"), "fp", "steps")
        hubs = points.groupBy("s", "point").agg(F.min(F.when(F.col("steps") <= 1, F.col("fp"))).alias("hub"), F.count("*").alias("n")).where("hub is not null and n > 1")
        edges = edges.union(points.hint("merge").join(hubs.hint("merge"), ["s", "point"]).where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")))
    return edges


def near_duplicates(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest doc_id that can be reached."""
    marked = materialise(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id"))
    firsts = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(firsts.select("fp"), heavy))
    linked = labels.join(firsts, F.col("node") == F.col("fp"))
    smallest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    moved = labels.join(smallest, "label").select(F.col("node").alias("fp"), "component_id")
    # Written, so that the last join is one of two plain shuffles and a hot fingerprint's task can be split.
    classes = materialise(firsts.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    discard(firsts, labels)
    out = marked.join(classes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """docs with one row of each class: the one with the smallest doc_id, rows without doc_id last, and the first of equal ones."""
    row = fresh("row", docs)
    rows = numbered(docs, row)
    marked = materialise(fingerprints(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(row).alias("row")), "doc_id", "row"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    firsts = materialise(marked.groupBy("fp").agg(F.min(order).alias("first")))
    labels = components(links(firsts.select("fp"), heavy))
    classes = firsts.join(labels, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("label", "fp").alias("class")).agg(F.min("first").alias("first"))
    kept = materialise(classes.select(F.col("first.row").alias(row)))
    discard(marked, firsts, labels)
    # By a shuffle at every size: whether the kept numbers are sent to all tasks would depend on how many there are.
    return rows.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)
