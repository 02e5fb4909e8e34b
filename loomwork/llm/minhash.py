"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Only DataFrame functions are used. Each shingle of five words (a shorter text: all its words) is hashed once; the
hash's first bits choose one of BINS bins, and a bin keeps its smallest hash. An empty bin takes the value of the first
filled one in an order of bins of its own, which is fixed and the same for all texts (optimal densification). BITS
low-order bits of each bin are kept. Bins of unlike sets agree by chance once in 2^BITS, which likeness() takes off.

Words are runs of other than ASCII white space, as they stand. A text without words, null or empty, has the empty
fingerprint: it is like its equals (1) and unlike all others (0). Rows equal in doc_id and text are one document, whose
row comes as often as it does. The next document is the one with the next smaller doc_id, and after the last the first;
documents of one doc_id are in the order of their digests, those without doc_id come first. An empty table gives an
empty one; further columns are ignored. A text's hashes are held by the task that reads it: about 100 bytes a word.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import materialise
from loomwork.operators.graph import in_sequence

WORDS = 5
BINS = 128
BIN_BITS = 7
BITS = 8
#: Copies of a row that one array numbers.
COPIES = 4096


def probes() -> list[list[int]]:
    """For each bin an order of all bins, by a multiplicative hash of both numbers."""
    order = lambda i, j: ((i * BINS + j + 1) * 0x9E3779B97F4A7C15 % 2**64 >> 20) * 0xBF58476D1CE4E5B9 % 2**64
    return [sorted(range(BINS), key=lambda j: order(i, j)) for i in range(BINS)]


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column) -> Column:
    """Signed 64-bit hashes of the shingles of a text."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")

    def hashed(w: Column) -> Column:
        last = F.greatest(F.size(w) - WORDS, F.lit(0))
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
        return F.when(F.size(w) > 0, each).otherwise(F.array().cast("array<bigint>"))

    return _let(words, hashed)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def fingerprint(text: Column) -> Column:
    """BINS numbers of BITS bits, none for a text without words."""
    table = F.from_json(F.lit(json.dumps(probes())), "array<array<int>>")
    firsts = _let(F.sort_array(shingles(text)), lambda h: F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, i - 1)))))

    def dense(first: Column) -> Column:
        return _let(F.transform(first, _bin), lambda bins: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: value(first, bins, i)))

    def value(first: Column, bins: Column, i: Column) -> Column:
        own = F.array_position(bins, i)
        lent = F.array_position(bins, F.get(F.array_intersect(F.get(table, i), bins), F.lit(0)))
        at = F.when(own > 0, own).otherwise(lent).cast("int")
        return F.get(first, at - 1).bitwiseAND(F.lit(2**BITS - 1)).cast("int")

    return _let(firsts, lambda first: F.when(F.size(first) > 0, dense(first)).otherwise(F.array().cast("array<int>")))


def packed(bins: Column) -> Column:
    """The fingerprint as lower-case hex digits."""
    return F.lower(F.array_join(F.transform(bins, lambda v: F.lpad(F.hex(v), BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, from 0 to 1, without the matches of chance."""
    chance = 1 / 2**BITS
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    share = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / F.lit(1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), ((F.size(a) == 0) & (F.size(b) == 0)).cast("double")).otherwise(share)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document with its fingerprint, that of its edited text, and its likeness to the edited text and to the next document.

    Edited: the last half of the code points is replaced by the first as many of the next document. Texts are shuffled once, by the
    digest of doc_id and text; the order of documents comes from a table without texts, and only beginnings are sent on.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")))
    texts = base.groupBy("key").agg(F.max("text").alias("text"))
    small = base.select("key", "doc_id", F.char_length("text").cast("long").alias("n_chars")).groupBy("key", "doc_id", "n_chars").agg(F.count("*").alias("copies"))
    placed = materialise(in_sequence(small.withColumn("turned", F.bitwise_not("doc_id")), "place", "turned", "key"))
    total = placed.count()
    half = F.floor(F.col("n_chars") / 2).cast("int")
    follows = placed.select(F.pmod(F.col("place") - 1, F.lit(max(total, 1))).alias("place"), F.col("key").alias("next_key"))
    pairs = materialise(placed.join(follows, "place").select("key", "doc_id", "n_chars", "copies", half.alias("half"), "next_key"))
    heads = texts.join(pairs.select("next_key", F.col("key").alias("to"), "half"), F.col("key") == F.col("next_key")).select(F.col("to").alias("key"), F.left("text", F.col("half")).alias("head"))
    joined = texts.join(pairs, "key").join(heads, "key").withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - F.col("half")), "head"))
    bins = joined.select("key", "next_key", "doc_id", "n_chars", "copies", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text")).alias("bins"), fingerprint(F.col("edited")).alias("edited_bins"))
    marked = materialise(bins.withColumns({"bins": F.col("bins").cast("array<smallint>"), "edited_bins": F.col("edited_bins").cast("array<smallint>")}))
    next_ = marked.select(F.col("key").alias("next_key"), F.col("bins").alias("next_bins"))
    out = marked.join(next_, "next_key").select("doc_id", "n_chars", "edited_sha256", packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"), likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"), "copies")
    # Copies come in two steps, so that no array holds them all.
    split = out.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES}"))).alias("c"))
    each = split.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("c") * COPIES))))
    return each.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
