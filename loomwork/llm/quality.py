"""Quality rules: counts of each text, and a calibrated logistic regression on hashed word and character n-grams.

Null texts count as empty; an empty text has no words and fails the base rule. Rows with the same
doc_id are judged one by one. Further columns of the input are ignored. Without labelled rows of both
classes there is no model (an empty table has none either): the probability is null and only the base rule decides. Texts are hashed STRETCH
bytes at a time, so a text of many megabytes takes some ten times its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import logistic
from loomwork.llm.common import arrow_rows, discard, in_class_sample, materialise, mix64, slices, split_words

#: Buckets of each of the two blocks (words, characters) and how many labelled rows train the model at most (about).
DIMS = 1 << 14
TRAIN_ROWS = 2000
#: Bytes of features that reach the driver at most; longer texts make for fewer rows.
TRAIN_BYTES = 64 << 20
#: Bytes, or words, of a text that are hashed at a time.
STRETCH = 1 << 20
#: A document stays if its calibrated probability of good quality reaches this.
KEEP_AT = 0.5
#: Frequencies are multiplied by this so that weights stay near one.
SCALE = 50.0
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("quality_prob", pa.float64())])
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_prob double"


def word_ids(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    """Each word as a small number; equal words get the same one."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return ids, seen


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct > 1_000_000:  # keeps the key of three words below 2**63
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * distinct + ids[2:]
    _, at, count = np.unique(key, return_inverse=True, return_counts=True)
    again = count[at] >= 2
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def duplicate_lines(data: bytes) -> int:
    seen: set[bytes] = set()
    again = 0
    for line in data.split(b"\n"):
        if line.strip():
            again += line in seen
            seen.add(line)
    return again


def word_buckets(ids: np.ndarray, seen: dict[bytes, int]):
    """Hash buckets of word uni- and bigrams, in stretches."""
    if not len(ids):
        return
    shift = np.uint64(64 - DIMS.bit_length() + 1)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
    for at in range(0, len(ids), STRETCH):
        of = own[ids[at : at + STRETCH + 1]]
        yield (np.concatenate((of[:STRETCH], mix64(of[:-1] * np.uint64(3) + of[1:]))) >> shift).astype(np.int64)


def char_buckets(data: bytes):
    """Hash buckets of 3-, 4- and 5-grams of bytes, in stretches."""
    shift = np.uint64(64 - DIMS.bit_length() + 1)
    for at in range(0, len(data), STRETCH):
        h = raw = np.frombuffer(data, np.uint8, min(STRETCH + 4, len(data) - at), at).astype(np.uint64)
        chars = []
        for n in range(2, 6):
            h = h[: max(0, len(raw) - n + 1)] * np.uint64(0x100000001B3) + raw[n - 1 :]
            if n > 2:
                chars.append(mix64(h[:STRETCH] + np.uint64(n)) >> shift)
        yield np.concatenate(chars).astype(np.int64) + DIMS


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features: frequencies within each block."""
    at, value = [], []
    for block in (word_buckets(*word_ids(split_words(data))), char_buckets(data)):
        n = sum((np.bincount(b, minlength=2 * DIMS) for b in block), np.zeros(2 * DIMS, np.int64))
        some = np.flatnonzero(n)
        at.append(some)
        value.append(SCALE * n[some] / max(1, n.sum()))
    return np.concatenate(at), np.concatenate(value)


def margin_of(m: logistic.LogisticModel, data: bytes, ids: np.ndarray, seen: dict[bytes, int]) -> float:
    """The bias and the mean weights of both blocks."""
    out = m.bias
    for block in (word_buckets(ids, seen), char_buckets(data)):
        total, n = 0.0, 0
        for b in block:
            total, n = total + m.weights[b].sum(), n + len(b)
        out += SCALE * total / n if n else 0.0
    return out


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> logistic.LogisticModel | None:
    """Fit on about ``rows`` labelled documents, chosen by a hash; their features come to the driver.

    A document with several texts counts once for each different one. Of each class the texts with the smallest hashes
    are taken, ``rows`` of them at most, as far as half of TRAIN_BYTES holds their features, which are bounded for any text."""
    good = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("good", F.col("quality") > 0)
    counts = {r.good: r["count"] for r in good.groupBy("good").count().collect()}
    few = good.where(in_class_sample("doc_id", "good", counts, rows))
    text = F.coalesce("text", F.lit(""))
    sample = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("h")).join(F.broadcast(few.select("doc_id", "good")), "doc_id")
    keys = materialise(sample.select("good", "h").distinct())
    chosen = [(r.h,) for c in sorted(counts) for r in keys.where(F.col("good") == c).orderBy(F.xxhash64("h"), "h").limit(rows).collect()]
    discard(keys)
    schema = pa.schema([("good", pa.bool_()), ("h", pa.int64()), ("at", pa.binary()), ("value", pa.binary())])

    def of(batch: pa.RecordBatch) -> dict:
        found = [features(t.encode()) for t in batch.column("text").to_pylist()]
        return {"good": batch.column("good"), "h": batch.column("h"), "at": [a.astype(np.int32).tobytes() for a, _ in found], "value": [v.astype(np.float32).tobytes() for _, v in found]}

    def parts(batches):
        for batch in batches:
            yield from arrow_rows(schema, of)(slices(batch, 64))

    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "h long"))  # at most ``rows`` of each class
    once = sample.join(wanted, "h").groupBy("h").agg(F.max("good").alias("good"), F.max("text").alias("text"))
    found = materialise(once.select("good", "h", "text").mapInArrow(parts, "good boolean, h long, at binary, value binary"))
    left, picked = dict.fromkeys(counts, TRAIN_BYTES // 2), []
    for r in found.select("good", "h", (F.octet_length("at") + F.octet_length("value")).alias("size")).orderBy(F.xxhash64("h"), "h").collect():
        left[r.good] -= r.size
        if left[r.good] >= 0:
            picked.append((r.h,))
    got = found.join(F.broadcast(docs.sparkSession.createDataFrame(picked, "h long")), "h").collect()
    discard(found)
    got.sort(key=lambda r: r.h)
    got = [r for r in got if len(r.at)]
    return logistic.fit([(int(r.good), np.frombuffer(r.at, np.int32), np.frombuffer(r.value, np.float32)) for r in got], 2 * DIMS) if got else None


def _rows(batch: pa.RecordBatch, m: logistic.LogisticModel | None, keep_at: float) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in SCHEMA.names}
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
        text = text or ""
        data = text.encode()
        ids, seen = word_ids(split_words(data))
        n, again = len(ids), repeated_words(ids, len(seen))
        failed = n < MIN_WORDS or 100 * again > 50 * n
        p = None
        if m is not None:
            p = float(m.probability(margin_of(m, data, ids, seen)))
        for k, v in zip(SCHEMA.names, (doc_id, n, len(text) - sum(map(text.count, SPACES)), sum(map(data.count, SYMBOLS)), duplicate_lines(data), again, failed, not failed and (p is None or p >= keep_at), p), strict=True):
            out[k].append(v)
    return out


def judge(docs: DataFrame, model: logistic.LogisticModel | None, keep_at: float = KEEP_AT) -> DataFrame:
    """One row for each document: counts, the base rule's failure and the verdict."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield from arrow_rows(SCHEMA, lambda b: _rows(b, held.value, keep_at))(slices(batch, 1024))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DDL)


def keep(docs: DataFrame, model: logistic.LogisticModel | None, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps; without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1024):
                yield part.filter(pa.array(_rows(part, held.value, keep_at)["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
