"""Spelling variants: a bit-sliced position index over the vocabulary finds words one edit apart.

For every position and letter the index holds a bitset over the words of a group. A query walks over its letters
once and keeps three bitsets at the same time: words without an error so far, words with one replaced letter, and
words with one letter more, whose letters are looked up one position further on. Each step treats all words of the
group by a few operations on whole bitsets.

Two words one edit apart agree before and after the edit. A group holds words of m and m + 1 letters with equal
letters before position ``lo`` and after ``hi`` (counted in the shorter word); a word is in the groups of two windows
for m and for m + 1 as its role may be. A pair belongs to the window that holds the first place where it differs, so it
is counted once. A group of more than GROUP words is cut into the two halves of its window, again and again: a window
of one letter holds a bounded number of words. So no task gathers more than that, and no pair is left out.

A null text has no words; a null doc_id counts as the text ``None`` in the checksum. Rows with equal doc_id are
documents of their own, further columns are ignored, ties are settled by code-point order, an empty table has no words.
"""

from __future__ import annotations

import collections
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import discard, materialise, slices

MIN_CHARS = 6
MIN_COUNT = 5
#: A form is at least so many times as frequent as its variant.
RATIO = 5
#: One in so many pairs of document and run loses a letter.
SLIP = 199
GROUP = 1 << 15
HELD = 200_000
KEY = ["m", "lo", "hi", "pre", "suf"]


def slipped(doc_id, run: str) -> str:
    """The run, without one letter if the checksum of document and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: what the runs of letters of whole texts give, by frequency. Tasks send counts, not occurrences."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_chars},}}")
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        found: collections.Counter = collections.Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], schema=schema)
            found.clear()
            return rows

        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if not text:
                        continue
                    # bytes.lower() changes A to Z only
                    for run, k in collections.Counter(runs.findall(text.encode().lower().decode())).items():
                        word = slipped(doc_id, run)
                        if len(word) >= min_chars:
                            found[word] += k
                if len(found) > HELD:
                    yield out()
        if found:
            yield out()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"pre": F.left("word", F.col("lo")), "suf": F.right("word", F.col("m") - F.col("hi"))})


def _windows(lo, mid, hi):
    return F.explode(F.filter(F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi"))), lambda w: w["lo"] < w["hi"]))


def groups(vocab: DataFrame, min_chars: int = MIN_CHARS, limit: int = GROUP) -> DataFrame:
    """word, n and the key of each group that the word is in; no group can be cut that has more than ``limit`` words."""
    size, zero = F.char_length("word"), F.lit(0)
    roles = vocab.select("word", "n", F.explode(F.filter(F.array(size, size - 1), lambda m: m >= max(1, min_chars))).alias("m"))
    rows = _keyed(roles.select("*", _windows(zero, F.floor(F.col("m") / 2).cast("int"), F.col("m")).alias("w")).select("word", "n", "m", "w.lo", "w.hi"))
    done = None
    while True:
        large = materialise(rows.where("hi - lo > 1").groupBy(*KEY).count().where(F.col("count") > limit).select(*KEY))
        if large.isEmpty():
            discard(large)
            return rows if done is None else done.unionByName(rows)
        kept = rows.join(large, KEY, "left_anti").select("word", "n", *KEY)
        done = kept if done is None else done.unionByName(kept)
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        rows = _keyed(rows.join(large, KEY, "left_semi").select("word", "n", "m", _windows(F.col("lo"), mid, F.col("hi")).alias("w")).select("word", "n", "m", "w.lo", "w.hi"))


def near_in_group(words: list[str], m: int, lo: int, hi: int):
    """Pairs of places (shorter or equal, other) of words one edit apart whose first difference is in the window."""
    index: list[dict[str, int]] = [{} for _ in range(hi + 1)]
    short = 0
    for k, w in enumerate(words):
        bit = 1 << k
        if len(w) == m:
            short |= bit
        for p in range(lo, min(hi + 1, len(w))):
            index[p][w[p]] = index[p].get(w[p], 0) | bit
    every = (1 << len(words)) - 1
    longer = every & ~short
    for k, u in enumerate(words):
        if len(u) != m:
            continue
        same, replaced, inserted = every, 0, 0
        for p in range(lo, hi):
            here, next_ = index[p].get(u[p], 0), index[p + 1].get(u[p], 0)
            inserted = (inserted | same) & next_
            replaced = (replaced & here) | (same & ~here)
            same &= here
        hits = (replaced & short & ~((1 << (k + 1)) - 1)) | ((inserted | same) & longer)
        while hits:
            low = hits & -hits
            hits ^= low
            j = low.bit_length() - 1
            v = words[j]
            first = next((p for p in range(lo, m) if u[p] != v[p]), m)
            if first < hi or hi == m:
                yield k, j


def _tallied(words: list[str], ns: list[int], key: tuple) -> list[tuple[str, int, int, str]]:
    """word, number of near words, and the most frequent of them with its n."""
    count: dict[int, int] = collections.defaultdict(int)
    best: dict[int, tuple[int, str]] = {}
    for pair in near_in_group(words, *key[:3]):
        for a, b in (pair, pair[::-1]):
            count[a] += 1
            offer = (-ns[b], words[b])
            if a not in best or offer < best[a]:
                best[a] = offer
    return [(words[a], c, -best[a][0], best[a][1]) for a, c in count.items()]


def near(rows: DataFrame) -> DataFrame:
    """word, n_near, best (struct of -n and word) of words that have a near word; rows as groups() gives them."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best_word", pa.string())])

    def run(batches):
        key, words, ns, out = None, [], [], []

        def flush():
            nonlocal out
            cols, out = list(zip(*out, strict=True)), []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("word", "n", *KEY)]
            for word, n, *own in zip(*cols, strict=True):
                if own != key:
                    if len(words) > 1:
                        out += _tallied(words, ns, key)
                        if len(out) > 10_000:
                            yield flush()
                    key, words, ns = own, [], []
                words.append(word)
                ns.append(n)
        if len(words) > 1:
            out += _tallied(words, ns, key)
        if out:
            yield flush()

    by_group = rows.repartition(*KEY).sortWithinPartitions(*KEY, "word")
    found = by_group.mapInArrow(run, "word string, n_near long, best_n long, best_word string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best_word").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) -> word, root. A form is several times as frequent as its word, so paths are short and end."""
    now = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        now = step
        if now.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, limit: int = GROUP) -> DataFrame:
    """word, n, n_near, form, form_n, root."""
    vocab = materialise(vocabulary(docs, min_chars, min_count))
    found = near(groups(vocab, min_chars, limit))
    accepted = -F.col("best.minus") >= RATIO * F.col("n")
    judged = materialise(vocab.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(accepted, F.col("best.word")).alias("form"), F.when(accepted, -F.col("best.minus")).alias("form_n")))
    ends = roots(judged.where("form is not null"))
    discard(vocab)
    return judged.join(ends.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
