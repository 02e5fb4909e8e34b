"""Cross-entropy difference between a target and a background model over one shared vocabulary.

The vocabulary holds all words of the corpus (lower-cased A-Z, cut at ASCII white space). Both are bigram
models with the same interpolation: the target is counted over all documents labelled as good, the background
over all others. A document is scored by what each model knows without it: its own counts are taken off
those of the model that holds it. Its score is the mean over its words of the target's loss less the
background's; low scores are close to the target.

Rows are dealt to blocks of about BLOCK_BYTES of text by a hash. A block sends each of its distinct words
and word pairs once, with its counts, to the bucket of their key; buckets add up and answer with the sums in
the same order; the block, dealt the same way, scores its rows. So the whole table of counts is spread over
tasks, grows with the corpus, and nothing of it reaches the driver. Words and pairs are known by their bucket
and 48 bits of a hash, so they get longer with the corpus. A message holds keys as differences in order, and
counts as one byte a key, with a list of those that don't fit.

Null and empty texts have no words: their losses are null. Rows with equal doc_id are scored one by one, and
rows of equal text are worked on once; a very long text takes memory for its distinct pairs, some nine times its bytes;
an empty table gives an empty one; further columns are ignored. Without target documents the target knows no words and gives each the same loss.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import materialise, mix64, split_words

#: Weight of the bigram against the word's own frequency; share and size of the probability of words not counted.
BIGRAM, UNSEEN, FLOOR = 0.7, 0.01, 1e-6
#: Text of one block. A task holds one block and about 30 times its bytes, or what a longer text's distinct pairs take.
BLOCK_BYTES = 8 << 20
#: Rows equal in doc_id and text share a block, where they are worked on once, up to so many bytes of text together.
REPEAT_BYTES = 64 << 20
#: What stands before a text's first word.
BEGIN = np.uint64(1)
#: Words that are hashed at a time, pairs that are merged at a time, and bytes of a long text that are cut off at a time.
STRETCH, MERGE, CUT = 1 << 20, 1 << 21, 4 << 20
SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
#: Words whose hashes a block remembers.
KNOWN = 500_000

#: Bits of a key within its bucket.
KEY_BITS = 48
#: Counts up to this go into half a byte.
SMALL = 15

#: A message: low and high are the keys' differences; counts hold n and n_target in halves of a byte, where neither is
#: over SMALL; others stand in at, n and n_target.
COUNTS_DDL = "bucket int, block int, low array<int>, high array<short>, counts binary, at array<int>, n array<int>, n_target array<int>"
COUNTS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int16())), ("counts", pa.binary()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("n_target", pa.list_(pa.int32()))])
#: An answer: sums as floats, exact up to 2^24.
SUMS_DDL = "block int, bucket int, n array<float>, n_target array<float>"
SUMS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("n", pa.list_(pa.float32())), ("n_target", pa.list_(pa.float32()))])
SCORES_DDL = "doc_id long, n_words long, target_loss double, background_loss double, loss_diff double"
SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("loss_diff", pa.float64())])


def words_of(text: str | None) -> list[bytes]:
    return split_words((text or "").encode().lower())


class Block:
    """Rows as their distinct word pairs: the word, what stands before it, and how often the row has the pair.

    All occurrences of a pair in a row have one loss, so nothing is kept for each of them. Texts are hashed STRETCH words at
    a time, and what they give is merged MERGE pairs at a time, so a very long text takes memory for its distinct pairs."""

    def __init__(self, table: pa.Table, buckets: int):
        marks = table.column("is_target").to_numpy(zero_copy_only=False)
        rows = table.filter(pa.array(~marks))
        target = set(table.filter(pa.array(marks)).column("doc_id").to_pylist())
        # Rows with one text are worked on once for each model; each row knows which, and each of those how many rows it is.
        firsts: dict[tuple[bytes, bool], int] = {}
        self.doc_ids, self.of, distinct = rows.column("doc_id").to_pylist(), [], []
        for k, d in enumerate(self.doc_ids):
            key = hashlib.blake2b(rows.column("text")[k].as_buffer() or b"", digest_size=16).digest(), d in target
            if key not in firsts:
                firsts[key] = len(distinct)
                distinct.append(k)
            self.of.append(firsts[key])
        self.target = np.array([t for _, t in firsts], bool)
        self.copies = np.bincount(np.array(self.of, np.int64), minlength=len(distinct))
        self.sizes = np.zeros(len(distinct), np.int64)
        self.row, word, before, pair, self.times = self._pairs(rows.column("text"), distinct)
        self.begins = before == BEGIN
        keys = np.concatenate((word, before, pair))
        n = len(word)
        del word, before, pair
        self.bucket, self.keys, at = dealt(keys, buckets)
        del keys
        self.word, self.before, self.pair = at[:n], at[n : 2 * n], at[2 * n :]
        # How often each row has each of its words; the begin of a text, which is no word of it, stands once.
        mark = self.row * np.int64(max(1, len(self.keys)))
        known, place = np.unique(mark + self.word, return_inverse=True)
        own = np.bincount(place, self.times, len(known)).astype(np.int64)
        self.own_word = own[place]
        where = np.minimum(np.searchsorted(known, mark + self.before), max(0, len(known) - 1))
        self.own_before = np.where(self.begins, 1, own[where]) if n else own

    def _pairs(self, texts, distinct: list[int]):
        """row, word, before, pair and times of the distinct pairs of each row; words and pairs are hashes."""
        known: dict[bytes, int] = {}
        done, open_ = [], 0
        parts: list[tuple[int, np.uint64, np.ndarray]] = []
        n_words = 0

        def close() -> None:
            nonlocal parts, n_words, done, open_
            if not parts:
                return
            row = np.repeat(np.array([r for r, _, _ in parts], np.int32), [len(h) for _, _, h in parts])
            word = np.concatenate([h for _, _, h in parts])
            before = np.empty_like(word)
            before[1:] = word[:-1]
            at = np.cumsum([0, *(len(h) for _, _, h in parts[:-1])])
            before[at] = [b for _, b, _ in parts]
            done.append(_merged(row, word, before, mix64(before * np.uint64(3) + word), np.ones(len(word), np.int64)))
            parts, n_words, open_ = [], 0, open_ + len(done[-1][0])
            if open_ > MERGE and len(done) > 1:
                done = [_merged(*(np.concatenate(c) for c in zip(*done, strict=True)))]
                open_ = -len(done[0][0])  # what is merged counts again when as much has been added

        for r, k in enumerate(distinct):
            last = BEGIN
            for words in _stretches(texts[k]):
                if len(known) > KNOWN:
                    known = {}
                for w in words:
                    if w not in known:
                        known[w] = xxhash.xxh3_64_intdigest(w)
                hashed = mix64(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                parts.append((r, last, hashed))
                last, n_words = hashed[-1], n_words + len(hashed)
                self.sizes[r] += len(hashed)
                if n_words > STRETCH:
                    close()
        close()
        if not done:
            none = np.zeros(0, np.uint64)
            return np.zeros(0, np.int32), none, none, none, np.zeros(0, np.int64)
        return done[0] if len(done) == 1 else _merged(*(np.concatenate(c) for c in zip(*done, strict=True)))

    def counts(self, of: np.ndarray) -> np.ndarray:
        """How often each key stands in the rows that of marks."""
        mine = of[self.row]
        times = self.times[mine] * self.copies[self.row[mine]]
        n = np.bincount(self.word[mine], times, len(self.keys)) + np.bincount(self.pair[mine], times, len(self.keys))
        begin = np.flatnonzero(mine & self.begins)
        return (n + np.bincount(self.before[begin], self.copies[self.row[begin]], len(self.keys))).astype(np.int32)

    def losses(self, n: np.ndarray, total: int, holds: np.ndarray) -> np.ndarray:
        """Each row's mean loss under the model with these sums; rows that it holds are left out of them."""
        mine = holds[self.row]
        word = n[self.word] - np.where(mine, self.own_word, 0)
        before = n[self.before] - np.where(mine, self.own_before, 0)
        pair = n[self.pair] - np.where(mine, self.times, 0)
        left = total - np.where(holds, self.sizes, 0)[self.row]
        alone = np.where(left > 0, (1 - UNSEEN) * word / np.maximum(left, 1), 0.0) + UNSEEN * FLOOR
        p = np.where(before > 0, BIGRAM * pair / np.maximum(before, 1) + (1 - BIGRAM) * alone, alone)
        return np.bincount(self.row, weights=-np.log(p) * self.times, minlength=len(self.sizes)) / np.maximum(self.sizes, 1)


def _stretches(text: pa.StringScalar):
    """Words of a text, in lists; a long text is cut at white space, and only what is cut off is copied."""
    data = memoryview(text.as_buffer() or b"")
    at = 0
    while at < len(data):
        end = SPACE.search(data, at + CUT)
        stop = end.start() if end else len(data)
        if words := split_words(bytes(data[at:stop]).lower()):
            yield words
        at = stop


def _merged(row, word, before, pair, times):
    """The distinct (row, pair), with their times added up."""
    _, place = np.unique(pair, return_inverse=True)
    _, first, at = np.unique(row * np.int64(len(pair)) + place, return_index=True, return_inverse=True)
    return row[first], word[first], before[first], pair[first], np.bincount(at, times, len(first)).astype(np.int64)


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, as buckets and KEY_BITS bits within them, and the place of each of keys among them.

    A bucket is a range of keys, so what its number says needn't be sent: beyond 2^16 buckets no bit of 64 is lost."""
    shift = max(0, 64 - KEY_BITS - (buckets.bit_length() - 1))
    some, at = np.unique(keys >> np.uint64(shift), return_inverse=True)
    many, half = np.uint64(buckets), np.uint64(32 - shift)
    bucket = (some >> half) * many >> np.uint64(32)
    start = ((bucket << np.uint64(32)) + many - np.uint64(1)) // many
    return bucket.astype(np.int32), some - (start << half), at.astype(np.int32)


def packed(keys: np.ndarray, n: np.ndarray, n_target: np.ndarray) -> dict:
    """One message; keys are of KEY_BITS bits, in order."""
    step = np.diff(keys, prepend=np.uint64(0))
    fits = (n <= SMALL) & (n_target <= SMALL)
    at = np.flatnonzero(~fits).astype(np.int32)
    counts = np.where(fits, n | n_target << 4, 0).astype(np.uint8)
    return {"low": step.astype(np.uint32).view(np.int32), "high": (step >> np.uint64(32)).astype(np.uint16).view(np.int16), "counts": counts.tobytes(), "at": at, "n": n[at], "n_target": n_target[at]}


def unpacked(message: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys, n and n_target."""
    keys = np.cumsum(message["low"].view(np.uint32).astype(np.uint64) | message["high"].view(np.uint16).astype(np.uint64) << np.uint64(32), dtype=np.uint64)
    counts = np.frombuffer(message["counts"], np.uint8).astype(np.int32)
    n, n_target = counts & SMALL, counts >> 4
    n[message["at"]], n_target[message["at"]] = message["n"], message["n_target"]
    return keys, n, n_target


def count_block(table: pa.Table, buckets: int) -> pa.Table:
    """What a block sends to each bucket: its distinct keys there, in order, and how often they stand in either model."""
    number = table.column("block")[0].as_py()
    block = Block(table, buckets)
    del table
    n, n_target = block.counts(~block.target), block.counts(block.target)
    some, first = np.unique(block.bucket, return_index=True)
    out = [{"bucket": b, "block": number} | packed(block.keys[lo:hi], n[lo:hi], n_target[lo:hi]) for b, lo, hi in zip(some.tolist(), first, [*first[1:], len(n)], strict=True)]
    return pa.Table.from_arrays([pa.array([m[f.name] for m in out], f.type) for f in COUNTS], schema=COUNTS)


def sum_bucket(table: pa.Table) -> pa.Table:
    """The answers to all blocks: the sums of their keys, in the order in which they came."""
    lists = [k for k, f in zip(COUNTS.names, COUNTS, strict=True) if pa.types.is_list(f.type)]
    messages = [unpacked({k: part.column(k)[i].values.to_numpy() for k in lists} | {"counts": part.column("counts")[i].as_py()}) for part in table.to_batches() for i in range(part.num_rows)]
    cuts = np.cumsum([0, *(len(m[0]) for m in messages)]).astype(np.int32)
    keys, at = np.unique(np.concatenate([m[0] for m in messages]), return_inverse=True)
    sums = [np.bincount(at, weights=np.concatenate([m[k] for m in messages]), minlength=len(keys)).astype(np.float32)[at] for k in (1, 2)]
    return pa.Table.from_arrays([table.column("block"), table.column("bucket"), *(pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in sums)], schema=SUMS)


def score_block(table: pa.Table, answers: pa.Table, buckets: int, total: int, total_target: int) -> pa.Table:
    """Scores of a block's rows; the answers' sums stand in the order of its keys."""
    block = Block(table, buckets)
    answers = answers.sort_by("bucket")
    n, n_target = (np.concatenate([np.zeros(0, np.float32), *(c.flatten().to_numpy() for c in answers.column(k).chunks)]).astype(float) for k in ("n", "n_target"))
    target, background = block.losses(n_target, total_target, block.target), block.losses(n, total, ~block.target)
    at = np.array(block.of, np.int64)
    sizes, target, background = block.sizes[at], target[at], background[at]
    return pa.Table.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(sizes), *(pa.array(x, mask=sizes == 0) for x in (target, background, target - background))], schema=SCORES)


def differences(docs: DataFrame, labels: DataFrame, block_bytes: int = BLOCK_BYTES, repeat_bytes: int = REPEAT_BYTES) -> DataFrame:
    """doc_id, n_words, mean losses under both models and their difference, one row for each row of docs."""
    n_words = F.coalesce(F.regexp_count("text", F.lit("[^ \\t\\n\\r\\x0B\\f]+")), F.lit(0)).cast("long")

    def sizes_of(rows: DataFrame) -> DataFrame:
        return materialise(rows.select("doc_id", "part", n_words.alias("n_words"), F.octet_length("text").cast("long").alias("n_bytes")))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("part", F.xxhash64("doc_id", "text"))
    sizes = sizes_of(rows)
    equal = sizes.groupBy("part").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n")).where("n > 1")
    if (equal.agg(F.max("n_bytes")).first()[0] or 0) > repeat_bytes:  # equal rows go to several blocks
        rows = materialise(rows.withColumn("part", F.xxhash64("part", F.monotonically_increasing_id())))
        sizes = sizes_of(rows)
    good = labels.where("quality > 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    target = sizes.join(good, "doc_id", "left_semi")
    n_bytes, n_all = sizes.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    total_target = target.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    total, blocks = n_all - total_target, max(1, -(-n_bytes // block_bytes))

    block = F.pmod("part", F.lit(blocks)).cast("int").alias("block")
    marks = target.select(block, "doc_id", F.lit("").alias("text"), F.lit(True).alias("is_target")).distinct()
    dealt = rows.select(block, "doc_id", "text", F.lit(False).alias("is_target")).unionByName(marks)
    counts = dealt.groupBy("block").applyInArrow(lambda t: count_block(t, blocks), COUNTS_DDL)
    sums = counts.groupBy("bucket").applyInArrow(sum_bucket, SUMS_DDL)
    return dealt.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(lambda t, a: score_block(t, a, blocks, total, total_target), SCORES_DDL)
