"""Benchmark decontamination: rare gapped pairs of words join passages to test items, Smith-Waterman scores them.

Words are runs of letters and digits, lower-cased A-Z. An item leaks if a local alignment of its words with a text's
reaches leaked_at of a perfect one. Such an alignment of an item of n words (share L) has at least k = L n - 1 pairs of
matches that follow each other with at most one error between them: a replaced word or one word more on either side.
Each is a gapped pair, two words of the item one or two places apart that are one or two places apart in the text too. So

* of the n - 1 places of an item at which pairs begin, the k - 1 with the most frequent pairs in the corpus can be left
  out: one of the others, the rare seeds, still hits every leak; pairs are counted over all texts;
* around a rare hit a stretch of 2 n words must hold k places where a pair of the item begins, or it isn't aligned.

Neither loses a leak, whatever is edited, if L n is over one, as it is for the items that are looked for.

Null and empty texts match nothing, nor do items of fewer than three words. Up to MAX_SENT words of benchmark, the items
are sent to the tasks, which read each text once to count and once to score; beyond, pairs are shuffled. leaks() gives
one row for each doc_id and item, so rows with one doc_id, or with none, are reported together; clean() judges each row
alone, those without doc_id too. Items with equal item_id stay separate by text and the best counts. Empty tables give
empty results or, in clean(), all rows. Further columns are ignored by leaks() and kept by clean(). A very long item
costs its length times the length of the stretches that are aligned, and no more memory than both.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_rows, discard, fresh, materialise, mix64, numbered, slices
from loomwork.llm.repeats import only_rows

WORDS = re.compile(rb"[a-z0-9\x80-\xff]+")
LEAST_WORDS = 3
#: Scores from which an item counts as leaked. MATCH, MISMATCH and GAP weigh an alignment; the module's bound is for these.
LEAKED_AT = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of benchmark up to which the items are sent to the tasks; beyond, pairs of the corpus are shuffled.
MAX_SENT = 250_000
#: Alignments that a task remembers, so that copies of a passage are aligned once.
REMEMBERED = 20_000
#: Slots of the filters that pass pairs which may be seeds.
FILTER_BITS = 22


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall((text or "").encode().lower())


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) or 1


def needed(n: int, leaked_at: float) -> int:
    """Gapped pairs that a leak of an item of n words has at least."""
    return max(1, math.ceil(round(leaked_at * n - 1, 9)))


def _gapped(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, first and second words of the pairs one and two places apart."""
    n = len(ids)
    at = np.concatenate((np.arange(max(n - 1, 0)), np.arange(max(n - 2, 0))))
    return at, ids[at], np.concatenate((ids[1:], ids[2:]))


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of two words from theirs."""
    return mix64(first.astype(np.uint64) * np.uint64(3) + mix64(second.astype(np.uint64)))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and where it ends in the passage."""
    n = len(passage)
    ramp = np.arange(n) * -GAP
    above, best, end = np.zeros(n, np.int64), 0, 0
    for w in item:
        diagonal = np.concatenate(([0], above[:-1])) + np.where(passage == w, MATCH, MISMATCH)
        here = np.maximum(np.maximum(diagonal, above + GAP), 0)
        above = np.maximum.accumulate(here + ramp) - ramp
        top = int(above.argmax())
        if above[top] > best:
            best, end = int(above[top]), top
    return best, end


class Item:
    """An item's words, its pairs, and how many of them a leak has."""

    def __init__(self, words: np.ndarray, leaked_at: float):
        self.words, self.need = words, needed(len(words), leaked_at)
        self.own, place = np.unique(words, return_inverse=True)
        _, a, b = _gapped(place)
        self.pairs = np.unique(a * (len(self.own) + 1) + b)

    def stretches(self, places: list[int], ids: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of a text that may hold the item, out of those around rare hits."""
        n, out = len(self.words), []
        begin, last = places[0], places[0]
        ranges = []
        for p in [*places[1:], 2**62]:
            if p - last > 4 * n:
                ranges.append((max(0, begin - 2 * n), min(len(ids), last + 2 * n + 2)))
                begin = p
            last = p
        for lo, hi in ranges:
            at = self.as_own(ids[lo:hi])
            place, a, b = _gapped(at)
            code = a * (len(self.own) + 1) + b
            slot = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            hit = np.zeros(len(at) + 1, np.int64)
            hit[1:][place[self.pairs[slot] == code]] = 1
            total = np.cumsum(hit)
            size = min(2 * n, len(at))
            full = np.flatnonzero(total[size:] - total[: len(total) - size] >= self.need)
            if len(full):
                cuts = np.flatnonzero(np.diff(full) > size)
                out += [(lo + int(full[i]), min(hi, lo + int(full[j]) + size + 2)) for i, j in zip([0, *(cuts + 1)], [*cuts, -1], strict=True)]
        return out

    def as_own(self, ids: np.ndarray) -> np.ndarray:
        """Words as places among the item's distinct words; others are one more."""
        at = np.minimum(np.searchsorted(self.own, ids), len(self.own) - 1)
        at[self.own[at] != ids] = len(self.own)
        return at


class Aligner:
    """Scores of items in texts; remembers passages, as far as they differ for the item."""

    def __init__(self, leaked_at: float):
        self.leaked_at, self.known = leaked_at, {}

    def best(self, key, item: Item, places: list[int], ids: np.ndarray) -> tuple[float, int] | None:
        """Share of a perfect alignment and where it ends, if the item leaks; ids are words, as item's or others."""
        best, end, n = 0, 0, len(item.words)
        count = np.bincount(item.as_own(item.words), minlength=len(item.own))
        for lo, hi in item.stretches(places, ids):
            at = item.as_own(ids[lo:hi])
            if np.minimum(np.bincount(at, minlength=len(item.own) + 1)[:-1], count).sum() < self.leaked_at * n:
                continue
            if len(self.known) > REMEMBERED:
                self.known.clear()
            passage = (key, at.astype(np.int32).tobytes())
            if passage not in self.known:
                self.known[passage] = align(item.words, ids[lo:hi])
            score, stop = self.known[passage]
            if score > best:
                best, end = score, lo + stop
        share = best / (MATCH * n)
        return (round(share, 6), end) if best and share >= self.leaked_at else None


class Index:
    """The items, their words by number, and the codes of their pairs: which items have them, and which are rare."""

    def __init__(self, items: list[tuple[int, str]], leaked_at: float):
        self.word: dict[bytes, int] = {}
        rows = [(item, np.array([self.word.setdefault(w, len(self.word)) for w in words_of(text)], np.int64)) for item, text in items]
        self.items = [(item, Item(words, leaked_at)) for item, words in rows if len(words) >= LEAST_WORDS]
        self.base = max(1, len(self.word))
        pairs = [self._pairs(item.words) for _, item in self.items]
        self.codes, slot = np.unique(np.concatenate([c for _, c in pairs] or [np.zeros(0, np.int64)]), return_inverse=True)
        self.slots = np.split(slot, np.cumsum([len(c) for _, c in pairs])[:-1]) if pairs else []
        self.places = [p for p, _ in pairs]
        self.passes = np.zeros(1 << FILTER_BITS, bool)
        self.passes[self._filter(self.codes)] = True

    def _pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, a, b = _gapped(ids)
        ok = (a >= 0) & (b >= 0)
        return at[ok], a[ok] * self.base + b[ok]

    @staticmethod
    def _filter(codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A text's words as numbers, -1 for words of no item; places and slots of the pairs that an item has."""
        words = words_of(text)
        get = self.word.get
        ids = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        place, code = self._pairs(ids)
        maybe = self.passes[self._filter(code)]
        place, code = place[maybe], code[maybe]
        slot = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        found = self.codes[slot] == code if len(self.codes) else np.zeros(len(slot), bool)
        return ids, place[found], slot[found]

    def rare(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each code the items for which it is a seed: bounds by slot, and the items' numbers. counts: of the corpus, by slot."""
        slots, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (_, item) in enumerate(self.items):
            common = np.bincount(self.places[k], counts[self.slots[k]], len(item.words) - 1)
            keep = np.ones(len(common), bool)
            keep[np.argsort(-common, kind="stable")[: item.need - 1]] = False
            own = np.unique(self.slots[k][keep[self.places[k]]])
            slots.append(own)
            owners.append(np.full(len(own), k))
        slot, owner = np.concatenate(slots), np.concatenate(owners)
        order = np.argsort(slot, kind="stable")
        return np.searchsorted(slot[order], np.arange(len(self.codes) + 1)), owner[order]


LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("end_word", pa.int64()), ("n_item_words", pa.int64())])
LEAK_ROWS = "doc_id long, item_id long, score double, end_word long, n_item_words long"


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, item_text, n_words) of the items of at least LEAST_WORDS words, numbered, in a written table."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).distinct()
    schema = pa.schema([("item_id", pa.int64()), ("item_text", pa.string()), ("n_words", pa.int64())])

    def of(batch: pa.RecordBatch) -> dict:
        return {"item_id": batch.column("item_id"), "item_text": batch.column("item_text"), "n_words": [len(words_of(t)) for t in batch.column("item_text").to_pylist()]}

    return numbered(items.mapInArrow(arrow_rows(schema, of), "item_id long, item_text string, n_words long").where(F.col("n_words") >= LEAST_WORDS), "item")


def _few(items: DataFrame) -> bool:
    return (items.agg(F.sum("n_words")).first()[0] or 0) <= MAX_SENT


def leaks(docs: DataFrame, benchmark: DataFrame, leaked_at: float = LEAKED_AT) -> DataFrame:
    """doc_id, item_id, score, end_word: each pair of a document and an item that it holds, by the best passage."""
    items = items_of(benchmark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if _few(items):
        scored = _sent(texts, items, leaked_at)
        discard(items)
    else:
        scored = _shuffled(numbered(texts), items, leaked_at)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "end_word", "n_item_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", "b.end_word", "b.n_item_words")


def _held(texts: DataFrame, items: DataFrame, leaked_at: float):
    """The items, at most MAX_SENT words, and their rare seeds as a broadcast; pairs are counted over all texts."""
    sc = texts.sparkSession.sparkContext
    index = Index(sorted((r.item_id, r.item_text) for r in items.select("item_id", "item_text").collect()), leaked_at)
    held = sc.broadcast(index)
    schema = pa.schema([("slot", pa.int64()), ("n", pa.int64())])

    def count(batches):
        own = held.value
        n = np.zeros(len(own.codes), np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                slot = own.read(text)[2]
                if len(slot):
                    n += np.bincount(slot, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], schema=schema)

    counts = np.zeros(len(index.codes))
    if len(counts):
        got = texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most two rows a word of benchmark
        counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return sc.broadcast((index, *index.rare(counts)))


def _found(held: tuple, aligner: Aligner, text: str | None):
    """(item_id, words, (score, end)) of each item that a text holds."""
    index, bounds, owners = held
    ids, place, slot = index.read(text)
    first, n = bounds[slot], bounds[slot + 1] - bounds[slot]
    place, at = np.repeat(place, n), np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1]))[: len(n)], n) + np.arange(n.sum())
    owner = owners[at]
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for k, places in zip(owner[np.concatenate(([0], cuts))].tolist() if len(owner) else [], np.split(place, cuts), strict=False):
        item_id, item = index.items[k]
        if got := aligner.best(k, item, places.tolist(), ids):
            yield item_id, len(item.words), got


def _sent(texts: DataFrame, items: DataFrame, leaked_at: float) -> DataFrame:
    """Scores of all texts by items that the tasks hold."""
    held = _held(texts, items, leaked_at)

    def run(batches):
        aligner = Aligner(leaked_at)

        def of(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in LEAKS.names}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for item, n, got in _found(held.value, aligner, text):
                    for name, v in zip(LEAKS.names, (doc, item, *got, n), strict=True):
                        out[name].append(v)
            return out

        for batch in batches:
            yield from arrow_rows(LEAKS, of)(slices(batch, 512))

    return texts.mapInArrow(run, LEAK_ROWS)


PAIRS = pa.schema([("row", pa.int64()), ("pair", pa.int64()), ("pos", pa.int32())])


def pairs_of(texts: DataFrame, row: str, text: str, passes=None) -> DataFrame:
    """(row, pair, pos) of the gapped pairs of all texts, as far as the filter passes them."""

    def of(batch):
        out: list[list] = [[], [], []]
        for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(t)
            place, a, b = _gapped(np.fromiter(map(word_hash, words), np.uint64, len(words)))
            key = pair_keys(a, b)
            ok = passes.value[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] if passes is not None else slice(None)
            place, key = place[ok], key[ok]
            for column, values in zip(out, (np.full(len(key), r), key.view(np.int64), place.astype(np.int32)), strict=True):
                column.append(values)
        return {k: np.concatenate(v or [np.zeros(0, np.int64)]) for k, v in zip(PAIRS.names, out, strict=True)}

    def run(batches):
        for batch in batches:
            yield from arrow_rows(PAIRS, of)(slices(batch, 64))

    return texts.select(row, text).mapInArrow(run, "row long, pair long, pos int")


def _filter(seeds: DataFrame):
    """A filter of 2^FILTER_BITS slots for seeds(pair), whatever their number."""
    slot = seeds.select(F.shiftrightunsigned("pair", 64 - FILTER_BITS).alias("slot"))
    words = slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 6, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return seeds.sparkSession.sparkContext.broadcast(np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool))


ROW_LEAKS = LEAKS.insert(0, pa.field("row", pa.int64()))


def _shuffled(texts: DataFrame, items: DataFrame, leaked_at: float) -> DataFrame:
    """Scores of texts(row, doc_id, text) that hold a rare seed of an item, found by a join of pairs; with their row."""
    own = materialise(pairs_of(items, "item", "item_text").withColumnRenamed("row", "item"))
    counted = pairs_of(texts, "row", "text", _filter(own)).groupBy("pair").count()
    common = own.join(counted, "pair", "left").groupBy("item", "pos").agg(F.sum(F.coalesce("count", F.lit(0))).alias("n"))
    need = F.greatest(F.lit(1), F.ceil(F.round(F.lit(leaked_at) * F.col("n_words") - 1, 9)))
    ranked = common.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("n"), "pos"))).join(items.select("item", need.alias("need")), "item")
    rare = materialise(own.join(ranked.where("rank >= need").select("item", "pos"), ["item", "pos"]).select("pair", "item").distinct())
    hits = pairs_of(texts, "row", "text", _filter(rare)).join(rare, "pair")
    near = materialise(hits.groupBy("row", "item").agg(F.sort_array(F.collect_set("pos")).alias("places")))
    wanted = near.join(items.select("item", "item_id", "item_text"), "item").select(F.col("row").alias("of"), "item_id", "item_text", "places")

    def score(text: pa.Table, found: pa.Table) -> pa.Table:
        aligner, out = Aligner(leaked_at), {k: [] for k in ROW_LEAKS.names}
        for row, doc, t in zip(*(text.column(k).to_pylist() for k in ("row", "doc_id", "text")), strict=True):
            words = words_of(t)
            for at in range(found.num_rows):
                item_id, item_text, places = (found.column(k)[at].as_py() for k in ("item_id", "item_text", "places"))
                known: dict[bytes, int] = {}
                item = Item(np.array([known.setdefault(w, len(known)) for w in words_of(item_text)], np.int64), leaked_at)
                ids = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
                if got := aligner.best(at, item, places, ids):
                    for k, v in zip(ROW_LEAKS.names, (row, doc, item_id, *got, len(item.words)), strict=True):
                        out[k].append(v)
        return pa.table(out, schema=ROW_LEAKS)

    candidates = only_rows(texts, near.select("row"))
    return candidates.groupBy("row").cogroup(wanted.groupBy("of")).applyInArrow(score, f"row long, {LEAK_ROWS}")


def clean(docs: DataFrame, benchmark: DataFrame, leaked_at: float = LEAKED_AT) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item; up to MAX_SENT words of benchmark without a shuffle of texts."""
    items = items_of(benchmark)
    if not _few(items):
        row = fresh("row", docs)
        rows = numbered(docs, row)
        leaked = materialise(_shuffled(rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), items, leaked_at).select(F.col("row").alias(row)).distinct())
        return rows.join(leaked, row, "left_anti").select(*docs.columns)
    held = _held(docs, items, leaked_at)
    discard(items)

    def run(batches):
        aligner = Aligner(leaked_at)
        for batch in batches:
            for part in slices(batch, 512):
                yield part.filter(pa.array([next(_found(held.value, aligner, t), None) is None for t in part.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
