"""Exact repeated byte windows by a depth-limited radix sort in most-significant-digit passes.

A suffix matters only through its first WINDOW bytes. Suffixes are ordered digit by digit, and a group
that a pass leaves with one member is dropped:

1. The first digit of a window is its minimiser: the smallest hash among the GRAM-byte strings it holds.
   Equal windows have equal minimisers at equal places, and neighbouring windows mostly share one, so that
   one record (an anchor) stands for a run of suffixes. Anchors that occur once leave here.
2. Runs found twice or more, known by 128 bits of their bytes, are repeated at full depth.
3. Different runs of one anchor are ordered by their bytes, one byte a pass: first those of the anchor, then
   each byte to its right and each to its left, and who is alone in a group leaves. Two windows are equal if
   their runs are in one group both to the left and to the right as far as the window reaches. Anchors with
   more than HEAVY distinct runs are spread over tasks instead, by 128 bits of each window's bytes.

Equal groups at the end are exactly the repeated windows. Null and empty texts have no windows. Rows are
numbered in a written table first, so rows with one doc_id or none are documents of their own, and repeated
rows are copies of each other that all go. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_rows, discard, materialise, mix64, numbered, slices

WINDOW = 200
GRAM = 32
#: Anchors with up to so many distinct runs are compared by one task; the windows of others are spread over tasks.
HEAVY = 5000
#: Bytes of runs that a task orders at a time.
ORDERED = 6 << 20
#: Slots of the filter that keeps texts without findings out of a shuffle; at most so many numbers reach the driver.
SLOTS = 1 << 22
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: One random-looking 64-bit value for each byte.
BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
#: Bytes of a text that are hashed at a time.
STRETCH = 1 << 20


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram-byte string, by differences of a running polynomial."""
    n = len(raw)
    if n < gram:
        return np.zeros(0, np.uint64)
    powers = np.empty(n, np.uint64)
    powers[0] = 1
    powers[1:] = BASE
    np.multiply.accumulate(powers, out=powers)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[raw] * powers, dtype=np.uint64)))
    back = np.empty(n - gram + 1, np.uint64)
    back[0] = 1
    back[1:] = INVERSE
    np.multiply.accumulate(back, out=back)
    return mix64((run[gram:] - run[: n - gram + 1]) * back)


def minimisers(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of width hashes, the place of its smallest one, the first of equals.

    Hashes are laid out in blocks of width; a run is the end of a block and the start of the next one,
    so running minima from both ends of each block answer all runs."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = np.concatenate((h, np.full(-len(h) % width, np.uint64(2**64 - 1)))).reshape(-1, width)
    start = np.arange(0, key.size, width)[:, None]
    col = np.arange(width)
    low = np.minimum.accumulate(key, axis=1)
    new = np.ones(key.shape, bool)
    new[:, 1:] = key[:, 1:] < low[:, :-1]
    place = (np.maximum.accumulate(np.where(new, col, 0), axis=1) + start).ravel()
    turned = key[:, ::-1]
    back = np.minimum.accumulate(turned, axis=1)
    back_place = (start + width - 1 - np.maximum.accumulate(np.where(turned == back, col, 0), axis=1))[:, ::-1].ravel()
    back = back[:, ::-1].ravel()
    return np.where(back[:n] <= low.ravel()[width - 1 : width - 1 + n], back_place[:n], place[width - 1 : width - 1 + n])


def runs(data: bytes, window: int = WINDOW, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """(minimiser's hash, first window, last window, minimiser's place in the first) of each run of windows with one anchor."""
    raw = np.frombuffer(data, np.uint8)
    out: list = []
    for at in range(0, max(0, len(raw) - window + 1), STRETCH):
        h = gram_hashes(raw[at : at + STRETCH + window - 1], gram)
        where = minimisers(h, window - gram + 1)
        cut = np.flatnonzero(np.diff(where)) + 1
        first = np.concatenate(([0], cut))
        last = np.concatenate((cut, [len(where)])) - 1
        out += zip(h[where[first]].view(np.int64).tolist(), (first + at).tolist(), (last + at).tolist(), (where[first] - first).tolist(), strict=True)
    return out


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def wide_hash(data: bytes) -> tuple[int, int]:
    """128 bits as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(data)
    return _signed(h >> 64), _signed(h & (2**64 - 1))


#: off: the anchor's place in the first window; run, run2: bits of all the windows' bytes.
ANCHORS = pa.schema([("row", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("off", pa.int32()), ("anchor", pa.int64()), ("run", pa.int64()), ("run2", pa.int64())])
RUN = ["anchor", "run", "run2"]


def anchors(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """One record for each run of texts(row, text)."""

    def of(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ANCHORS.names}
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = text.encode()
            for anchor, first, last, off in runs(data, window, gram):
                for k, v in zip(ANCHORS.names, (row, first, last, off, anchor, *wide_hash(data[first : last + window])), strict=True):
                    out[k].append(v)
        return out

    def run(batches):
        for batch in batches:
            yield from arrow_rows(ANCHORS, of)(slices(batch, 512))

    return texts.select("row", "text").mapInArrow(run, "row long, first int, last int, off int, anchor long, run long, run2 long")


def only_rows(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts whose row may be among wanted(row): a filter of SLOTS bits, whatever the input's size.

    It only saves shuffling texts that the join after it would drop."""
    slot = F.pmod(F.xxhash64("row"), F.lit(SLOTS)).cast("int")
    bits = np.zeros(SLOTS, bool)
    bits[wanted.select(slot.alias("slot")).distinct().toPandas()["slot"].to_numpy()] = True
    held = texts.sparkSession.sparkContext.broadcast(np.packbits(bits))

    @F.pandas_udf("boolean")
    def among(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy()
        return pd.Series((held.value[at >> 3] >> (7 - (at & 7))) & 1).astype(bool)

    return texts.where(among(slot))


RUN_BYTES = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("run2", pa.int64()), ("n_runs", pa.int64()), ("off", pa.int32()), ("bytes", pa.binary())])
RUN_BYTES_DDL = "anchor long, run long, run2 long, n_runs long, off int, bytes binary"
PLACES = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("run2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
WINDOWS = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("run2", pa.int64()), ("lo", pa.int32()), ("window", pa.int64()), ("window2", pa.int64())])


def _grouped(group: np.ndarray, digit: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal (group, digit), and which members aren't alone in theirs."""
    _, at, n = np.unique(group * size + digit, return_inverse=True, return_counts=True)
    return at, n[at] > 1


def _passes(group: np.ndarray, digits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[depth, run]: the group by the first depth digits, -1 for who is alone or has fewer digits; digits[run, depth]."""
    out = np.full((digits.shape[1] + 1, len(group)), -1, np.int64)
    out[0] = group
    members = np.flatnonzero(group >= 0)
    for depth in range(1, digits.shape[1] + 1):
        members = members[sizes[members] >= depth]
        at, more = _grouped(out[depth - 1, members], digits[members, depth - 1], 256)
        members = members[more]
        if not len(members):
            break
        out[depth, members] = at[more]
    return out


def shared_windows(anchor: np.ndarray, off: np.ndarray, data: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, lo, hi): windows that a run shares with another run of its anchor."""
    n, depth = len(data), window - gram
    sizes = np.fromiter(map(len, data), np.int64, n)
    flat = np.frombuffer(b"".join(data) + bytes(window), np.uint8)
    middle = np.cumsum(sizes) - sizes + off
    right_size, left_size = sizes - off - gram, off.astype(np.int64)
    col = np.arange(depth)
    right = flat[np.minimum(middle[:, None] + gram + col, len(flat) - 1)]
    left = flat[np.maximum(middle[:, None] - 1 - col, 0)]
    group = np.unique(anchor, return_inverse=True)[1]
    for k in range(gram):
        group = _grouped(group, flat[middle + k], 256)[0]
    alone = ~_grouped(group, np.zeros(n, np.int64), 1)[1]
    group[alone] = -1
    rights, lefts = _passes(group, right, right_size), _passes(group, left, left_size)
    again = np.zeros((n, depth + 2), bool)  # by the window's place in the run, with an end that is never shared
    for d in range(depth + 1):
        some = np.flatnonzero((lefts[d] >= 0) & (rights[depth - d] >= 0))
        if len(some):
            some = some[_grouped(lefts[d, some], rights[depth - d, some], n + 1)[1]]
            again[some, off[some] - d] = True
    step = np.diff(again.astype(np.int8), axis=1, prepend=0)
    run, lo = np.nonzero(step == 1)
    return run, lo, np.nonzero(step == -1)[1] - 1


def _ordered(batches, window: int, gram: int):
    """Places of shared windows, of runs that come with all of an anchor's together."""

    def places(part: pa.Table) -> pa.RecordBatch:
        run, lo, hi = shared_windows(part.column("anchor").to_numpy(), part.column("off").to_numpy(), part.column("bytes").to_pylist(), window, gram)
        keys = [pa.array(part.column(k).to_numpy()[run]) for k in RUN]
        return pa.RecordBatch.from_arrays([*keys, pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], schema=PLACES)

    held: list = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) > ORDERED:
            part = pa.Table.from_batches(held)
            anchor = part.column("anchor").to_numpy()
            whole = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if whole:
                yield places(part.slice(0, whole))
            held = part.slice(whole).combine_chunks().to_batches()
    if held:
        yield places(pa.Table.from_batches(held))


def repeated_places(texts: DataFrame, window: int, gram: int, heavy: int) -> DataFrame:
    """(row, lo, hi): first and last start of adjoining repeated windows."""
    all_marks = materialise(anchors(texts, window, gram))
    # Both lists of anchors are written, so that the joins are of two plain shuffles and a hot anchor's task can be split.
    often = materialise(all_marks.groupBy("anchor").count().where("count > 1").select("anchor"))
    marks = materialise(all_marks.join(often, "anchor", "left_semi"))
    discard(all_marks, often)
    by_run = materialise(marks.groupBy(*RUN).agg(F.count("*").alias("copies"), F.min(F.struct("row", "first", "last", "off")).alias("at")))
    n_runs = materialise(by_run.groupBy("anchor").agg(F.count("*").alias("n_runs")).where("n_runs > 1"))
    mixed = materialise(by_run.join(n_runs, "anchor").select(*RUN, "n_runs", "at.*"))

    def cut(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in RUN_BYTES.names}
        for text, parts in zip(batch.column("text").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            data = text.encode()
            for p in parts:
                for k in (*RUN, "n_runs", "off"):
                    out[k].append(p[k])
                out["bytes"].append(data[p["first"] : p["last"] + window])
        return out

    wanted = mixed.groupBy("row").agg(F.collect_list(F.struct(*RUN, "n_runs", "first", "last", "off")).alias("parts"))
    pieces = materialise(only_rows(texts, mixed.select("row")).join(wanted, "row").select("text", "parts").mapInArrow(arrow_rows(RUN_BYTES, cut), RUN_BYTES_DDL))

    light = pieces.where(F.col("n_runs") <= heavy).select(*RUN, "off", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    light = light.mapInArrow(lambda batches: _ordered(batches, window, gram), "anchor long, run long, run2 long, lo int, hi int")

    def spread(batches):
        for batch in batches:
            for part in slices(batch, 200):
                out: dict[str, list] = {k: [] for k in WINDOWS.names}
                for anchor, run, run2, data in zip(*(part.column(k).to_pylist() for k in (*RUN, "bytes")), strict=True):
                    for lo in range(len(data) - window + 1):
                        for k, v in zip(WINDOWS.names, (anchor, run, run2, lo, *wide_hash(data[lo : lo + window])), strict=True):
                            out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in WINDOWS], schema=WINDOWS)

    windows = pieces.where(F.col("n_runs") > heavy).select(*RUN, "bytes").mapInArrow(spread, "anchor long, run long, run2 long, lo int, window long, window2 long")
    key, run = ["anchor", "window", "window2"], F.struct("run", "run2")
    again = windows.groupBy(*key).agg(F.min(run).alias("least"), F.max(run).alias("most")).where("least <> most").select(*key)
    spread_out = windows.join(again, key, "left_semi").select(*RUN, "lo", F.col("lo").alias("hi"))
    whole = by_run.where("copies > 1").select(*RUN, F.lit(0).alias("lo"), (F.col("at.last") - F.col("at.first")).alias("hi"))
    found = materialise(whole.unionByName(light).unionByName(spread_out))
    discard(by_run, n_runs, mixed, pieces)
    return marks.join(found, RUN).select("row", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))


RESULT = pa.schema([("row", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string())])


def cut_out(data: bytes, parts: list[tuple[int, int]], window: int) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go and in how many runs; parts are (first, last) starts of windows."""
    kept, at, spans = [], 0, 0
    for lo, hi in sorted(parts):
        if lo > at or not spans:
            kept.append(data[at:lo])
            spans += 1
        at = max(at, hi + window)
    kept.append(data[at:])
    rest = b"".join(kept)
    return rest, len(data) - len(rest), spans


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs."""
    texts = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    places = materialise(repeated_places(texts, window, gram, heavy).groupBy("row").agg(F.collect_set(F.struct("lo", "hi")).alias("parts")))

    def of(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in RESULT.names}
        for row, text, parts in zip(*(batch.column(k).to_pylist() for k in ("row", "text", "parts")), strict=True):
            rest, removed, spans = cut_out(text.encode(), [(p["lo"], p["hi"]) for p in parts], window)
            for k, v in zip(RESULT.names, (row, removed, spans, hashlib.sha256(rest).hexdigest()), strict=True):
                out[k].append(v)
        return out

    none = F.lit(0).cast("long")
    changed = only_rows(texts, places.select("row")).join(places, "row").select("row", "text", "parts").mapInArrow(arrow_rows(RESULT, of), "row long, n_removed long, n_spans long, kept string")
    every = texts.select("doc_id", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    return every.join(changed, "row", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))
