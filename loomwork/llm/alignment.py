"""Alignment of two tokenizers: a byte-level BPE (A) and a SentencePiece model with byte fallback (B).

The tokenizers library's character offsets and the sentencepiece library's spans are coarse cuts of the text. Tokens
that share a character (parts of a multibyte character, fallback bytes) are cut by the number of their decoded bytes.
Offsets where tokens of both end cut them into groups; tokens whose byte ranges overlap are linked.

A text is encoded in chunks, begun by a blank or line feed after other than white space: no pretoken of A and no piece
of B crosses such a place, so a chunk's tokens are those in the whole text, and chunks seen before are looked up.
Counts of linked pairs are summed over all texts: rows of the first table stand for blocks of about BLOCK characters,
which send their pairs once; each block then takes the sums of its own pairs and scores its texts.

Texts that are null or empty, or whose token bytes aren't a blank and the text, have no tokens. Rows with equal doc_id
stay separate, further columns are ignored, an empty table gives an empty one. A very long text is a block of its own.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import discard, materialise, slices

SPACE = "▁"
CHUNK = re.compile(rf"[\s{SPACE}]+[^\s{SPACE}]*(?:(?![ \n])[\s{SPACE}]+[^\s{SPACE}]*)*")
LOOSE = re.compile(rf"[\s{SPACE}]")
#: Characters of a block, new chunks that are written into one text, chunks that are looked up together, chunks that a worker remembers.
BLOCK = 1 << 20
JOINED = 24
TOGETHER = 1 << 14
CACHE = 360_000
#: Rows of a row group of the blocks' table: Spark decodes a group at once, up to 4096 rows, and a block takes some 3 MB.
ROWS = {"parquet.block.row.count.limit": 8}
STATS = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
BLOCK_TYPES = {**{c: "array<bigint>" for c in STATS}, "groups_sha256": "array<string>", "codes": "array<int>", "counts": "array<bigint>", "sizes": "array<int>", "places": "array<int>", "times": "array<int>"}
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_level() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def refined(starts, ends, sizes):
    """Ends of tokens: the coarse ones, but tokens that begin where the one before does, or before it ends, follow it by their decoded sizes."""
    if not len(ends):
        return ends
    shared = np.concatenate(([False], (starts[1:] < ends[:-1]) | (starts[1:] == starts[:-1])))
    first = np.flatnonzero(~shared)
    run = np.cumsum(~shared) - 1
    upto = np.cumsum(sizes)
    before = upto[first] - sizes[first]
    counted = starts[first][run] + upto - before[run]
    alone = np.ones(len(ends), bool)
    alone[shared] = False
    alone[np.flatnonzero(shared) - 1] = False
    return np.where(alone, ends, counted)


class Aligner:
    """What is known of chunks: numbers of tokens, groups and links, the text of the groups, the codes of the links."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        byte_of = byte_level()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.a_bytes[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("pieces of this vocabulary cross blanks; chunks can't be encoded alone")
        self.base = len(pieces)
        if len(self.a_bytes) * self.base >= 2**31:
            raise ValueError("pairs of these vocabularies don't fit 31 bits")
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # Older versions of the library count a span's characters, newer ones its bytes.
        self.spans_are_bytes = self.b.encode("é", return_type="proto").pieces[-1].end == 2
        self.blank = self.b.piece_to_id(SPACE)
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.ok = np.zeros(0, bool)
        self.counts = np.zeros((0, 4), np.int64)
        self.codes = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)
        self.hits = np.zeros(0, np.int64)

    def shrink(self, size: int) -> None:
        """Forgets all but the ``size`` chunks that most blocks had; numbers of chunks change."""
        order = np.sort(np.argsort(-self.hits, kind="stable")[:size])
        n = np.diff(self.ends)
        of = np.zeros(len(n), bool)
        of[order] = True
        self.codes, self.ends = self.codes[np.repeat(of, n)], np.concatenate(([0], np.cumsum(n[order])))
        self.ok, self.counts, self.hits = self.ok[order], self.counts[order], self.hits[order] // 2
        chunks = list(self.known)
        self.known = {chunks[k]: at for at, k in enumerate(order.tolist())}
        self.groups = [self.groups[k] for k in order.tolist()]

    def _pieces(self, texts: list[str], base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of B of texts that begin with a blank or a line feed, and starts and ends in their bytes; base: where each text begins.

        The library puts a blank before a text, which is the text's own if it has one; else the text is put behind another
        line feed, which joins with nothing. A blank alone is the empty text, in front of which the library puts nothing."""
        asked = [t[1:] if t[0] == " " else "\n" + t for t in texts]
        ids, lo, hi = [], [], []
        for text, question, proto, at in zip(texts, asked, self.b.encode(asked, return_type="proto", num_threads=1), base.tolist(), strict=True):
            pieces = proto.pieces
            found = [p.id for p in pieces], [p.begin for p in pieces], [p.end for p in pieces]
            if not question:
                found = [self.blank], [-1], [0]
            elif not self.spans_are_bytes:
                byte_at = [0, *itertools.accumulate(len(x.encode()) for x in question)]
                found = found[0], [byte_at[x] for x in found[1]], [byte_at[x] for x in found[2]]
            one, two, three = map(np.array, found)
            if text[0] == " ":
                two[0] = -1
                shift = at + 1
            else:
                one, two, three, shift = one[2:], two[2:], three[2:], at - 1
            ids.append(one)
            lo.append(two + shift)
            hi.append(three + shift)
        return np.concatenate(ids), np.concatenate(lo), np.concatenate(hi)

    @staticmethod
    def _same(raw: list[bytes], sizes: np.ndarray, n: np.ndarray, ids: np.ndarray, names: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """Whether the tokens' bytes are each chunk's: all chunks at once, and one by one if some aren't."""
        upto, total = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(lengths[ids])))
        parts = list(map(names.__getitem__, ids.tolist()))
        if b"".join(parts) == b"".join(raw) and (np.diff(total[upto]) == sizes).all():
            return np.ones(len(raw), bool)
        return np.fromiter((b"".join(parts[i:j]) == t for t, (i, j) in zip(raw, itertools.pairwise(upto.tolist()), strict=True)), bool, len(raw))

    def learn(self, new: list[str]) -> None:
        """Aligns chunks that aren't known yet, written one after the other: a chunk's tokens don't depend on those around it
        if it ends with other than white space. The others, at the ends of texts, are aligned one by one."""
        text = "".join(new)
        raw = [c.encode() for c in new]
        m, sizes = len(new), np.fromiter(map(len, raw), np.int64, len(new))
        base = np.concatenate(([0], np.cumsum(sizes)))
        texts = ["".join(new[k : k + JOINED]) for k in range(0, m, JOINED)]
        first_char = np.cumsum([0, *map(len, texts[:-1])])
        encoded = self.a.encode_batch(texts, add_special_tokens=False)
        a_flat = np.concatenate([np.array(e.ids, np.int64) for e in encoded])
        spans = np.concatenate([np.array(e.offsets, np.int64).reshape(-1, 2) + at for e, at in zip(encoded, first_char.tolist(), strict=True)])
        # Characters of all chunks one after the other, and the byte at which each begins.
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        byte_at = np.concatenate(([0], np.cumsum(1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF))))
        a_lo, a_hi = byte_at[spans[:, 0]], byte_at[spans[:, 1]]
        b_flat, b_lo, b_hi = self._pieces(texts, byte_at[first_char])
        a_n, b_n = (np.diff(np.searchsorted(x, base)) for x in (a_lo, b_lo))
        ok = self._same(raw, sizes, a_n, a_flat, self.a_bytes, self.a_sizes) & self._same(raw, sizes, b_n, b_flat, self.b_bytes, self.b_sizes)
        a_ends, b_ends = refined(a_lo, a_hi, self.a_sizes[a_flat]), refined(b_lo, b_hi, self.b_sizes[b_flat])
        # Chunks whose bytes differ have no tokens; what is left has all its ends in order.
        a_keep, b_keep = np.repeat(ok, a_n), np.repeat(ok, b_n)
        a_flat, a_ends, b_flat, b_ends = a_flat[a_keep], a_ends[a_keep], b_flat[b_keep], b_ends[b_keep]
        cuts, common = np.union1d(a_ends, b_ends), np.intersect1d(a_ends, b_ends, assume_unique=True)
        codes = a_flat[np.searchsorted(a_ends, cuts)] * self.base + b_flat[np.searchsorted(b_ends, cuts)]
        upto = lambda x: np.searchsorted(x, base, side="right")
        of_a, of_b, of_cut, of_common = map(upto, (a_ends, b_ends, cuts, common))
        a_upto, b_upto = np.searchsorted(a_ends, common, side="right").tolist(), np.searchsorted(b_ends, common, side="right").tolist()
        a_text, b_text = list(map(str, a_flat.tolist())), list(map(str, b_flat.tolist()))
        texts, a, b = [], 0, 0
        for i, j in zip(a_upto, b_upto, strict=True):
            texts.append(f"{a_text[a]}|{b_text[b]}" if i - a == 1 == j - b else ",".join(a_text[a:i]) + "|" + ",".join(b_text[b:j]))
            a, b = i, j
        lines = of_common.tolist()
        self.groups += [";".join(texts[i:j]) for i, j in itertools.pairwise(lines)]
        self.known.update(zip(new, range(len(self.ok), len(self.ok) + m), strict=True))
        self.ok = np.concatenate((self.ok, ok))
        self.hits = np.concatenate((self.hits, np.zeros(m, np.int64)))
        self.counts = np.concatenate((self.counts, np.stack([np.diff(x) for x in (of_a, of_b, of_common, of_cut)], axis=1)))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(np.diff(of_cut))))
        self.codes = np.concatenate((self.codes, codes.astype(np.int32)))

    def seen(self, lists: list[list[str]]) -> None:
        """Learns what is new in lists of chunks."""
        new = list(set(itertools.chain.from_iterable(lists)).difference(self.known))
        loose = [c for c in new if LOOSE.match(c[-1])]
        whole = [c for c in new if not LOOSE.match(c[-1])] if loose else new
        for at in range(0, len(whole), TOGETHER):
            self.learn(whole[at : at + TOGETHER])
        for c in loose:
            self.learn([c])

    def text(self, lists):
        """Of a text's chunks, in lists one after the other: its four numbers, the digest of its groups, its distinct chunks and how
        often it has each; None if it has no tokens."""
        digest, total, own, begun = hashlib.sha256(), np.zeros(4, np.int64), None, False
        for chunks in lists:
            at = list(map(self.known.__getitem__, chunks))
            place = np.array(at)
            if not self.ok[place].all():
                return None
            digest.update(((";" if begun else "") + ";".join(map(self.groups.__getitem__, at))).encode())
            total += self.counts[place].sum(axis=0)
            times = np.ones(len(place), np.int64)
            if begun:
                place, times = np.concatenate((own[0], place)), np.concatenate((own[1], times))
            own = np.unique(place, return_inverse=True)
            own, begun = (own[0], np.bincount(own[1], times, len(own[0])).astype(np.int64)), True
        return total, digest.hexdigest(), *own

    def texts(self, texts: list[str | None]):
        """What text() gives for each; chunks of all are learned together, those of a long text in parts."""
        short = [CHUNK.findall(" " + t) if t and len(t) <= BLOCK else None for t in texts]
        self.seen([x for x in short if x])
        for t, chunks in zip(texts, short, strict=True):
            yield self.text([chunks]) if chunks else self.text(self._parts(t)) if t else None

    def _parts(self, text: str):
        found = CHUNK.finditer(" " + text)
        while part := [x[0] for x in itertools.islice(found, TOGETHER)]:
            self.seen([part])
            yield part

    def links(self, docs: list[tuple[np.ndarray, np.ndarray]]):
        """Distinct codes of a block with their counts; and for each text the number of its codes, their places and how often it has each."""
        place = np.concatenate([d[0] for d in docs]) if docs else np.zeros(0, np.int64)
        times = np.concatenate([d[1] for d in docs]) if docs else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(docs)), [len(d[0]) for d in docs])
        self.hits += np.bincount(place, minlength=len(self.hits))
        n = self.ends[place + 1] - self.ends[place]
        at = np.repeat(self.ends[place] - np.concatenate(([0], np.cumsum(n)[:-1]))[: len(n)], n) + np.arange(n.sum())
        codes, where = np.unique(self.codes[at], return_inverse=True)
        key, back = np.unique(np.repeat(of, n) * max(len(codes), 1) + where, return_inverse=True)
        many = np.bincount(back, np.repeat(times, n), len(key)).astype(np.int64)
        counts = np.bincount(key % max(len(codes), 1), many, len(codes)).astype(np.int64)
        return codes, counts, np.bincount(key // max(len(codes), 1), minlength=len(docs)), key % max(len(codes), 1), many


#: Aligners of a worker, by their files, with what they know of chunks: tasks of one worker follow each other.
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(a_file: str, b_file: str) -> Aligner:
    if (a_file, b_file) not in _ALIGNERS:
        _ALIGNERS[a_file, b_file] = Aligner(a_file, b_file)
    return _ALIGNERS[a_file, b_file]


def blocks(docs: DataFrame, a_file: str, b_file: str, size: int = BLOCK) -> DataFrame:
    """A row for each block of texts: the texts' numbers and digests, and the codes of their links."""
    types = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(c, pa.list_(types[t[6:-1]])) for c, t in BLOCK_TYPES.items()])

    def run(batches):
        aligner = _aligner(a_file, b_file)
        rows, links, chars = [], [], 0

        def block():
            nonlocal rows, links, chars
            codes, counts, sizes, places, times = aligner.links(links)
            cols = [*map(list, zip(*rows, strict=True)), codes, counts, sizes, places, times]
            rows, links, chars = [], [], 0
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, f.type.value_type)) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for part in slices(batch):
                if len(aligner.known) > CACHE:
                    if rows:
                        yield block()
                    aligner.shrink(CACHE // 3)
                texts = part.column("text").to_pylist()
                for doc_id, text, got in zip(part.column("doc_id").to_pylist(), texts, aligner.texts(texts), strict=True):
                    rows.append((doc_id, *(got[0].tolist() if got else (0, 0, 0, 0)), got[1] if got else ""))
                    links.append(got[2:] if got else (np.zeros(0, np.int64),) * 2)
                    chars += len(text or "") + 1
                    if chars >= size:
                        yield block()
        if rows:
            yield block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in BLOCK_TYPES.items()))


def pair_counts(blocked: DataFrame, base: int) -> DataFrame:
    """code, n, and whether n is the highest of the code's B id."""
    each = blocked.select(F.explode(F.arrays_zip("codes", "counts")).alias("e")).groupBy(F.col("e.codes").alias("code")).agg(F.sum("e.counts").alias("n"))
    return each.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.col("code") % base)))


def _scored(block: pa.Table, sums: pa.Table) -> pa.Table:
    """Texts of one block, from the sums of its pairs."""
    code, n, best = (sums.column(c).to_numpy() for c in ("code", "n", "best"))
    order = np.argsort(code)
    values = lambda c: block.column(c).combine_chunks().flatten()
    at = order[np.searchsorted(code[order], values("codes").to_numpy())] if len(code) else np.zeros(0, np.int64)
    place, times, sizes = (values(c).to_numpy() for c in ("places", "times", "sizes"))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    add = lambda x: np.diff(np.concatenate(([0], np.cumsum(x * times.astype(np.int64))))[ends]) if len(place) else np.zeros(len(sizes), np.int64)
    own = at[place] if len(place) else place
    cols = {c: values(c) for c in STATS} | {"n_best": add(best[own].astype(np.int64)), "count_sum": add(n[own]), "groups_sha256": values("groups_sha256")}
    return pa.table(cols)


def align(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, size: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    files = default_files()
    a_file, b_file = a_file or files[0], b_file or files[1]
    blocked = materialise(blocks(docs, a_file, b_file, size).withColumn("block", F.monotonically_increasing_id()), **ROWS)
    base = sentencepiece.SentencePieceProcessor(model_file=b_file).vocab_size()
    sums = materialise(pair_counts(blocked, base))
    own = blocked.select(F.col("block").alias("of"), F.explode("codes").alias("code")).join(sums, "code")
    texts = blocked.drop("counts")
    return texts.groupBy("block").cogroup(own.groupBy("of")).applyInArrow(_scored, OUT)
