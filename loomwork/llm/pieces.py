"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies by a score-ordered agenda.

A text is cut into chunks (a run of blanks and what follows up to the next blank, line feeds alone);
no piece of the vocabulary crosses such a cut, so chunks can be merged one by one and remembered.
Within a chunk the agenda always joins the adjacent pair of symbols with the best score, the leftmost
one of equals. Many chunks are merged side by side as rows of one matrix; long ones by a heap. The result
is the agenda's. Each new chunk of an Arrow batch is also encoded by the sentencepiece library, and
n_mismatches counts a text's chunks for which the library has other ids; they change nothing else. Null
texts are empty: one end id. Rows with equal doc_id stay separate, further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_rows, slices

SPACE = "▁"
CHUNK = re.compile(r"\n| +[^ \n]*|[^ \n]+")
BIG = np.int32(2**30)
WIDTHS = (6, 9, 12, 16, 24, 40)
CACHE = 450_000
SLOT_BITS = 20

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_mismatches", pa.int64())])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Agenda:
    """Merges symbols of chunks in the order of their pieces' scores."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.n = n = sp.vocab_size()
        normal = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal):
            raise ValueError("pieces of this vocabulary cross blanks; chunks can't be merged alone")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        symbol = dict(normal)
        for p in normal:
            for c in p:
                symbol.setdefault(c, len(symbol) + n)  # a character without a piece of its own
        self.base = n + len(symbol) + 1
        levels = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in normal.values()}, reverse=True))}
        pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    pairs[symbol[p[:k]] * self.base + symbol[p[k:]]] = (levels[sp.get_score(i)], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()] + [BIG], np.int32)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], np.int32)
        self._fill()
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                self.char[ord(p)] = i

    def _fill(self) -> None:
        """Pair keys in a table of slots; what doesn't fit its slot goes to the next table."""
        self.tables = []
        left = np.arange(len(self.keys))
        for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5):
            slots = np.full(1 << SLOT_BITS, len(self.keys), np.int32)
            at = self._slot(self.keys[left], seed)
            slots[at] = left
            self.tables.append((seed, slots))
            left = left[slots[at] != left]
            if not len(left):
                break
        else:
            raise ValueError("the vocabulary has too many pairs for its table")
        self.keys = np.append(self.keys, np.int64(-1))

    @staticmethod
    def _slot(key, seed):
        return ((key.view(np.uint64) * np.uint64(seed)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def _look(self, left, right):
        """Where the pair is in the table of pairs; the last place means nowhere."""
        key = left.astype(np.int64) * self.base + right
        key[(left < 0) | (right < 0)] = -2
        at = self.tables[0][1].take(self._slot(key, self.tables[0][0]))
        miss = np.flatnonzero(self.keys.take(at) != key)
        for seed, slots in self.tables[1:]:
            again = key.take(miss)
            found = slots.take(self._slot(again, seed))
            at[miss] = found
            miss = miss[self.keys.take(found) != again]
        at[miss] = len(self.keys) - 1
        return at

    def _ids(self, symbols, chars) -> tuple[int, ...]:
        """Symbols without a piece become the bytes of their character."""
        return tuple(x for s, c in zip(symbols, chars, strict=True) for x in ((s,) if 0 <= s < self.n else (self.bytes[b] for b in c.encode())))

    def _long(self, chunk: str) -> tuple[int, ...]:
        """The same agenda as a heap, for one chunk of any length."""
        sym = [int(self.char[ord(c)]) for c in chunk]
        nxt, prv = [*range(1, len(sym) + 1)], [*range(-1, len(sym) - 1)]
        heap: list = []

        def offer(a, b):
            if a >= 0 and b < len(sym) and sym[a] >= 0 and sym[b] >= 0 and (hit := self.pairs.get(sym[a] * self.base + sym[b])):
                heapq.heappush(heap, (hit[0], a, sym[a], b, sym[b], hit[1]))

        for a in range(len(sym) - 1):
            offer(a, a + 1)
        dead = bytearray(len(sym))
        while heap:
            _, a, sa, b, sb, made = heapq.heappop(heap)
            if dead[a] or dead[b] or sym[a] != sa or sym[b] != sb or nxt[a] != b:
                continue
            sym[a], dead[b], nxt[a] = made, 1, nxt[b]
            if nxt[b] < len(sym):
                prv[nxt[b]] = a
            offer(prv[a], a)
            offer(a, nxt[a])
        alive = [a for a in range(len(sym)) if not dead[a]]
        return self._ids([sym[a] for a in alive], [chunk[a] for a in alive])

    def _rows(self, chunks: list[str], width: int) -> list[tuple[int, ...]]:
        m = len(chunks)
        size = np.fromiter(map(len, chunks), np.int64, m)
        cp = np.frombuffer("".join(c.ljust(width, "\0") for c in chunks).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, width)
        col = np.arange(width)
        inside = col[None, :] < size[:, None]
        sym = np.where(inside, self.char[cp], -1).astype(np.int32)
        odd = ((sym < 0) | (sym >= self.n)) & inside
        pair = np.full((m, width), len(self.keys) - 1, np.int32)
        pair[:, :-1] = self._look(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(m, width - 1)
        rank = self.rank[pair]
        nxt = np.broadcast_to(col + 1, (m, width)).ravel().astype(np.int16)
        prv = np.broadcast_to(col - 1, (m, width)).ravel().astype(np.int16)
        alive = inside.copy()
        # Flat views; a row's first place is start, and places of a row count from there.
        s, p, r, live = sym.reshape(-1), pair.reshape(-1), rank.reshape(-1), alive.reshape(-1)
        rows = np.flatnonzero(rank.min(axis=1) < BIG)
        while len(rows):
            start = rows * width
            best = rank[rows].argmin(axis=1)
            here = start + best
            other = start + nxt.take(here)
            after = nxt.take(other)
            joined = self.made.take(p.take(here))
            s[here] = joined
            live[other] = False
            nxt[here] = after
            r[other] = BIG
            ok = np.flatnonzero(after < width)
            prv[start[ok] + after[ok]] = best[ok]
            there = np.full(len(rows), -1, np.int32)
            there[ok] = s.take(start[ok] + after[ok])
            found = self._look(joined, there)
            p[here], r[here] = found, self.rank.take(found)
            before = prv.take(here)
            ok = np.flatnonzero(before >= 0)
            left = start[ok] + before[ok]
            found = self._look(s.take(left), joined[ok])
            p[left], r[left] = found, self.rank.take(found)
            rows = rows[rank[rows].min(axis=1) < BIG]
        ends = np.cumsum(alive.sum(axis=1)).tolist()
        flat = sym[alive].tolist()
        out, start = [], 0
        strange = odd.any(axis=1).tolist()
        for k, end in enumerate(ends):
            if strange[k]:
                keep = np.flatnonzero(alive[k]).tolist()
                out.append(self._ids(flat[start:end], [chunks[k][a] for a in keep]))
            else:
                out.append(tuple(flat[start:end]))
            start = end
        return out

    def encode(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """Ids of chunks in which blanks are already the space mark."""
        by: dict[int, list[int]] = {}
        for k, c in enumerate(chunks):
            by.setdefault(next((w for w in WIDTHS if len(c) <= w), 0), []).append(k)
        out: list = [()] * len(chunks)
        for width, ks in by.items():
            part = [chunks[k] for k in ks]
            for k, ids in zip(ks, self._rows(part, width) if width else map(self._long, part), strict=True):
                out[k] = ids
        return out

    def differing(self, chunks: list[str], ids: list[tuple[int, ...]]) -> list[bool]:
        """Whether the library has other ids for each chunk. It puts a space mark before a text: the mark is
        taken off chunks that begin with one, and a line feed, which joins with nothing, shields the rest."""
        asked = [c[1:] if c[0] == SPACE and len(c) > 1 else "\n" + c for c in chunks]
        shielded = [a[0] == "\n" and a[1:] == c for a, c in zip(asked, chunks, strict=True)]
        return [tuple(got[2:] if cut else got) != own for got, cut, own in zip(self.library.encode(asked, num_threads=1), shielded, ids, strict=True)]


def chunks_of(text: str) -> list[str]:
    """Cuts of the text as the library sees it: the space mark is a blank, one blank is put in front."""
    return CHUNK.findall(" " + text.replace(SPACE, " ")) if text else []


def encode_batches(batches, path: str, checked: bool):
    """Batches of doc_id and text -> batches of SCHEMA."""
    agenda = Agenda(path)
    end = agenda.library.eos_id()
    known: dict[str, tuple[tuple[int, ...], str, int]] = {}

    def of(batch):
        nonlocal known
        lists = [chunks_of(t or "") for t in batch.column("text").to_pylist()]
        if len(known) > CACHE:
            known = {}
        new = list({c for chunks in lists for c in chunks} - known.keys())
        asked = [c.replace(" ", SPACE) for c in new]
        ids = agenda.encode(asked)
        differs = agenda.differing(asked, ids) if checked and asked else [False] * len(ids)
        for c, x, other in zip(new, ids, differs, strict=True):
            known[c] = (x, " ".join(map(str, x)), int(other))
        all_ids, out = [], {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "n_mismatches": []}
        for chunks in lists:
            found = [known[c] for c in chunks]
            own: list[int] = []
            for x in found:
                own += x[0]
            own.append(end)
            all_ids.append(own)
            out["n_tokens"].append(len(own))
            out["ids_sha256"].append(hashlib.sha256(" ".join([x[1] for x in found] + [str(end)]).encode()).hexdigest())
            out["n_mismatches"].append(sum([x[2] for x in found]))
        out["decoded_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in agenda.library.decode(all_ids, num_threads=1)] if all_ids else []
        return out

    for batch in batches:
        yield from arrow_rows(SCHEMA, of)(slices(batch, 512))


def encode_decode(docs: DataFrame, model_file: str | None = None, checked: bool = True) -> DataFrame:
    """doc_id, number of ids with the end id, and digests of the ids and of the decoded text."""
    path = model_file or default_model()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: encode_batches(batches, path, checked), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_mismatches long")
