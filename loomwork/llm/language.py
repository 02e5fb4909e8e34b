"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the
sum over all its segmentations into pieces (forward algorithm); a text's is the product over its words
(cut at white space, a space mark in front), whatever their length: words of up to MATRIX code points are
summed side by side, longer ones one by one in logarithms. Probabilities come from expectation-maximisation
over the words of about TRAIN_ROWS labelled rows, of which each language has CLASS_ROWS at least, or all it has.
Texts that are null or without a letter get ``und`` and score 0; equal likelihoods go to the language
that sorts first. Without labelled rows every text is ``und``. A null doc_id is held out of nothing: its
held_out is false, and it isn't learned from. Rows with equal doc_id are judged one by one; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import arrow_rows, in_class_sample, slices

SPACE = "▁"
LETTER = regex.compile(r"\p{L}")
#: Code points of words whose likelihoods, as products, stay within a float.
MATRIX = 32
#: About how many labelled rows the probabilities are learned from, at most.
TRAIN_ROWS = 6000
ROUNDS = 2
SMOOTH = 0.05
#: Likelihood of a character that no piece covers.
UNKNOWN = 1e-7
CACHE = 500_000
FOLDS = 5
K = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary as hashes of code points, by length."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.n = sp.vocab_size()
        usable: dict[int, list[tuple[str, int]]] = {}
        for i in range(self.n):
            p = sp.id_to_piece(i)
            if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)) and (p.strip(SPACE) or p == SPACE):
                usable.setdefault(len(p), []).append((p, i))
        self.by, self.longest = {}, max(usable)
        for size, found in usable.items():
            cp = np.frombuffer("".join(p for p, _ in found).encode("utf-32-le"), np.uint32).reshape(len(found), size).astype(np.uint64)
            h = self.hashes(cp, size)[:, 0]
            order = np.argsort(h)
            self.by[size] = (h[order], np.array([i for _, i in found], np.int32)[order])

    @staticmethod
    def hashes(cp: np.ndarray, n: int) -> np.ndarray:
        """Of every run of n code points in each row."""
        h = np.zeros((cp.shape[0], max(0, cp.shape[1] - n + 1)), np.uint64)
        for k in range(n):
            h = (h ^ cp[:, k : k + h.shape[1]]) * K
            h ^= h >> np.uint64(29)
        return h

    def ids(self, cp: np.ndarray) -> list[np.ndarray]:
        """For each length, the piece at each start, n if there is none."""
        out = []
        for n in range(1, min(self.longest, cp.shape[1]) + 1):
            if n not in self.by:
                out.append(np.full((cp.shape[0], cp.shape[1] - n + 1), self.n, np.int32))
                continue
            keys, ids = self.by[n]
            h = self.hashes(cp, n)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            out.append(np.where(keys[at] == h, ids[at], self.n))
        return out


def words_of(text: str) -> list[str]:
    """Words with the space mark."""
    return [SPACE + w for w in text.split()]


def _by_width(words: list[str]):
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(len(w), []).append(k)
    for width, ks in by.items():
        for some in ([ks] if width <= MATRIX else [[k] for k in ks]):
            cp = np.frombuffer("".join(words[k] for k in some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), width).astype(np.uint64)
            yield np.array(some), cp


def _forward(ids: list[np.ndarray], p: np.ndarray, width: int) -> np.ndarray:
    """alpha[row, end, language]; p has a last row for no piece."""
    m = ids[0].shape[0]
    alpha = np.zeros((m, width + 1, p.shape[1]))
    alpha[:, 0] = 1.0
    for e in range(1, width + 1):
        total = alpha[:, e - 1] * np.maximum(p[ids[0][:, e - 1]], UNKNOWN)
        for n in range(2, min(e, len(ids)) + 1):
            total += alpha[:, e - n] * p[ids[n - 1][:, e - n]]
        alpha[:, e] = total
    return alpha


def _log_chances(ids: list[np.ndarray], p: np.ndarray) -> list[np.ndarray]:
    """[length - 1][start, language] of one word, as logarithms."""
    with np.errstate(divide="ignore"):
        return [np.log(np.maximum(p[at[0]], UNKNOWN if n == 0 else 0.0)) for n, at in enumerate(ids)]


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def _log_forward(chances: list[np.ndarray], width: int, keep: bool) -> np.ndarray:
    """Logarithms of what _forward() sums, for one word of any length: all ends, or the last one only."""
    n = len(chances)
    last = np.full((n, chances[0].shape[1]), -np.inf)  # of the n ends before, the nearest first
    last[0] = 0.0
    kept = [last[0].copy()] if keep else None
    for e in range(1, width + 1):
        here = _log_sum(np.stack([last[k] + chances[k][e - 1 - k] for k in range(min(e, n))]))
        last[1:] = last[:-1]
        last[0] = here
        if keep:
            kept.append(here)
    return np.array(kept) if keep else last[0].copy()


def likelihoods(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log likelihood of each word in each language."""
    out = np.zeros((len(words), p.shape[1]))
    for ks, cp in _by_width(words):
        if cp.shape[1] > MATRIX:
            out[ks] = _log_forward(_log_chances(pieces.ids(cp), p), cp.shape[1], keep=False)
        else:
            out[ks] = np.log(np.maximum(_forward(pieces.ids(cp), p, cp.shape[1])[:, -1], 1e-300))
    return out


def _log_uses(ids: list[np.ndarray], counts: np.ndarray, p: np.ndarray, width: int, out: np.ndarray) -> None:
    """expected() for one word of any length."""
    chances = _log_chances(ids, p)
    alpha = _log_forward(chances, width, keep=True)
    # Backwards is forwards over the word turned round, whose piece of a length starts where it ended.
    beta = _log_forward([c[::-1] for c in chances], width, keep=True)[::-1]
    for k, (at, c) in enumerate(zip(ids, chances, strict=True)):
        with np.errstate(divide="ignore"):
            known = np.log(p[at[0]])  # a character without a piece is nobody's use
        np.add.at(out, at[0], np.exp(alpha[: width - k] + np.minimum(known, c) + beta[k + 1 :] - alpha[width]) * counts)


def expected(words: list[str], counts: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language; counts[word, language]."""
    out = np.zeros((pieces.n + 1, p.shape[1]))
    for ks, cp in _by_width(words):
        width, ids = cp.shape[1], pieces.ids(cp)
        if width > MATRIX:
            _log_uses(ids, counts[ks[0]], p, width, out)
            continue
        alpha = _forward(ids, p, width)
        beta = np.zeros_like(alpha)
        beta[:, width] = 1.0
        for s in range(width - 1, -1, -1):
            beta[:, s] = beta[:, s + 1] * np.maximum(p[ids[0][:, s]], UNKNOWN)
            for n in range(2, min(width - s, len(ids)) + 1):
                beta[:, s] += beta[:, s + n] * p[ids[n - 1][:, s]]
        share = counts[ks] / np.maximum(alpha[:, width], 1e-300)
        for n, at in enumerate(ids, 1):
            for s in range(width - n + 1):
                np.add.at(out, at[:, s], alpha[:, s] * p[at[:, s]] * beta[:, s + n] * share)
    return out[:-1]


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, vocabulary: str | None = None, rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and piece probabilities [piece, language] with a last row of zeros.

    What comes to the driver is at most (vocabulary size) x (languages) sums a round."""
    path = vocabulary or default_vocabulary()
    usable = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    counts = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    sample = usable.where(in_class_sample("doc_id", "lang", counts, rows)).select("lang", "text")
    langs = sorted(counts)
    n = Pieces(path).n
    if not langs:
        return [], np.zeros((n + 1, 0))
    prior = np.full((n + 1, len(langs)), 1.0 / n)
    prior[-1] = 0.0
    schema = pa.schema([("piece", pa.int32()), ("lang", pa.int32()), ("uses", pa.float64())])
    for _ in range(rounds):
        held = docs.sparkSession.sparkContext.broadcast(prior)

        def run(batches, held=held):
            pieces, counts = Pieces(path), {}
            for batch in batches:
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    k = langs.index(lang)
                    for w in words_of(text):
                        if w not in counts:
                            counts[w] = [0] * len(langs)
                        counts[w][k] += 1
            if counts:
                words = list(counts)
                uses = expected(words, np.array([counts[w] for w in words], float), pieces, held.value)
                at, lang = np.nonzero(uses)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(uses[at, lang])], schema=schema)

        got = sample.mapInArrow(run, "piece int, lang int, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.zeros((n + 1, len(langs)))
        uses[got.piece.to_numpy(), got.lang.to_numpy()] = got.uses.to_numpy()
        prior = (uses + SMOOTH) / (uses + SMOOTH).sum(axis=0)
        prior[-1] = 0.0
    return langs, np.round(prior, 15)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and the score of the prediction; only the text is used."""
    path, langs = vocabulary or default_vocabulary(), model[0]
    held = docs.sparkSession.sparkContext.broadcast(model[1])
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        pieces, p = Pieces(path), held.value
        known: dict[str, int] = {}
        table = np.zeros((0, len(langs)))

        def of(batch):
            nonlocal known, table
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lists = [words_of(t) if langs and LETTER.search(t) else [] for t in texts]
            if len(known) > CACHE:
                known, table = {}, table[:0]
            new = list({w for ws in lists for w in ws} - known.keys())
            if new:
                for k, w in enumerate(new, len(known)):
                    known[w] = k
                table = np.concatenate((table, likelihoods(new, pieces, p)))
            pred, score = [], []
            for ws, text in zip(lists, texts, strict=True):
                if not ws:
                    pred.append("und")
                    score.append(0.0)
                    continue
                total = table[[known[w] for w in ws]].sum(axis=0)
                best = int(total.argmax())
                # Evidence is tempered: words of one text are not independent.
                share = np.exp((total - total[best]) / max(1.0, len(ws) ** 0.5))
                pred.append(langs[best])
                score.append(float(1.0 / share.sum()))
            return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pred, "score": score}

        for batch in batches:
            yield from arrow_rows(schema, of)(slices(batch, 512))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
