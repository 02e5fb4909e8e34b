"""Spelling variants, document fingerprints and tokenizer alignment against brute force, and on odd inputs."""

import collections
import glob
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from loomwork.llm import alignment, minhash, queries, variants

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "word", "a▁b c", "x" * 5000, "same text here " * 60, "same text here " * 60, "ÀB çd " * 300, "a b c d e f g h"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "s", 0) for k, t in enumerate(ODD)] + [(3, "word", None, None), (3, "word", None, None), (3, "other words", None, None), (None, "no id at all", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n long").selectExpr("*", "'clash' as word", "1 as block", "2 as place", "'x' as next_key")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# 11


def one_edit(word):
    letters = sorted(set("abcdefghijklmnopqrstuvwxyz") | set(word))
    cuts = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}


def brute_variants(rows, min_chars=6, min_count=5):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}
    letters = sorted({c for w in n for c in w})
    by_gap = collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            by_gap[w[:k], w[k + 1 :]].add(w)
    assert letters
    near = {w: set() for w in n}
    for (a, b), group in by_gap.items():
        for u in group:
            near[u] |= group
            if a + b in n:
                near[u].add(a + b)
                near[a + b].add(u)
    form = {}
    for w in n:
        near[w].discard(w)
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("limit", [variants.GROUP, 3])
def test_variants_match_brute_force(spark, docs, limit):
    """With groups of at most three words, all larger ones are cut down to windows of one letter."""
    got = variants.variants(docs, limit=limit).select("word", "form", "root", "n", "n_near", "form_n")
    want = brute_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, got.collect())) == want
    assert sum(r[1] is not None for r in want) > 10 and sum(r[4] > 1 for r in want) > 20


@pytest.mark.parametrize("limit", [variants.GROUP, 2])
def test_variants_of_few_letters(spark, limit):
    """Words over few letters have repeated letters everywhere and are near to many others."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abé", k=rng.randint(4, 9))) for _ in range(400)]
    rows = [(k, " ".join(rng.choices(words, [1 + 40 * (j % 17 == 0) for j in range(400)], k=200))) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = variants.variants(df, 4, 2, limit=limit).select("word", "form", "root", "n", "n_near", "form_n")
    want = brute_variants(rows, 4, 2)
    assert sorted(map(tuple, got.collect())) == want and any(r[2] != (r[1] or r[0]) for r in want)


def test_variants_odd_rows(spark, odd):
    got = variants.variants(odd).collect()
    assert {r.word: r.n for r in got} == {}
    assert variants.variants(odd.where("false")).count() == 0
    long_words = spark.createDataFrame([(k, "y" * (3000 + k % 2)) for k in range(20)] + [(99, None)], "doc_id long, text string")
    assert [(len(r.word), r.n_near) for r in variants.variants(long_words).orderBy("word").collect()] == [(3000, 1), (3001, 1)]


# 12


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    least = {}
    for k in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[k : k + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        signed = h - 2**64 if h >= 2**63 else h
        least[h >> 57] = min(least.get(h >> 57, 2**63), signed)
    if not least:
        return ()
    return tuple(least[next(j for j in ([i] if i in least else order) if j in least)] & 255 for i, order in enumerate(minhash.probes()))


def brute_likeness(a, b):
    if not a or not b:
        return float(a == b)
    return max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / 128 - 1 / 256) / (1 - 1 / 256))


def brute_pairs(rows):
    texts = {(d, t or "") for d, t in rows}
    order = sorted(texts, key=lambda r: (r[0] is not None, -(r[0] or 0), hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest()))
    out = {}
    for k, (d, t) in enumerate(order):
        follower = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + follower[:half]
        f, e, n = map(brute_fingerprint, (t, edited, follower))
        out[d, t] = (d, len(t), hashlib.sha256(edited.encode()).hexdigest(), bytes(f).hex(), bytes(e).hex(), round(brute_likeness(f, e), 9), round(brute_likeness(f, n), 9))
    return collections.Counter(out[d, t or ""] for d, t in rows)


def test_fingerprints_match_brute_force(docs, odd):
    for df in (docs, odd, odd.limit(1)):
        got = collections.Counter((*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in minhash.edited_pairs(df).collect())
        assert got == brute_pairs([(r.doc_id, r.text) for r in df.collect()])
    assert minhash.edited_pairs(odd.where("false")).count() == 0


def test_likeness_is_near_the_true_share(spark):
    rng, errors = random.Random(8), []
    for _ in range(60):
        words = [str(rng.random()) for _ in range(rng.choice([60, 400, 2000]))]
        cut = rng.randint(0, len(words))
        other = words[:cut] + [str(rng.random()) for _ in range(len(words) - cut)]
        grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        a, b = grams(words), grams(other)
        errors.append(brute_likeness(brute_fingerprint(" ".join(words)), brute_fingerprint(" ".join(other))) - len(a & b) / len(a | b))
    assert np.mean(np.abs(errors)) < 0.06 and abs(np.mean(errors)) < 0.03


def test_fingerprints_use_no_python(docs):
    plan = minhash.edited_pairs(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


def test_fingerprints_of_copies(spark):
    rows = [(1, "same words in every copy here")] * 9000 + [(2, "a b c")]
    got = minhash.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("doc_id").count().collect()
    assert {tuple(r) for r in got} == {(1, 9000), (2, 1)}


# 13


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*alignment.default_files())


def brute_alignment(aligner, text):
    """Both tokenizers on the whole text, and all pairs of tokens; None without tokens."""
    if not text:
        return None
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    parts = [[aligner.a_bytes[k] for k in a], [aligner.b_bytes[k] for k in b]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    ea, eb = ([0, *itertools.accumulate(map(len, p))] for p in parts)
    links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if max(ea[i], eb[j]) < min(ea[i + 1], eb[j + 1])]
    cuts = sorted(set(ea) & set(eb))
    groups = [",".join(map(str, a[ea.index(x) : ea.index(y)])) + "|" + ",".join(map(str, b[eb.index(x) : eb.index(y)])) for x, y in itertools.pairwise(cuts)]
    return len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def brute_rows(aligner, rows):
    found = [(d, brute_alignment(aligner, t)) for d, t in rows]
    n = collections.Counter(x for _, f in found if f for x in f[3])
    best = {}
    for (_, b), k in n.items():
        best[b] = max(best.get(b, 0), k)
    return collections.Counter((d, f[0], f[1], f[2], len(f[3]), sum(n[x] == best[x[1]] for x in f[3]), sum(n[x] for x in f[3]), f[4]) if f else (d, 0, 0, 0, 0, 0, 0, "") for d, f in found)


STRANGE = ["a", "the ", "Hello", " ", "  ", "\n", "\t", "\r", "\r\n", "é", "日本", "😀", "👩‍🚀", "\x00", "\x85", "\xa0", " ", "▁", "<|endoftext|>", "<s>", "<0x41>", "'s", "123", "}\r", "\x1c", "𐍈", "ق", "don't", "x" * 30, ".", "﻿", "é"]


def test_alignment_matches_brute_force(spark, docs, odd, aligner, monkeypatch):
    rng = random.Random(5)
    strange = spark.createDataFrame([(k, "".join(rng.choices(STRANGE, k=rng.randint(0, 14)))) for k in range(2000)], "doc_id long, text string")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for df, size in ((strange, 1000), (odd, 1), (docs.where("n_chars < 3000").select("doc_id", "text"), 20_000)):
        got = collections.Counter(map(tuple, alignment.align(df, size=size).select(*columns).collect()))
        assert got == brute_rows(aligner, [(r.doc_id, r.text) for r in df.collect()])
    assert alignment.align(odd.where("false")).count() == 0


def test_alignment_blocks_are_read_in_small_groups(spark, monkeypatch):
    """Blocks are wide rows, and Spark decodes a row group at once: no group holds more than a few."""
    tables = []
    monkeypatch.setattr(alignment, "materialise", lambda df, keep=alignment.materialise, **o: tables.append(keep(df, **o)) or tables[-1])
    texts = spark.range(100).selectExpr("id as doc_id", "concat('tide and harbour ', id) as text").coalesce(1)
    assert alignment.align(texts, size=1).count() == 100
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tables[0].written_path.removeprefix('file:')}/*.parquet")]
    groups = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(groups) == 100 and max(groups) <= 8


def test_alignment_in_parts(aligner, monkeypatch):
    """A text is aligned alike whole and in parts."""
    text = " ".join(random.Random(6).choices(["tide", "harbour,", "café\n", "😀😀", "12.5", "日本語"], k=3000))
    whole = next(iter(aligner.texts([text])))
    monkeypatch.setattr(alignment, "BLOCK", 100)
    monkeypatch.setattr(alignment, "TOGETHER", 64)
    parts = next(iter(aligner.texts([text])))
    assert whole[1] == parts[1] and all((np.asarray(x) == np.asarray(y)).all() for x, y in zip((whole[0], *whole[2:]), (parts[0], *parts[2:]), strict=True))


@pytest.mark.parametrize("name", ["op11_variants", "op12_minhash", "op13_alignment"])
def test_queries_run_on_whole_tables(spark, docs, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.count() > 50 and (name == "op11_variants" or got.count() == docs.count())
