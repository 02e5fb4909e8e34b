"""The training-data operators against brute force, round trips and held-out rows, and on odd inputs."""

import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import chat, decontaminate, language, lmscore, pieces, pii, quality, queries, repeats, simhash, urls

SF = "/root/testdata/sf0.01"
ODD = [None, "", " \n\t", "word", "a\u2581b  c\n\n\x00 é́ 😀", "x" * 5000, "same text here " * 60, "same text here " * 60, "ÀB çd " * 300]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(ODD)] + [(3, "word", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumn("kept", F.lit("clash")).withColumn("tie", F.lit("clash")).withColumn("fp", F.lit(1))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1


def brute_quality(text):
    text = text or ""
    w = words(text)
    n = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_quality_counts(docs, odd, labels):
    for df in (docs, odd):
        got = quality.judge(df, None)
        texts = collections.defaultdict(list)
        for r in df.collect():
            texts[r.doc_id].append(brute_quality(r.text))
        for r in got.collect():
            assert tuple(r)[1:7] in texts[r.doc_id]
            assert r.kept is (not r.base_failed) and r.quality_prob is None


def test_quality_features_in_stretches(monkeypatch):
    """Features, margins and counts of a text don't depend on the stretches in which it is hashed."""
    import numpy as np

    rng = random.Random(1)
    text = " ".join(rng.choice(["the", "word", "é", "x" * 50, "a,b"]) for _ in range(3000)).encode()
    model = quality.logistic.LogisticModel(np.random.default_rng(0).normal(size=2 * quality.DIMS), 0.3)
    ids, seen = quality.word_ids(quality.split_words(text))
    whole, margin = quality.features(text), quality.margin_of(model, text, ids, seen)
    assert margin == pytest.approx(0.3 + float((model.weights[whole[0]] * whole[1]).sum()))
    monkeypatch.setattr(quality, "STRETCH", 97)
    parts = quality.features(text)
    assert np.array_equal(whole[0], parts[0]) and np.allclose(whole[1], parts[1])
    assert quality.margin_of(model, text, ids, seen) == pytest.approx(margin)
    n = len(text) - 2
    plain = collections.Counter(text[k : k + m] for m in (3, 4, 5) for k in range(len(text) - m + 1))
    chars = whole[1][whole[0] >= quality.DIMS]
    assert chars.sum() == pytest.approx(quality.SCALE) and len(chars) <= len(plain) and sum(plain.values()) == 3 * n - 3


def test_quality_of_a_very_long_text():
    import tracemalloc

    import pyarrow as pa

    text = ("a b c " * 5000 + "\n") * 200
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
    import numpy as np

    model = quality.logistic.LogisticModel(np.zeros(2 * quality.DIMS), 0.0)
    tracemalloc.start()
    quality._rows(batch, model, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * len(text)


def test_quality_training_on_one_repeated_document(spark):
    """Many rows of one doc_id, different or equal, neither crowd the driver nor drop a class."""
    spam = spark.range(20_000).selectExpr("7 as doc_id", "concat('buy now ', cast(id % 15000 as string)) as text")
    rest = spark.createDataFrame([(k, f"a quiet walk along the river number {k}") for k in range(100, 140)], "doc_id int, text string")
    marks = spark.createDataFrame([(7, 0)] + [(k, 1) for k in range(100, 140)], "doc_id int, quality int")
    model = quality.train(spam.unionByName(rest), marks, rows=300)
    p = {r.doc_id: r.quality_prob for r in quality.judge(spam.limit(1).unionByName(rest), model).collect()}
    assert p[7] < 0.5 < min(v for k, v in p.items() if k != 7)


def test_quality_training_is_bounded_in_bytes(docs, labels, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_BYTES", 1 << 20)
    seen = []
    monkeypatch.setattr(quality.logistic, "fit", lambda rows, dims: seen.append(sum(8 * len(at) for _, at, _ in rows)))
    quality.train(docs, labels)
    assert 0 < seen[0] < 1.5 * (1 << 20)


def test_quality_model(docs, labels, empty):
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = sum((got[d].quality_prob >= quality.KEEP_AT) == bool(q) for d, q in truth.items() if got[d].n_words >= 50)
    assert right >= 0.95 * sum(got[d].n_words >= 50 for d in truth)
    assert quality.train(docs, labels.where("quality = 1")) is None
    assert quality.judge(empty, model).count() == 0 and quality.train(empty, labels) is None
    assert quality.keep(docs, model).count() == sum(r.kept for r in got.values())


# 2


def brute_components(fps):
    u = [x & (2**64 - 1) for x in fps]
    up = list(range(len(u)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(u)):
        for b in range(a):
            if (u[a] ^ u[b]).bit_count() <= 3:
                up[find(a)] = find(b)
    least = {}
    for k, x in enumerate(fps):
        least[find(k)] = min(least.get(find(k), x), x)
    return {x: least[find(k)] for k, x in enumerate(fps)}


def test_simhash_sets():
    for n, least, most in ((4, 0, 1), (5, 2, 2), (6, 6, 6)):
        held = [sum(set(s) <= set(some) for s in simhash.SETS) for some in itertools.combinations(range(8), n)]
        assert (min(held), max(held)) == (least, most)


@pytest.mark.parametrize("heavy", [1000, 20])
def test_simhash_links(spark, heavy):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = {*base}
    for b in base * 12:
        for k in rng.sample(range(64), rng.randint(1, 4)):
            b ^= 1 << k
        fps.add(b)
    for _ in range(120):
        b = base[0]
        for k in rng.sample(range(30), rng.randint(1, 3)):
            b ^= 1 << k
        fps.add(b)
    fps = [simhash._signed(x) for x in fps]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.node: r.label for r in simhash.components(simhash.links(df, heavy)).collect()}
    assert {x: got.get(x, x) for x in fps} == brute_components(fps)


def test_simhash_fingerprints(spark, docs, monkeypatch):
    """Every fingerprint against Spark's own XXH64 of the shingles."""
    rows = [(r.doc_id, re.sub("[A-Z]+", lambda m: m[0].lower(), r.text or "")) for r in docs.collect()]
    grams = []
    for d, text in rows:
        w = words(text)
        grams += [(d, " ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))] if w else []
    hashed = spark.createDataFrame(grams, "doc_id long, g string").select("doc_id", F.xxhash64("g").alias("h"))
    bits = hashed.groupBy("doc_id").agg(*[(F.sum(F.getbit("h", F.lit(b))) * 2 > F.count("*")).alias(f"b{b}") for b in range(64)])
    want = {r.doc_id: sum(1 << b for b in range(64) if r[f"b{b}"]) for r in bits.collect()}
    for stretch in (simhash.STRETCH, 7):
        monkeypatch.setattr(simhash, "STRETCH", stretch)
        assert {d: simhash.fingerprint(text) & (2**64 - 1) for d, text in rows} == {d: want.get(d, 0) for d, _ in rows}


@pytest.mark.parametrize("heavy", [300, 3])
def test_simhash_documents(spark, docs, odd, empty, heavy):
    rows = [(r.doc_id, simhash.fingerprint(r.text)) for r in docs.collect()]
    classes = brute_components([x for _, x in rows])
    least = {}
    for d, x in rows:
        least[classes[x]] = min(least.get(classes[x], d), d)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, heavy).collect()}
    assert got == {d: (f"{x & (2**64 - 1):016x}", least[classes[x]]) for d, x in rows}
    assert {r.doc_id for r in simhash.keep_first(docs, heavy).collect()} == set(least.values())
    got = simhash.near_duplicates(odd, heavy).collect()
    assert len(got) == len(ODD) + 1
    by = {r.doc_id: r for r in got}
    assert by[0].fingerprint == by[2].fingerprint == "0" * 16 and by[2].component_id == 0
    assert by[7].component_id == 6
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_first(empty).count() == 0


def test_simhash_keeps_one_row_of_each_class(spark):
    text, near = "a b c d e f g h " * 40, "quite another text " * 30
    rows = [(5, text), (5, text), (None, text), (None, "only here " * 9), (None, "only here " * 9), (9, near), (2, "third one " * 50), (9, text), (None, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Row", F.lit("clash")).withColumn("fp", F.lit(0))
    got = simhash.keep_first(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(5, text), (None, "only here " * 9), (9, near), (2, "third one " * 50), (3, "")], key=str)


# 3


def test_chat_layouts(spark):
    records = [
        (1, '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}'),
        (2, '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "extra": {"k": 1}}'),
        (3, '{"prompt": "a", "completion": "b"}'),
        (4, '{"system": "s", "instruction": "a", "input": "i", "output": "b"}'),
        (5, '{"unknown": 1}'),
        (6, "no json"),
        (7, None),
        (8, '{"prompt": "a", "response": null}'),
    ]
    df = spark.createDataFrame(records, "conv_id long, record string")
    got = collections.defaultdict(list)
    for r in chat.canonical_turns(df).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text))
    plain = [("user", "a"), ("assistant", "b")]
    assert got == {1: plain, 2: plain, 3: plain, 4: [("system", "s"), ("user", "a\n\ni"), ("assistant", "b")], 8: [("user", "a"), ("assistant", "")]}
    assert {r.layout: r["count"] for r in chat.layouts(df).collect()}[None] == 3


def test_chat_odd_records(spark):
    """Stray list members, contents in parts, odd turns, half surrogate pairs and deep nesting: no record ends the job."""
    deep = '{"a": ' * 50_000 + "1" + "}" * 50_000
    records = [
        (1, '{"messages": ["stray", null, 3, {"role": "user", "content": "a"}, []]}'),
        (2, '{"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "text": null}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c"}]}'),
        (3, deep),
        (4, "[" * 100_000),
        (5, '{"conv_id": 5, "turn": "one", "role": "user", "text": "a"}'),
        (6, '{"conv_id": 6, "turn": 99999999999999999999, "role": "user", "text": "\\ud800x"}'),
        (7, '{"messages": [[{"role": "user", "content": "a"}]]}'),
        (8, '{"messages": []}'),
        (9, '{"prompt": {"k": 1}, "completion": "b"}'),
        (10, '{"messages": {"role": "user", "content": "a"}}'),
        (None, '{"prompt": ["x", 1], "completion": true}'),
        (11, '{"messages": [{"role": ["user"], "content": {"text": "a"}}]}'),
    ]
    df = spark.createDataFrame(records, "conv_id long, record string")
    got = collections.defaultdict(list)
    for r in chat.canonical_turns(df).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.turn, r.role, r.text))
    assert got == {1: [(0, "user", "a")], 2: [(0, "user", "ab"), (1, "assistant", "c")], 5: [(None, "user", "a")], 6: [(None, "user", "?x")]}
    assert sum(r["count"] for r in chat.layouts(df).collect()) == len(records)


def test_chat_round_trip(spark):
    rng = random.Random(1)
    parts = ["\\", "###", "</turn>", "### User: ", "\n", "a", "<", "/turn>", "#", '"', "é😀"]
    turns = [(c, k, rng.choice(["user", "assistant", "system", "User", "to\nol", "", None]), rng.choice([None, ""] + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(9)])) for c in (None, 1, 2, 3) for k in range(30)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = chat.format_turns(df).collect()
    assert len(got) == 4
    for r in got:
        want = [(role or "", text or "") for c, _, role, text in turns if c == r.conv_id]
        assert chat.read_turns(r.formatted) == want
        assert [chat.unescape(r.formatted[s.start : s.end]) for s in r.loss_spans] == [t for role, t in want if role == "assistant"]
    assert chat.format_turns(df.where("false")).count() == 0


def test_chat_query(spark):
    by = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by[r.conv_id].append((r.role, r.text))
    by[-7] = [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]
    got = {r.conv_id: r for r in queries.op3_chat(spark, SF).collect()}
    assert got.keys() == by.keys()
    for c, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for role, t in turns)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_query_builds_no_whole_conversation(spark, monkeypatch):
    def whole(turns):
        raise AssertionError("a conversation's whole string is built")

    monkeypatch.setattr(chat, "format_turns", whole)
    assert queries.op3_chat(spark, "/root/testdata/sf0.001").count() > 0


def test_chat_digest_of_turns(spark):
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(8)
    parts = ["\\", "###", "</turn>", "### User: ", "\n", "a", "<", "é😀"]
    turns = [(c, k, rng.choice(["user", "assistant", "system", "to\nol", "", None]), rng.choice([None, "", "".join(rng.choices(parts, k=9))])) for c in (None, 1, 2) for k in range(40)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert sorted(map(str, chat.digest_turns(df).collect())) == sorted(map(str, chat.digest(chat.format_turns(df)).collect()))
    assert chat.digest_turns(df.where("false")).count() == 0
    text = "</turn> x" * 1000
    batch = pa.RecordBatch.from_pydict({"conv_id": [None] * 1000, "role": ["assistant"] * 1000, "text": [text] * 1000})
    tracemalloc.start()
    got = [r for b in chat.digest_rows(batch for _ in range(5)) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[0]["n_turns"], got[0]["loss_chars"]) == (5000, 5000 * len(text)) and len(got) == 1
    assert peak < 10_000_000


# 4


def brute_align(a, b):
    best = 0
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment():
    import numpy as np

    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 25))] for _ in range(2))
        assert decontaminate.align(np.array(a), np.array(b))[0] == brute_align(a, b)


def test_decontamination(spark, odd, empty):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items = [[word() for _ in range(30)] for _ in range(8)]
    texts, want = [], set()
    for d in range(60):
        body = [word() for _ in range(200)]
        if d % 3 == 0:
            k = d % 8
            copy = [w if rng.random() > 0.12 else word() for w in items[k]]
            at = rng.randrange(200)
            body[at:at] = copy
            want.add((d, k))
        texts.append((d, " ".join(body)))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(98, None), (99, "two words")], "item_id long, text string")
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == want
    decontaminate.MAX_SENT, old = 0, decontaminate.MAX_SENT
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == want
    decontaminate.MAX_SENT = old
    assert decontaminate.leaks(odd, bench).count() == decontaminate.leaks(empty, bench).count() == decontaminate.leaks(df, bench.where("false")).count() == 0
    odd_rows = df.withColumn("row", F.lit("clash")).unionByName(df.where("doc_id % 3 < 2").select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit("clash").alias("row")))
    for sent in (decontaminate.MAX_SENT, 0):
        decontaminate.MAX_SENT, old = sent, decontaminate.MAX_SENT
        assert decontaminate.clean(df, bench).count() == 60 - len(want)
        kept = decontaminate.clean(odd_rows, bench)
        assert kept.columns == odd_rows.columns and kept.where("doc_id is null").count() == 20
        assert {r.doc_id for r in decontaminate.leaks(odd_rows, bench).collect()} == {d for d, _ in want} | {None}
        assert decontaminate.clean(empty, bench).count() == 0 and decontaminate.clean(odd, bench).count() == len(ODD) + 1
        decontaminate.MAX_SENT = old


def test_decontamination_of_copies(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    item = [word() for _ in range(40)]
    edited = [word() if k % 5 == 4 else w for k, w in enumerate(item)]
    body = [word() for _ in range(100)]
    short = [word() for _ in range(3)]
    rows = [(0, " ".join(body + item))] + [(d, " ".join(body + edited + body)) for d in range(1, 31)] + [(31, " ".join(body + short)), (32, " ".join(body))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    want = {(d, 1) for d in range(31)} | {(31, 2)}
    for sent in (decontaminate.MAX_SENT, 0):
        decontaminate.MAX_SENT, old = sent, decontaminate.MAX_SENT
        got = decontaminate.leaks(df, bench).collect()
        decontaminate.MAX_SENT = old
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert all(r.score == brute_align(item, edited) / 80 for r in got if 1 <= r.doc_id <= 30)


def brute_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_leaks(rows, items):
    """All items aligned with all texts."""
    import numpy as np

    out = {}
    for (d, t), (i, x) in itertools.product(rows, items):
        a, b = brute_words(t), brute_words(x)
        if len(a) and len(b) > 2:
            known = {w: k for k, w in enumerate(dict.fromkeys(b))}
            score = decontaminate.align(np.array([known[w] for w in b]), np.array([known.get(w, -1) for w in a]))[0] / (2 * len(b))
            if score >= 0.5:
                out[d, i] = max(out.get((d, i), 0), round(score, 6))
    return out


def edits(rng, item, word):
    """Copies of an item that align at half of a perfect score or more, and some that don't."""
    every = lambda k: [w if j % k else [w, word()] for j, w in enumerate(item)]
    flat = lambda parts: [w for p in parts for w in (p if isinstance(p, list) else [p])]
    half = len(item) // 2
    return [
        flat([w, word()] if j % 2 else w for j, w in enumerate(item)), [word() if j % 3 == 2 else w for j, w in enumerate(item)],
        item[half:] + item[:half], flat(every(1)), [w for j, w in enumerate(item) if j % 4], [word() if j % 2 else w for j, w in enumerate(item)],
        [w if rng.random() > 0.25 else word() for w in item], item[: half + 1], flat(every(3)),
    ]


def test_decontamination_finds_edited_copies(spark):
    """Every text is aligned with every item: words put in after every second word or replaced, halves reordered, words of few kinds."""
    rng = random.Random(9)
    for letters, length in (("abcdefghijkl", 5), ("abc", 2)):
        word = lambda: "".join(rng.choices(letters, k=length))  # noqa: E731, B023
        items = [[word() for _ in range(n)] for n in (3, 4, 5, 9, 20, 30, 31, 60)]
        texts = [[*(word() for _ in range(rng.randint(0, 60))), *copy, *(word() for _ in range(rng.randint(0, 60)))] for item in items for copy in edits(rng, item, word)]
        texts += [edits(rng, items[5], word)[1]] * 31 + [[word() for _ in range(100)] for _ in range(20)]
        rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
        bench = [(k, " ".join(x)) for k, x in enumerate(items)]
        want = brute_leaks(rows, bench)
        assert len(want) > 80
        for sent in (decontaminate.MAX_SENT, 0):
            decontaminate.MAX_SENT, old = sent, decontaminate.MAX_SENT
            got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
            decontaminate.MAX_SENT = old
            assert {(r.doc_id, r.item_id): r.score for r in got} == want


def test_decontamination_against_aligning_all(spark):
    """The smallest tables: every document with every item."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs, bench).collect()}
    assert got == want and want


def test_decontamination_of_a_long_item(spark):
    rng = random.Random(10)
    item = [str(rng.randrange(10**6)) for _ in range(20_000)]
    rows = [(0, " ".join(item[:12_000])), (1, " ".join(item[:5000])), (2, None)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[:7]))], "item_id long, text string")
    for sent in (decontaminate.MAX_SENT, 0):
        decontaminate.MAX_SENT, old = sent, decontaminate.MAX_SENT
        got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
        decontaminate.MAX_SENT = old
        assert {(r.doc_id, r.item_id) for r in got} == {(0, 1), (0, 2), (1, 2)}


# 5


def test_urls(spark):
    rows = [None, "", "no scheme", "http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "http://b.org", "http://b.org/", "ftp://x.com/fr/1", "x://q.com/de/", "http://com/fr/", "http://badcom/fr/", "http://h?x/y", "a://b://c/d"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(len(rows))] == [("", "", None)] * 3 + [("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("b.org", "", None), ("b.org", "/", "org/"), ("x.com", "/fr/1", "com/fr/"), ("q.com", "/de/", "com/de/"), ("com", "/fr/", "com/fr/"), ("badcom", "/fr/", None), ("h", "", None), ("b:", "//c/d", None)]
    assert got[3].verdict == "block" and got[6].verdict == "allow"
    assert urls.judge(df.where("false")).count() == 0
    bad = spark.createDataFrame([(1, "http://casino-bonus.example.net/bet/slots"), (2, "http://wiki.example.net/en/history")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in urls.judge(bad, urls.train()).collect()} == {1: "block", 2: "allow"}


def brute_mix(x):
    m = 2**64 - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def brute_margin(model, host, path):
    """One gram after the other, in plain numbers."""
    total = model.bias
    for seed, part in ((1, f"^{host}$"), (2, f"^{path}$")):
        part = re.sub("[0-9]", "0", part).encode()
        weights = []
        for n in (3, 4, 5):
            for k in range(len(part) - n + 1):
                h = part[k]
                for byte in part[k + 1 : k + n]:
                    h = (h * 0x100000001B3 + byte) % 2**64
                weights.append(model.weights[brute_mix((h + n * 2**32 + seed) % 2**64) >> 64 - urls.BITS])
        if weights:
            total += urls.SCALE * sum(weights) / len(weights)
    return total


def test_url_classifier_against_brute_force(spark):
    model = urls.train()
    rows = [(k, h, p) for k, (h, p, _, _) in enumerate(urls.labelled_urls()[::40])] + [(-1, "", ""), (-2, "é.de", "/ü"), (-3, "x", "")]
    df = spark.createDataFrame([(k, f"http://{h}{p}" if h else None) for k, h, p in rows], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df, model, rules=()).collect()}
    for k, h, p in rows:
        want = 1 / (1 + math.exp(-(model.a * brute_margin(model, h, p) + model.b)))
        assert got[k].block_prob == pytest.approx(want, abs=1e-6)
        assert got[k].verdict == ("block" if got[k].block_prob >= urls.BLOCK_AT else "allow")


def test_url_classifier_on_hosts_it_has_not_seen():
    rows = urls.labelled_urls()
    assert {h for h, _, _, t in rows if t < urls.FIT} & {h for h, _, _, t in rows if t >= urls.FIT} == set()
    model = urls.train()
    for lo, hi, most in ((urls.FIT, urls.FIT + urls.CALIBRATE, 0.03), (urls.FIT + urls.CALIBRATE, 10, 0.03)):
        blocked = {0: [], 1: []}
        for h, p, label, tenth in rows:
            if lo <= tenth < hi:
                blocked[label].append(model.probability(urls.margin_of(model, h, p)) >= urls.BLOCK_AT)
        assert sum(blocked[0]) <= most * len(blocked[0]) and sum(blocked[1]) >= 0.8 * len(blocked[1])


def test_url_classifier_decides_on_pages(spark):
    got = urls.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).where("rule is null").collect()
    unwanted = [r for r in got if re.search("casino|pills|bets|track|spam|adult", r.host)]
    plain = [r for r in got if r not in unwanted]
    assert len(unwanted) > 20 and sum(r.verdict == "block" for r in unwanted) >= 0.9 * len(unwanted)
    assert sum(r.verdict == "allow" for r in plain) >= 0.95 * len(plain)


def test_url_model_on_hosts_written_by_hand():
    """Hosts by hand that took no part in the fit: better than chance, and that is what the README says."""
    model, found = urls.train(), {0: [], 1: []}
    rows = [r for r in urls.written_urls() if r[3] >= urls.FIT + urls.CALIBRATE]
    for h, p, label, _ in rows:
        found[label].append(model.probability(urls.margin_of(model, h, p)) >= urls.BLOCK_AT)
    assert len({h for h, _, _, _ in urls.written_urls()}) > 300
    print({k: round(float(np.mean(v)), 3) for k, v in found.items()})
    assert np.mean(found[1]) > 1.5 * np.mean(found[0])


# 6


def luhn(digits):
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(map(int, reversed(digits)))) % 10 == 0


PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_pii(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii(spark, docs, odd, empty):
    rng = random.Random(5)
    parts = [*"ab1+-. ()@_%😀é\n", "@b.c", "4111 1111 1111 1111", "+1 (888) 555-6841", "1.2.3.4", "25", "x.y@z.w", "001.2.3.300"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(1500)] + [*ODD, "1 " * 20000, "a" * 3000 + "@"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    for frame in (df, docs):
        want = {r.doc_id: brute_pii(r.text) for r in frame.collect()}
        for r in pii.digest(pii.find(frame)).collect():
            assert r.base_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
            assert r.n_email == want[r.doc_id].count("email:") and r.n_phone == want[r.doc_id].count("phone:")
    assert pii.find(odd).count() == len(ODD) + 1 and pii.find(empty).count() == 0


def test_pii_method_and_redaction(spark):
    df = spark.createDataFrame([(1, "pay to iban GB82 WEST 1234 5698 7654 32 now"), (2, "GB82 WEST 1234 5698 7654 33"), (3, 'token = "e7fbfec6a80404dc513b99d3fdbf2a6e53400638"'), (4, "mail a@b.cd or +1 (888) 555-6841 or 4111 1111 1111 1111"), (5, None)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.digest(pii.find(df)).collect()}
    assert spans[1] == "iban:12:39" and spans[2] == "" and spans[3] == "secret:9:49"
    text = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert text == {1: "pay to iban [IBAN] now", 2: "GB82 WEST 1234 5698 7654 33", 3: 'token = "[SECRET]"', 4: "mail [EMAIL] or [PHONE] or [CARD]", 5: None}


def test_pii_of_very_many_spans(spark):
    """Tens of thousands of spans in one text: places stay right and time stays short."""
    n = 32_000
    df = spark.createDataFrame([(1, "é a@b.cd " * n)], "doc_id long, text string")
    began = time.time()
    spans = pii.find(df).first().spans
    assert [(s.start, s.end) for s in spans] == [(9 * k + 2, 9 * k + 8) for k in range(n)]
    assert pii.redact(df).first().text == "é [EMAIL] " * n
    assert time.time() - began < 60


def test_pii_plan_has_no_python(docs):
    plan = pii.digest(pii.find(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 7


def brute_differences(rows, good):
    texts = [[w.encode() for w in words("".join(c.lower() if c.isascii() else c for c in t or ""))] for _, t in rows]

    def loss(k, members):
        """Mean loss of text k under the model of members, without k itself."""
        pair, word, before = collections.Counter(), collections.Counter(), collections.Counter()
        for j in members:
            if j != k:
                for p, w in zip([None, *texts[j]], texts[j], strict=False):
                    pair[p, w] += 1
                    word[w] += 1
                before.update([None] if texts[j] else [])
        total, out = sum(word.values()), 0.0
        for p, w in zip([None, *texts[k]], texts[k], strict=False):
            alone = ((1 - lmscore.UNSEEN) * word[w] / total if total else 0.0) + lmscore.UNSEEN * lmscore.FLOOR
            n = before[p] if p is None else word[p]
            out -= math.log(lmscore.BIGRAM * pair[p, w] / n + (1 - lmscore.BIGRAM) * alone if n else alone)
        return out / len(texts[k])

    target, background = [k for k, (d, _) in enumerate(rows) if d in good], [k for k, (d, _) in enumerate(rows) if d not in good]
    return [(d, len(texts[k]), *((loss(k, target), loss(k, background)) if texts[k] else (None, None))) for k, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("repeat_bytes", [64 << 20, 1])
def test_lm_differences(spark, docs, labels, odd, empty, repeat_bytes):
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()] + [(r.doc_id, r.text) for r in odd.collect()] + [(900001, "rare0 " * 3 + "rare1"), (900001, "rare2"), (None, "rare1 rare0"), (None, "rare1 rare0")]
    good = {r.doc_id for r in labels.where("quality > 0").collect()} | {900001}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([(d, 1) for d in good], "doc_id long, quality int")
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    got = sorted((tuple(r) for r in lmscore.differences(df, marked, block_bytes=20_000, repeat_bytes=repeat_bytes).collect()), key=key)
    want = sorted(brute_differences(rows, good), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[2:4] == (pytest.approx(w[2:], abs=1e-9) if w[1] else (None, None))
        assert g[4] == (pytest.approx(g[2] - g[3]) if w[1] else None)
    assert lmscore.differences(empty, labels).count() == 0
    assert lmscore.differences(odd, labels.where("false")).count() == len(ODD) + 1


def test_lm_messages():
    import numpy as np

    rng = np.random.default_rng(3)
    for buckets in (1, 3, 1000, 2**16, 5_000_000):
        keys = rng.integers(0, 2**64 - 1, 3000, np.uint64)
        bucket, key, at = lmscore.dealt(keys, buckets)
        assert len(at) == 3000 and len(set(zip(bucket.tolist(), key.tolist(), strict=True))) == len(key) and (np.diff(bucket) >= 0).all()
        assert key.max() < 2**lmscore.KEY_BITS and 0 <= bucket.min() and bucket.max() < buckets
        assert (np.diff(key.astype(np.int64))[np.diff(bucket) == 0] > 0).all()
    for size in (1, 1, 1, 1, 5, 4000):
        keys = np.unique(rng.integers(0, 2**lmscore.KEY_BITS, size, np.uint64))
        n, n_target = (rng.choice([0, 1, 15, 16, 300, 2**30], len(keys)).astype(np.int32) for _ in range(2))
        for got, want in zip(lmscore.unpacked(lmscore.packed(keys, n, n_target)), (keys, n, n_target), strict=True):
            assert got.tolist() == want.tolist()


def test_lm_table_of_sums_grows(spark):
    """The model has one sum for each word and pair of the corpus, whatever its size."""
    rng = random.Random(9)
    for n in (200, 2000):
        df = spark.createDataFrame([(k, " ".join(str(rng.randrange(n)) for _ in range(20))) for k in range(n // 10)], "doc_id long, text string")
        table = df.selectExpr("0 as block", "doc_id", "text", "false as is_target").toArrow()
        block = lmscore.Block(table, 7)
        texts = [lmscore.words_of(r.text) for r in df.collect()]
        assert len(block.keys) == len({w for t in texts for w in t}) + len({x for t in texts for x in zip([None, *t], t, strict=False)}) + 1


def test_lm_block_works_on_equal_rows_once(spark):
    """5000 equal rows of 20 kB are one text of the block."""
    import tracemalloc

    import pyarrow as pa

    text = " ".join(f"w{k % 700}" for k in range(4000))
    table = pa.table({"block": pa.array([0] * 5001, pa.int32()), "doc_id": list(range(5001)), "text": [text] * 5000 + ["x y"], "is_target": [False] * 5001})
    tracemalloc.start()
    block = lmscore.Block(table, 7)
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()
    assert len(block.sizes) == 2 and block.copies.tolist() == [5000, 1] and len(block.of) == 5001
    n = block.counts(np.ones(2, bool))
    assert n[block.word[block.row == 0]].max() == 5000 * (4000 // 700 + 1) and n.sum() == 5000 * (2 * 4000 + 1) + 2 * 2 + 1


def test_lm_block_of_a_long_text(monkeypatch):
    """A long text is cut and merged: the same pairs, in memory for its distinct ones."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    text = " \n".join(rng.choices([f"w{k}" for k in range(300)], k=1_500_000))
    table = pa.table({"block": pa.array([0] * 3, pa.int32()), "doc_id": [1, 2, 3], "text": [text, "", "w1 w2 w1"], "is_target": [False] * 3})
    tracemalloc.start()
    block = lmscore.Block(table, 7)
    assert tracemalloc.get_traced_memory()[1] < 40 * len(text)
    tracemalloc.stop()
    assert block.sizes.tolist() == [1_500_000, 0, 3] and block.times.sum() == 1_500_003
    small = pa.table({"block": pa.array([0] * 2, pa.int32()), "doc_id": [1, 2], "text": [text[:9000], "w1  w2\tw1"], "is_target": [False] * 2})
    whole = lmscore.Block(small, 7)
    for name, value in (("STRETCH", 50), ("MERGE", 100), ("CUT", 64)):
        monkeypatch.setattr(lmscore, name, value)
    parts = lmscore.Block(small, 7)
    assert sorted(zip(whole.row, whole.keys[whole.pair], whole.times, whole.own_word, whole.own_before)) == sorted(zip(parts.row, parts.keys[parts.pair], parts.times, parts.own_word, parts.own_before))
    assert (whole.counts(np.ones(2, bool)) == parts.counts(np.ones(2, bool))).all()


# 8


def brute_repeats(texts, window):
    n = collections.Counter()
    for t in texts:
        d = (t or "").encode()
        n.update(d[k : k + window] for k in range(len(d) - window + 1))
    out = []
    for t in texts:
        d = (t or "").encode()
        gone = bytearray(len(d))
        for k in range(len(d) - window + 1):
            if n[d[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("heavy", "ordered"), [(5000, 6 << 20), (5000, 20_000), (3, 6 << 20)])
def test_repeats(spark, monkeypatch, heavy, ordered):
    monkeypatch.setattr(repeats, "ORDERED", ordered)
    rng = random.Random(2)
    base = ["".join(rng.choices("abé ", k=rng.randint(0, 900))) for _ in range(20)]
    texts = list(base)
    for _ in range(60):
        t = "".join(rng.choice(base)[rng.randint(0, 300) :][: rng.randint(0, 500)] for _ in range(rng.randint(1, 4)))
        texts.append(t[:50] + "z" + t[51:] if rng.random() < 0.5 else t)
    texts += [None, "", "a" * 1000, "ab" * 400, "a" * 199, "a" * 200, base[0], base[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit("clash"))
    got = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(df, heavy=heavy).collect()}
    assert [got[k] for k in range(len(texts))] == brute_repeats(texts, 200)


def test_shared_windows_are_compared_by_bytes():
    """One anchor for all runs, as if hashes collided: only equal bytes count."""
    import numpy as np

    rng = random.Random(11)
    window, gram = 12, 4
    for _ in range(300):
        middles = ["".join(rng.choices("ab", k=gram)) for _ in range(2)]
        runs = set()
        for _ in range(rng.randint(1, 12)):
            reach = window - gram
            before, after = rng.randint(0, reach), rng.randint(0, reach)
            if before + after >= reach:
                runs.add(("".join(rng.choices("ab", k=before)) + rng.choice(middles) + "".join(rng.choices("ab", k=after)), before))
        runs = sorted(runs)
        data, off = [r.encode() for r, _ in runs], np.array([o for _, o in runs], np.int32)
        seen = collections.defaultdict(set)
        for k, (d, o) in enumerate(zip(data, off.tolist(), strict=True)):
            for lo in range(len(d) - window + 1):
                seen[d[lo : lo + window], o - lo].add(k)
        want = {(k, o - place) for (w, place), ks in seen.items() for k in ks if len(ks) > 1 for o in [off[k].item()]}
        run, lo, hi = repeats.shared_windows(np.zeros(len(data), np.int64), off, data, window, gram) if data else ([], [], [])
        assert {(r, k) for r, a, b in zip(run, lo, hi, strict=True) for k in range(a, b + 1)} == want


def test_repeats_of_rows_without_an_id_of_their_own(spark):
    """Rows of one doc_id, or none, are documents of their own: unique text stays, whatever the hashes of texts are."""
    rng = random.Random(12)
    texts = ["".join(rng.choices("abcdefgh ", k=256)) for _ in range(40)]
    rows = [(None, t) for t in texts] + [(7, t) for t in texts[:10]] + [(7, "unique " * 3 + "".join(rng.choices("xyz", k=300)))] * 2 + [(7, "".join(rng.choices("xyz", k=300)))]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_repeats([t for _, t in rows], 200)
    assert sorted(str(tuple(r)) for r in got) == sorted(str((d, *w)) for (d, _), w in zip(rows, want, strict=True))
    assert sum(r.n_removed == 0 for r in got) == 31


def test_repeats_of_odd_rows(odd, empty, docs):
    assert repeats.remove_repeats(odd).count() == len(ODD) + 1 and repeats.remove_repeats(empty).count() == 0
    rows = docs.collect()
    got = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(docs).collect()}
    assert [got[r.doc_id] for r in rows] == brute_repeats([r.text for r in rows], 200)


# 9


def test_pieces(spark, docs, odd, empty):
    agenda = pieces.Agenda(pieces.default_model())
    sp = agenda.library
    rng = random.Random(0)
    al = "ab the in\n\t.,\u2581  éß日🙂1290-_Ab\x00"
    texts = ["".join(rng.choices(al, k=rng.randint(0, 120))) for _ in range(1500)] + [t for t in ODD if t is not None] + ["x" * 3000 + " " * 50]
    for t in texts:
        assert [x for c in agenda.encode([c.replace(" ", pieces.SPACE) for c in pieces.chunks_of(t)]) for x in c] == sp.encode(t)
    for frame in (odd, docs):
        want = collections.defaultdict(set)
        for r in frame.collect():
            ids = [*sp.encode(r.text or ""), sp.eos_id()]
            want[r.doc_id].add((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), 0))
        for r in pieces.encode_decode(frame).collect():
            assert tuple(r)[1:] in want[r.doc_id]
    assert pieces.encode_decode(empty).count() == 0


def test_pieces_are_the_agendas_and_the_library_only_counts(monkeypatch):
    """Ids come from the agenda even where the library differs; n_mismatches tells."""
    import pyarrow as pa

    agenda = pieces.Agenda(pieces.default_model())
    asked = ["▁the", "▁encoding", "word", "\n"]
    ids = agenda.encode(asked)
    assert agenda.differing(asked, ids) == [False] * 4
    bent = [*ids[:2], (1, 2, 3), ids[3]]
    assert agenda.differing(asked, bent) == [False, False, True, False] and bent[2] == (1, 2, 3)
    monkeypatch.setattr(pieces.Agenda, "encode", lambda self, chunks: [(7,) for _ in chunks])
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["two words"]})
    assert pieces.encode_batches([batch], pieces.default_model(), True).__next__().to_pylist()[0]["n_mismatches"] == 2


# 10


def test_forward_sums_all_segmentations():
    import numpy as np

    p = language.Pieces(language.default_vocabulary())
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=language.default_vocabulary())
    prob = np.random.default_rng(0).random((p.n + 1, 2)) / 100
    prob[-1] = 0

    def brute(word, k):
        if not word:
            return 1.0
        total = 0.0
        for n in range(1, len(word) + 1):
            i = sp.piece_to_id(word[:n])
            known = i != sp.unk_id() and not sp.is_control(i) and not sp.is_byte(i)
            total += (prob[i, k] if known else language.UNKNOWN if n == 1 else 0.0) * brute(word[n:], k)
        return total

    ws = ["▁the", "▁a", "▁tions", "▁éx", "ing"]
    got = language.likelihoods(ws, p, prob)
    for w, row in zip(ws, got, strict=True):
        assert np.exp(row) == pytest.approx([brute(w, 0), brute(w, 1)], rel=1e-9)


def test_long_words_are_summed_whole():
    """Words of 33 to 5000 code points: likelihood and expected uses as one plain sum over the whole word."""
    import numpy as np
    import sentencepiece

    pieces_ = language.Pieces(language.default_vocabulary())
    sp = sentencepiece.SentencePieceProcessor(model_file=language.default_vocabulary())
    assert pieces_.longest == max(len(sp.id_to_piece(i)) for i in range(sp.vocab_size()) if sp.id_to_piece(i).strip(language.SPACE))
    prob = np.random.default_rng(1).random((pieces_.n + 1, 2)) / 100
    prob[-1] = 0
    rng = random.Random(6)

    def usable(piece):
        i = sp.piece_to_id(piece)
        return None if i == sp.unk_id() or sp.is_control(i) or sp.is_byte(i) else i

    for n in (33, 41, 200, 5000):
        word = language.SPACE + "".join(rng.choices(["the", "tion", "é", "日本", "ing", "x", "😀"], k=n))[: n - 1]
        got = language.likelihoods([word], pieces_, prob)[0]
        uses = language.expected([word], np.array([[2.0, 3.0]]), pieces_, prob)
        for k in range(2):
            # Scaled sums forwards and backwards, by plain arithmetic.
            found = [[(word[s : s + m], m) for m in range(1, min(pieces_.longest, n - s) + 1)] for s in range(n)]
            chance = [[(m, language.UNKNOWN if i is None and m == 1 else 0.0 if i is None else max(prob[i, k], language.UNKNOWN if m == 1 else 0.0), i) for w, m in f for i in [usable(w)]] for f in found]
            logs = [0.0] + [-math.inf] * n
            for s in range(n):
                for m, c, _ in chance[s]:
                    if c:
                        x = logs[s] + math.log(c)
                        top = max(x, logs[s + m])
                        logs[s + m] = top + math.log(math.exp(x - top) + math.exp(logs[s + m] - top))
            assert got[k] == pytest.approx(logs[n], rel=1e-9)
            back = [-math.inf] * n + [0.0]
            want = collections.Counter()
            for s in range(n - 1, -1, -1):
                terms = [back[s + m] + math.log(c) for m, c, _ in chance[s] if c]
                top = max(terms)
                back[s] = top + math.log(sum(math.exp(t - top) for t in terms))
                for m, _, i in chance[s]:
                    if i is not None:
                        want[i] += math.exp(logs[s] + math.log(prob[i, k]) + back[s + m] - logs[n]) * (2, 3)[k]
            assert {i: x for i, x in enumerate(uses[:, k]) if x > 1e-9} == pytest.approx({i: x for i, x in want.items() if x > 1e-9}, rel=1e-6)


def test_short_and_long_words_are_summed_alike(monkeypatch):
    import numpy as np

    pieces_ = language.Pieces(language.default_vocabulary())
    prob = np.random.default_rng(2).random((pieces_.n + 1, 3)) / 100
    prob[-1] = 0
    ws = ["▁the", "▁a", "▁Segmentation", "▁日本語xé", "ing"]
    counts = np.random.default_rng(3).random((len(ws), 3))
    one = language.likelihoods(ws, pieces_, prob), language.expected(ws, counts, pieces_, prob)
    monkeypatch.setattr(language, "MATRIX", 0)
    two = language.likelihoods(ws, pieces_, prob), language.expected(ws, counts, pieces_, prob)
    assert np.allclose(one[0], two[0], rtol=1e-9) and np.allclose(one[1], two[1], rtol=1e-6, atol=1e-12)


def test_language(docs, odd, empty):
    model = language.train(docs, rows=400)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d, r in got.items() if r.held_out} == set(held)
    assert sum(got[d].lang_pred == truth[d] for d in held) >= 0.97 * len(held)
    nobody = language.predict(odd.select(F.lit(None).cast("long").alias("doc_id"), "text"), model)
    assert {r.held_out for r in nobody.collect()} == {False}
    some = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert [some[k].lang_pred for k in (0, 1, 2)] == ["und"] * 3 and some[5].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in some.values())
    assert language.predict(empty, model).count() == 0
    assert {r.lang_pred for r in language.predict(odd, language.train(empty)).collect()} == {"und"}


def test_rare_classes_are_sampled(spark):
    rows = [(d, "ga" if d % 1000 == 7 else "en", f"agus {d} tá" if d % 1000 == 7 else f"the {d} word", int(d % 1000 != 7)) for d in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, quality int")
    langs, p = language.train(df.select("doc_id", "lang", "text"), rows=20, rounds=1)
    assert langs == ["en", "ga"] and p[:, 1].max() > 2 * p[p[:, 1] > 0, 1].min()
    assert quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality"), rows=20) is not None


def test_simhash_index_is_not_sent_through_the_driver(spark):
    """The exploded index looks small to Spark at any size, so its joins must not be broadcasts."""
    fps = spark.range(600).select(F.col("id").alias("fp"))
    for heavy in (10_000, 5):
        plan = simhash.links(fps, heavy)._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin [s" in plan
        assert not re.search(r"BroadcastHashJoin \[s#\d+, (key|point)#\w+\], \[[^]]*\], Inner", plan)
