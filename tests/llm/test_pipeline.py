"""Each stage of the pipeline against the operator's brute-force decisions."""

import random

import corpus_pipeline as P
from loomwork.llm import decontaminate, pii, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    stages = dict(P.STAGES)
    assert len(P.STAGES) == 5
    one = stages["quality rules"](spark, docs, SF)
    good = {r.doc_id for r in quality.judge(docs, quality.train(docs, labels)).where("kept").collect()}
    assert {r.doc_id for r in one.collect()} == good and one.columns == docs.columns
    two = stages["near duplicates"](spark, one, SF)
    assert {r.doc_id for r in two.collect()} == {r.component_id for r in simhash.near_duplicates(one).collect()} and two.columns == docs.columns
    three = stages["decontamination"](spark, two, SF)
    leaked = {r.doc_id for r in decontaminate.leaks(two, bench).collect()}
    assert {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - leaked
    four = stages["personal data"](spark, three, SF)
    assert four.columns == docs.columns and four.count() == three.count()
    assert not any(pii.find(four).where("size(filter(spans, s -> s.kind in ('email', 'card', 'iban', 'secret'))) > 0").collect())
    last = P.run(spark, SF)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in four.collect()}


WORDS = "the city river of stone and light runs past old houses where people meet talk trade read write learn about wind snow harbour boats market bread garden trees birds letters music dance winter spring summer autumn".split()


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and empty texts, repeated rows and ids, rows without an id, further columns with clashing names, empty tables."""
    item = "which of these harbours was built by the first settlers beside the northern river"
    rows = [(1, prose(1)), (1, prose(1)), (1, prose(2)), (None, prose(3)), (None, prose(3)), (None, prose(4)), (None, None), (2, None), (3, ""), (4, prose(5)), (5, prose(5)), (None, prose(5)), (None, prose(6) + " " + item), (6, prose(7) + " " + item), (7, prose(8) + " mail a@b.cd now"), (8, prose(9, 40_000))]
    clash = ("row", "fp", "__gone", "kept", "seed", "tie")
    df = spark.createDataFrame([(*r, "en", "s", 0, *("clash" for _ in clash)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash))
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(99, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = list(rows)
    for (name, stage), keep in zip(P.STAGES, (
        lambda rs: [r for r in rs if r[1]],
        lambda rs: [min((x for x in rs if x[1] == t), key=lambda x: (x[0] is None, x[0] or 0)) for t in {x[1] for x in rs}],
        lambda rs: [r for r in rs if item not in r[1]],
        lambda rs: [(d, t.replace("a@b.cd", "[EMAIL]")) for d, t in rs],
    ), strict=False):
        docs, want = stage(spark, docs, folder), keep(want)
        assert docs.columns == df.columns, name
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(want, key=str), name
    last = P.STAGES[-1][1](spark, docs, folder)
    assert sorted((r.doc_id for r in last.collect()), key=str) == sorted((d for d, _ in want), key=str)
    assert sorted((r.doc_id for r in P.run(spark, folder).collect()), key=str) == sorted((d for d, _ in want), key=str)
    for name, stage in P.STAGES:
        assert stage(spark, df.where("false"), folder).count() == 0, name
