"""Small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from loomwork.functions import html, scores
from loomwork.functions.transforms import chain
from loomwork.operators import answers, dedup, extract, graph, lifecycle, telemetry
from loomwork.sources import blueprint

PAGE = """<table id="stock"><caption>Seeds\n 2031</caption><tr data-row="1"><td>Dill</td><td class="n low">3<sup>*</sup></td><td><a rel="order" href="/o/dill">order</a></td></tr>
<tr data-row="2"><td>Leek</td><td class="n">40</td><td><a rel="order" href="leek-seed">&nbsp;</a><em>new</em></td></tr><tr data-row="3"><td>Rue</td></tr></table><ol><li>sow<li>water</ol>"""


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("//caption", ["Seeds\n 2031"]),
        ("//tr/td[1]/text()", ["Dill", "Leek", "Rue"]),
        ("//tr[3]/td", ["Rue"]),
        ("//td[@class='n']", ["40"]),
        ("//td[contains(@class,'n')]", ["3*", "40"]),
        ("//tr[@data-row='2']//em", ["new"]),
        ("//tr[td/a]/@data-row", ["1", "2"]),
        ("//tr[not(td/a)]/@data-row", ["3"]),
        ("//li", ["sow", "water"]),
        ("//em | //sup", ["*", "new"]),
        ("count(//td)", ["7.0"]),
        ("//sup/ancestor::td[1]/following-sibling::td/a/@href", ["/o/dill"]),
        ("//td[normalize-space()='Leek']/ancestor::tr[1]/@data-row", ["2"]),
        ("//a[starts-with(@href,'/o')]/@rel", ["order"]),
        ("//form//input", []),
    ],
)
def test_xpath(path, want):
    assert [html.as_text(x) for x in html.select(html.parse(PAGE), path)] == want


def test_empty_page_is_an_error():
    with pytest.raises(ValueError):
        html.parse("   ")


def test_links(spark):
    pages = spark.createDataFrame([(1, "http://h.org/a/b", PAGE), (2, "http://h.org", None)], "page_id long, url string, html string")
    got = [(r.url, r.anchor) for r in extract.extract_links(pages).orderBy("pos").collect()]
    assert got == [("http://h.org/o/dill", "order"), ("http://h.org/a/leek-seed", "leek seed")]


def test_item_errors(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    for spec in ({"mode": "odd"}, {"mode": "container"}, {"fields": {"a": {"selector": "//a", "type": "odd"}}}):
        with pytest.raises(ValueError):
            extract.extract_items(pages, spec)
    items = extract.extract_items(pages, {"mode": "container", "container": "//tr[td/a]", "fields": {"t": {"selector": "./td", "type": "scalar"}, "n": {"type": "list"}}})
    assert [(r["item"].t, r["item"].n) for r in items.orderBy("pos").collect()] == [("Dill", []), ("Leek", [])]


def test_transforms(spark):
    df = spark.createDataFrame([(" Ab ", ["x", " X", "y"]), (None, None)], "s string, l array<string>")
    got = df.select(chain(F.col("s"), [{"type": "strip"}, {"type": "lowercase"}]), chain(F.col("l"), [{"type": "deduplicate"}], True), chain(F.col("s"), [{"type": "regex", "pattern": "z"}]), chain(F.col("s"), [{"type": "truncate", "max_len": 2}], none_as_text=True)).collect()
    assert [tuple(r) for r in got] == [("ab", ["x", "y"], None, " A"), (None, None, None, "None")]


@pytest.mark.parametrize(("text", "want"), [("50", 50), ("500", 100), ("-20", 0), ('"77"', 77), ('"77.5"', 0), ("77.5", 77), (None, 0), ("abc", 0), ("{}", 0)])
def test_scores_of_answers(spark, text, want):
    assert spark.createDataFrame([(text,)], "v string").select(scores.parsed_score(F.col("v"))).first()[0] == want


def test_answers_of_both_shapes(spark):
    df = spark.createDataFrame([('```json\n{"u": {"score": 5, "relevance_type": "DIRECT", "expansions": [" a ", "", 3]}}\n```',), ('{"results": [{"url": "v", "score": "9"}]}',), ("no json",)], "answer string")
    got = {r.url: (r.score, r.relevance_type, r.expansions) for r in answers.parse_answers(df).collect()}
    assert got == {"u": (5, "direct", ["a"]), "v": (9, "ambiguous", [])}


def test_no_results_change_nothing(spark):
    links = spark.createDataFrame([("u", 1, 3, None, None)], "url string, pos long, score int, relevance_type string, expansions array<string>")
    none = spark.createDataFrame([], "url string, score int, relevance_type string, expansions array<string>")
    assert answers.map_results(links, none).collect() == links.collect()


def test_priorities(spark):
    names = [*scores.BALANCED, "semantic_delta", "cluster_distance"]
    df = spark.createDataFrame([tuple([0.5] * len(names))], ", ".join(f"{n} double" for n in names))
    for name in ("aggressive", "balanced", "exploration"):
        deep = [df.select(scores.priority(name, F.lit(50), F.lit(d))).first()[0] for d in (0, 3, 99)]
        assert deep[0] > deep[1] >= deep[2] >= 0
    with pytest.raises(ValueError):
        scores.strategy("odd")


def test_dedup_is_an_anti_join(spark):
    links = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "url string, pos long")
    seen = spark.createDataFrame([("b",)], "url string")
    assert sorted(r.pos for r in dedup.dedup_links(links, seen).collect()) == [1, 2]
    assert [r.pos for r in dedup.dedup_links(links, seen, "strict").collect()] == [1]
    assert "LeftAnti" in dedup.dedup_links(links, seen)._jdf.queryExecution().toString()


def test_durations(spark):
    rows = [("s", 1, 1, 0, "started"), ("s", 1, 2, 10, "completed"), ("s", 1, 3, 20, "completed"), ("s", 1, 4, 30, "started"), ("s", 1, 5, 40, "started"), ("s", 1, 6, 60, "failed")]
    df = spark.createDataFrame(rows, "stage string, node_id long, seq long, t long, phase string").select("stage", "node_id", "seq", F.timestamp_millis("t").alias("ts"), "phase")
    got = {r.seq: r.duration_ms for r in telemetry.stage_durations(df).collect()}
    assert got[2] == pytest.approx(10) and got[3] is None and got[6] == pytest.approx(20)


def test_seek_equals_fold(spark):
    df = spark.range(850).select(F.col("id").alias("seq"), (F.col("id") * 7 % 31).alias("node_id"), (F.col("id") % 5).cast("string").alias("state"))
    folds = telemetry.checkpoints(df, "node_id")
    for seq in (0, 1, 199, 200, 201, 399, 400, 640, 849):
        assert sorted(map(tuple, telemetry.seek(folds, df, "node_id", seq).collect())) == sorted(map(tuple, telemetry.state_at(df, "node_id", seq).collect()))


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 51)], "a long, b long")
    assert {r.node: r.label for r in graph.components(edges).collect()} == {**dict.fromkeys(range(31), 0), 50: 50, 51: 50}


def test_backoff(spark):
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate([True, True, False, True, True, True, True, True])], "n long, seq long, l boolean")
    got = [r.backoff for r in lifecycle.backoff_series(df, "n", "seq", F.col("l")).orderBy("seq").collect()]
    assert got == [1, 2, 1, 2, 4, 8, 10, 10]


def spec():
    return {"blueprint_id": "b", "target_topic": "t", "seeds": [{"url": "u", "domain": "d"}], "domains": {"d": {"base_url": "d", "link_selector": "//a"}}, "extraction": {"fields": {"f": {"selector": "//a", "type": "list", "export_type": "text", "transform": [{"type": "truncate"}]}}}, "scoring": {"strategy": "TOPICAL", "params": {"scoring_type": "x", "model_information": "m"}}, "expansion": {"style": "rich", "num_descriptions": 3, "llm_type": "a", "llm_model": "b"}, "stop_conditions": {"max_nodes": 5, "max_depth": 2, "max_duration": 9.0, "no_progress_timeout": 1.0, "stop_url": None}}


def test_blueprint():
    given = spec()
    got = blueprint.translate(given)
    assert given == spec() and got["stop_conditions"]["priority_strategy"] == "balanced"
    assert got["extraction"]["fields"]["f"]["transform"] == [{"type": "truncate", "max_len": 300}]
    for key in spec():
        broken = spec()
        del broken[key]
        with pytest.raises(blueprint.SpecError):
            blueprint.translate(broken)
    broken = spec()
    broken["stop_conditions"]["max_nodes"] = "ten"
    with pytest.raises(blueprint.SpecError):
        blueprint.translate(broken)


def test_sentences_lose_all_white_space(spark):
    page = "<div><p>first one.\n\t the <a href='rel/x'>link</a> stands\u00a0\n here \n. last</p></div>"
    pages = spark.createDataFrame([(1, "http://h.org/a/b", page, "d"), (2, "http://h.org/", page, "none")], "page_id long, url string, html string, domain string")
    got = extract.extract_links(pages.where("page_id = 1")).first()
    assert (got.url, got.context) == ("http://h.org/a/rel/x", "the  link  stands\u00a0\n here")
    domains = spark.createDataFrame([("d", "https://base.example/x/y", "//p/a")], "domain string, base_url string, link_selector string")
    assert [(r.page_id, r.url) for r in extract.domain_links(pages, domains).collect()] == [(1, "https://base.example/x/rel/x")]


def test_item_hash_of_null(spark):
    df = spark.createDataFrame([(1, ("a",)), (2, None)], "k long, item struct<a: string>")
    got = {r.k: r.item_hash for r in dedup.with_item_hash(df).collect()}
    assert got[2] is None and len(got[1]) == 64


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    from loomwork.operators import export

    path = str(tmp_path / "t")
    rows = lambda xs: spark.createDataFrame(xs, "id long, seq long, v string")
    read = lambda: {(r.id, r.seq, r.v) for r in export.upserted(spark, path, rows([]).schema).collect()}
    assert read() == set()
    export.upsert_into(spark, path, rows([(k, 1, "a") for k in range(200)]), ["id"], "seq")
    before = export._manifest(spark, path)[1]
    for _ in range(2):  # a batch that is given again changes nothing
        export.upsert_into(spark, path, rows([(7, 2, "b"), (7, 3, "c"), (9, 0, "old")]), ["id"], "seq")
        assert read() == {(k, 1, "a") for k in range(200) if k != 7} | {(7, 3, "c")}
    after = export._manifest(spark, path)[1]
    assert 1 <= sum(before[b] != f for b, f in after.items()) <= 2
    export.upsert_into(spark, path, rows([]), ["id"], "seq")
    assert len(read()) == 200
    folders = {f.name for f in (tmp_path / "t" / "data").iterdir()}
    assert len(folders) == 3  # the first batch, and the last two of the touched buckets
    export.upsert_into(spark, path, rows([(7, 9, "d")]), ["id"], "seq", part_bytes=1)  # too large: four times as many buckets
    assert export._manifest(spark, path)[2] == 4 * export.BUCKETS and (7, 9, "d") in read() and len(read()) == 200
    export.upsert_into(spark, path, rows([(8, 9, "e")]), ["id"], "seq")
    assert len(read()) == 200 and {(7, 9, "d"), (8, 9, "e")} <= read() and len(list((tmp_path / "t" / "data").iterdir())) == 2


def test_idle_crawls_stop_by_a_timer(spark, tmp_path):
    from loomwork.streaming import events as S

    schema = "crawl_id long, seq long, ts timestamp, type string, depth int, url string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def put(rows):
        spark.createDataFrame([(c, s, t, "node_added", 0, u) for c, s, t, u in rows], "crawl_id long, seq long, t long, type string, depth int, url string").select("crawl_id", "seq", F.timestamp_seconds("t").alias("ts"), "type", "depth", "url").write.mode("append").parquet(source)
        S.run_to(S.stop_monitor(S.read_events(spark, source, spark.createDataFrame([], schema).schema), 100, 9, 1e9, "goal", 60.0), out, f"{out}-state")

    put([(1, 1, 1000, "a"), (2, 2, 1000, "a"), (3, 3, 1010, "x/goal/y"), (4, 4, 1000, None), (4, 5, 1100, "late")])
    put([(2, 6, 1050, "b"), (5, 7, 5000, "a")])
    put([(5, 8, 5001, "b")])
    got = {r.crawl_id: (r.stop_seq, r.reason) for r in spark.read.schema("crawl_id long, stop_seq long, reason string").parquet(out).collect()}
    assert got[3] == (3, "TARGET_REACHED") and got[4] == (4, "NO_PROGRESS")
    assert got[1] == (1, "NO_PROGRESS") and got[2][1] == "NO_PROGRESS" and 5 not in got


def test_custom_steps_strategies_and_encoders(spark):
    from loomwork.functions.transforms import register_transform
    from loomwork.sources import space_store

    register_transform("shout", lambda c, is_list, o: (F.upper(c), is_list))
    df = spark.createDataFrame([("ab",)], "s string")
    assert df.select(chain(F.col("s"), [{"type": "shout"}])).first()[0] == "AB"
    got = space_store.embedded(df, "s", lambda texts: [__import__("numpy").array([float(len(t))]) for t in texts]).first()
    assert got.vector == [2.0]


def test_numbers_in_sequence(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("k").alias("k"))
    got = graph.in_sequence(df, "n", "x", first=5).collect()
    assert sorted((r.x, r.n) for r in got) == [(k, k + 5) for k in range(1000)]
    assert graph.in_sequence(df.where("false"), "n", "x").count() == 0


def test_exported_values(spark):
    from loomwork.operators import export

    rows = [("i", "c", "u", "t", '{"k":1}', '[1, "é"]', "plain", [1.5], '{"a": 1}'), ("j", "c", "u", "t", None, "null", '"q"', None, "7")]
    items = spark.createDataFrame(rows, "id string, crawl_id string, url string, created_at string, a string, b string, c string, d array<double>, e string")
    got = export.export_rows(items.withColumn("s", F.struct("e")), {"a": "json", "b": "json", "c": "json", "d": "int", "e": "real", "s": "real"}).collect()
    assert [tuple(r)[4:] for r in got] == [('{"k": 1}', '[1, "é"]', '"plain"', None, None, None), (None, None, '"q"', None, 7.0, None)]


def test_equally_late_rows_are_settled_alike(spark):
    from loomwork.operators import export

    rows = [(1, 5, "b"), (1, 5, "a"), (1, 4, "z"), (2, None, "x")]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "id long, seq long, v string")
        got = export.upsert_latest(df.limit(0), df, ["id"], "seq").collect()
        assert {r.id: r.v for r in got} == {1: "b", 2: "x"}


def test_links_without_a_parent_are_decided(spark):
    from loomwork.operators import cascade

    links = spark.createDataFrame([(None, k, 0.9, "mid") for k in range(3)] + [(1, 9, 0.1, "low")], "parent long, key long, nlp_score double, bucket string")
    got = cascade.decisions(links, "parent", "key", "s").collect()
    assert sorted((r.key, r.decision) for r in got) == [(0, "llm"), (1, "llm"), (2, "llm"), (9, "dropped")]


def test_decisions_of_a_hot_node_against_plain_python(spark):
    import hashlib

    from loomwork.operators import cascade

    rows = [(7 if k % 3 else None, k, (k * 37 % 101) / 100, ("low", "mid", "high", None)[k * 7 % 4]) for k in range(600)] + [(1, 1000, None, "high"), (1, 1001, 0.5, "high")]
    links = spark.createDataFrame(rows, "parent long, key long, nlp_score double, bucket string")
    dice = lambda r: (hashlib.md5(f"s{r[1]}".encode()).hexdigest(), r[1])
    want = {r[1]: "llm" for r in rows}
    for parent in (None, 1, 7):
        low, high = (sorted((r for r in rows if r[0] == parent and r[3] == b), key=dice) for b in ("low", "high"))
        want |= {r[1]: "dropped" for r in low[int(len(low) * 0.2) :]}
        n = int(len(high) * 0.5)
        chance = int(n * 0.3)
        left = sorted(high[chance:], key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        want |= {r[1]: "trusted" for r in left[n - chance :]}
    got = cascade.decisions(links, "parent", "key", "s", low_share=0.2, high_share=0.5, random_share=0.3).collect()
    assert {r.key: r.decision for r in got} == want and len(got) == len(rows)
    assert cascade.decisions(links.limit(0), "parent", "key", "s").isEmpty()


def test_candidates_in_parts(spark):
    from loomwork.operators import reports

    given = spark.createDataFrame([(p, k, f"u{k}") for p in (None, 1) for k in (2, 0, 1, 1)], "p long, pos long, url string")
    got = reports.candidates_by_parent(given, "p", "pos", 3).collect()
    assert sorted((r.p or 0, r.part, r.n, [c.pos for c in r.candidates]) for r in got) == [(p, *x) for p in (0, 1) for x in ((0, 4, [0, 1, 1]), (1, 4, [2]))]


def test_ranges_are_as_wide_as_the_root_of_their_span(spark):
    from loomwork.operators import graph, reports

    assert graph.range_width(spark.range(100).selectExpr("id * 1000000000000L AS seq"), "seq") > 9_900_000
    assert graph.range_width(spark.range(10), "id") == 10_000 == graph.range_width(spark.range(0), "id")
    rows = spark.range(50).selectExpr("id * 1000003 AS seq", "id % 7 AS depth")
    got = sorted(tuple(r) for r in reports.running_depth(rows).select("seq", "nodes", "top_depth").collect())
    assert got == [(k * 1000003, k + 1, min(k, 6)) for k in range(50)]


def test_prompts_of_many_links(spark):
    links = spark.createDataFrame([(p, k, f"u{k}", "a", "c") for p in (None, 1) for k in range(7)], "p long, pos long, url string, anchor string, context string")
    got = answers.scoring_prompts(links, "p", [("", "x"), ("L", answers.LINKS)], 3).collect()
    assert sorted((r.p or 0, r.part, r.n_links) for r in got) == [(p, k, n) for p in (0, 1) for k, n in ((0, 3), (1, 3), (2, 1))]
    assert all(r.prompt.startswith("x\n\nL\n[{") for r in got)


def test_named_references_end_with_a_semicolon():
    page = html.parse('<a href="/x?a=1&copy=2&amp;b=3&lt">&lt;b&gt; &amp;&amp &copy &notit; &#38; Q&A</a><script>a && b &amp; c</script>')
    link = html.select(page, "//a")[0]
    assert link.attrs["href"] == "/x?a=1&copy=2&b=3&lt"
    assert html.as_text(link) == "<b> &&amp &copy &notit; & Q&A"
    assert html.as_text(html.select(page, "//script")[0]) == "a && b &amp; c"
