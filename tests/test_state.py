"""What a crawl keeps between waves and batches: replay, waiting details, the growing space, seen urls, paced fetches."""

import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import graph, live, replay, seen, telemetry
from loomwork.plans.crawl import crawl
from loomwork.sources import growth, pages
from loomwork.streaming import details

# Replay


def test_seek_reads_one_snapshot_and_few_events(spark, tmp_path):
    df = spark.range(850).select(F.col("id").alias("seq"), (F.col("id") * 7 % 31).alias("node_id"), (F.col("id") % 5).cast("string").alias("state"))
    path = str(tmp_path / "replay")
    replay.write_replay(df, "node_id", path, 20, 4)
    for seq in (-1, 0, 19, 20, 79, 80, 81, 399, 639, 640, 849):
        got = replay.seek(spark, path, "node_id", seq, "node_id long, state string", 20, 4)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, telemetry.state_at(df, "node_id", seq).collect()))
    got = replay.seek(spark, path, "node_id", 699, "node_id long, state string", 20, 4)
    plan = got._jdf.queryExecution().toString()
    assert plan.count("PartitionFilters: [isnotnull(stretch") == 2 and "isnotnull(before" in plan
    assert {f.rsplit("/", 2)[1] for f in got.inputFiles()} >= {"before=8"}
    files = {f.split("/replay/")[1].split("/")[0] for f in got.inputFiles()}
    assert files == {"wholes", "deltas", "events"}
    tail = spark.read.parquet(f"{path}/events").where("stretch = 8 and seq between 680 and 699")
    assert tail.count() < 21


def test_replay_of_odd_events(spark, tmp_path):
    df = spark.createDataFrame([(None, 1, "a"), (3, None, "b"), (70, 1, None), (71, 2, "c")], "seq long, node_id long, state string")
    path = str(tmp_path / "replay")
    replay.write_replay(df, "node_id", path, 5, 3)
    assert {(r.node_id, r.state) for r in replay.seek(spark, path, "node_id", 71, "node_id long, state string", 5, 3).collect()} == {(1, None), (2, "c")}
    assert replay.seek(spark, path, "node_id", 40, "node_id long, state string", 5, 3).count() == 0


def test_replay_grows_with_its_events_not_with_keys_times_snapshots(spark, tmp_path):
    df = spark.range(6400).select(F.col("id").alias("seq"), F.shiftright("id", 1).alias("node_id"), (F.col("id") % 5).cast("string").alias("state"))
    path = str(tmp_path / "replay")
    replay.write_replay(df, "node_id", path, 20, 4)
    # 80 stretches: an event is in 7 snapshots at most.
    assert spark.read.parquet(f"{path}/wholes").count() <= 7 * 3200
    for seq in (79, 559, 4000, 6399, 1_000_000):
        got = replay.seek(spark, path, "node_id", seq, "node_id long, state string", 20, 4)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, telemetry.state_at(df, "node_id", seq).collect()))


# Details of nodes


def plain_details(batches, bound):
    waiting, lost, out = {}, 0, []
    for rows in batches:
        for seq, url, detail, is_node in sorted(rows, key=lambda r: (r[0], r[3])):
            if is_node:
                out.append((seq, url, waiting.pop(url, None)))
                continue
            waiting.pop(url, None)
            waiting[url] = detail
            if len(waiting) > bound:
                waiting.pop(next(iter(waiting)))
                lost += 1
    return out, lost


@pytest.mark.parametrize("bound", [2000, 5])
def test_each_detail_is_used_once(spark, tmp_path, bound):
    rng = random.Random(bound)
    batches, seq = [], 0
    for _ in range(3):
        rows = []
        for _ in range(120):
            seq += 1
            rows.append((seq, f"u{rng.randrange(25)}", None, True) if rng.random() < 0.4 else (seq, f"u{rng.randrange(25)}", f"d{seq}", False))
        batches.append(rows)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    old = spark.conf.get(details.PROVIDER[0])
    spark.conf.set(*details.PROVIDER)
    try:
        for rows in batches:
            spark.createDataFrame([(1, *r) for r in rows], "crawl_id long, seq long, url string, detail string, is_node boolean").write.mode("append").parquet(source)
            stream = spark.readStream.schema("crawl_id long, seq long, url string, detail string, is_node boolean").parquet(source)
            details.one_shot_details(stream, bound).writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set(details.PROVIDER[0], old)
    want, lost = plain_details(batches, bound)
    got = spark.read.parquet(out)
    assert sorted((r.seq, r.url, r.detail) for r in got.collect()) == sorted(want)
    assert got.agg(F.max("lost")).first()[0] <= lost and (lost > 0) == (bound == 5)
    if bound == 2000:
        every = spark.createDataFrame([r for b in batches for r in b], "seq long, url string, detail string, is_node boolean")
        batch = telemetry.as_of_details(every.where("is_node").select("seq", "url"), every.where("not is_node").select("seq", "url", "detail"))
        assert sorted((r.seq, r.url, r.detail) for r in batch.collect()) == sorted(want)


def test_without_a_bound_no_detail_is_lost(spark, tmp_path):
    rng, out, want = random.Random(3), str(tmp_path / "out"), []
    batches = [[(100 * b + k, f"u{rng.randrange(12)}", f"d{b}-{k}" if rng.random() < 0.6 else None) for k in range(40)] for b in range(3)]
    batches = [[(seq, url, detail, detail is None) for seq, url, detail in rows] for rows in batches]
    want, lost = plain_details(batches, float("inf"))
    old = spark.conf.get(details.PROVIDER[0])
    spark.conf.set(*details.PROVIDER)
    try:
        for rows in batches:
            spark.createDataFrame([(1, *r) for r in rows], "crawl_id long, seq long, url string, detail string, is_node boolean").write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("crawl_id long, seq long, url string, detail string, is_node boolean").parquet(str(tmp_path / "in"))
            details.one_shot_details(stream, None).writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set(details.PROVIDER[0], old)
    assert sorted((r.seq, r.url, r.detail, r.lost) for r in spark.read.parquet(out).collect()) == sorted((*r, 0) for r in want) and lost == 0


# The growing space


def test_buffer_flushes_and_loses(spark, tmp_path):
    path, now = str(tmp_path / "space"), [100.0]
    links = lambda a, b: spark.createDataFrame([(k, f"u{k}", [f"text {k}"]) for k in range(a, b)], growth.LINKS)
    take = lambda df, n: growth.take_batch(df, n, path, "bp", capacity=10, every=30.0, clock=lambda: now[0])
    log = lambda: [(r.batch, r.added, r.lost, r.kept, r.flushed, r.version) for r in growth.flush_log(spark, path).orderBy("batch").collect()]
    take(links(0, 4), 0)
    assert log() == [(0, 4, 0, 4, False, 0)]
    now[0] += 10
    take(links(4, 16), 1)  # six fit, which fills the buffer
    now[0] += 5
    take(links(16, 18), 2)
    take(links(16, 18), 2)  # given again
    now[0] += 40
    take(links(18, 19), 3)  # time has passed
    take(links(0, 0), 4)
    assert log() == [(0, 4, 0, 4, False, 0), (1, 12, 6, 6, True, 1), (2, 2, 0, 2, False, 1), (3, 1, 0, 1, True, 2), (4, 0, 0, 0, False, 2)]
    keys = {r.key for r in growth.space_store.load(spark, f"{path}/space", "bp", 2).collect()}
    assert keys == {f"u{k}::exp::0" for k in (*range(10), 16, 17, 18)}
    assert {r.version: r.n_vectors for r in growth.space_store.index(spark, f"{path}/space").collect()} == {1: 10, 2: 13}
    assert tuple(growth.buffer_totals(spark, path).first()) == (5, 19, 13, 6, 2, 2, 0)


def test_stream_grows_the_space(spark, tmp_path):
    path, source = str(tmp_path / "space"), str(tmp_path / "in")
    for lo in (0, 7):
        spark.createDataFrame([(k, f"u{k}", ["a", "b"]) for k in range(lo, lo + 7)], growth.LINKS).coalesce(1).write.mode("append").parquet(source)
        growth.grow_stream(spark.readStream.schema(growth.LINKS).parquet(source), path, "bp", f"{path}-state", capacity=5, every=1e9, clock=lambda: 0.0)
    got = growth.buffer_totals(spark, path).first()
    assert (got.added, got.kept, got.lost, got.version, got.waiting) == (14, 10, 4, 2, 0)


# Seen urls


@pytest.mark.parametrize("sent", [200_000, 0])
def test_seen_set_grows_by_increments(spark, sent):
    s = seen.SeenSet(spark, buckets=8, sent=sent)
    rng, known = random.Random(1), set()
    for _ in range(4):
        urls = [f"u{rng.randrange(200)}" for _ in range(60)] + [None]
        rows = spark.createDataFrame(list(enumerate(urls)), "k long, url string")
        new = s.unseen(rows)
        want = sorted(k for k, u in enumerate(urls) if u is not None and u not in known)
        assert sorted(r.k for r in new.collect()) == want
        s.add(rows.where("url is not null").join(s.seen_of(rows), "url", "left_anti"))
        known |= {u for u in urls if u}
        assert sorted(r.url for r in s.read().collect()) == sorted(known)


def test_seen_urls_are_not_shuffled(spark):
    s = seen.SeenSet(spark, buckets=4)
    s.add(spark.range(1000).select(F.concat(F.lit("u"), "id").alias("url")))
    asked = spark.createDataFrame([("u1",), ("x",)], "url string")
    plan = s.read([0]).join(F.broadcast(asked), "url", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert s.unseen(asked).collect()[0].url == "x" and len(s.read([0]).inputFiles()) < len(s.read().inputFiles())


# Fetches


def test_paced_fetch(spark):
    """Hosts wait for their own requests only; a rate limit doubles the backoff, anything else halves it."""

    def fetch(url):
        if "limit" in url:
            raise OSError("status 429")
        if "gone" in url:
            raise TimeoutError(url)
        return None if "blank" in url else f"<p>{url}</p>"

    names = ["limit0", "limit1", "page2", "gone3", "blank4"]
    front = spark.createDataFrame([(k, f"http://{h}/{n}", float(k), 0) for h in ("a", "b") for k, n in enumerate(names)], "node_id long, url string, priority double, attempt int")
    hosts = spark.createDataFrame([("b", 4.0), ("c", 3.0)], "host string, backoff double")
    pace = pages.Pace(jitter=0.0, clock=lambda: 50.0, sleep=lambda s: None)
    got = pages.fetch_wave(front, hosts, fetch, pace)
    rows = {(r.host, r.node_id): r for r in got.collect()}
    assert [rows["a", k].backoff for k in range(5)] == [1, 2, 1, 0.5, 0.25]
    assert [rows["a", k].delay for k in range(5)] == [0, 2, 3, 2, 1.5]
    assert [rows["b", k].backoff for k in range(5)] == [8, 10, 5, 2.5, 1.25]
    assert rows["a", 2].html == "<p>http://a/page2</p>" and rows["a", 4].html is None and rows["a", 4].error is None
    retried, given_up = pages.failures(got)
    assert sorted((r.node_id, r.attempt, r.priority) for r in retried.where("node_id = 3").collect()) == [(3, 1, 1.0)] * 2 and given_up.count() == 0
    late = got.withColumn("attempt", F.lit(3))
    assert pages.failures(late)[0].count() == 0 and pages.failures(late)[1].count() == 6
    assert {r.host: r.backoff for r in pages.host_states(got, hosts).collect()} == {"a": 0.25, "b": 1.25, "c": 3.0}


SITE = {f"http://h{k % 3}/{k}": "".join(f'<a href="http://h{j % 3}/{j}">t</a>' for j in ((3 * k + 1) % 40, (7 * k + 2) % 40)) for k in range(40)}


def broken(url):
    """How often a page fails before it is there; some are never."""
    k = int(url.rsplit("/", 1)[1])
    return 9 if k % 11 == 5 else 2 if k % 4 == 1 else 0


def plain_crawl(max_nodes, max_depth, wave):
    nodes, at, tries, done = [(0, "http://h0/0", None, 0, 0.01, 0)], {0: (0, 0.01)}, {}, set()
    turn = 0
    while len(nodes) < max_nodes and max(n[3] for n in nodes) < max_depth:
        front = sorted((n for n in nodes if n[0] not in done), key=lambda n: (at[n[0]][1], n[0]))[:wave]
        if not front:
            break
        turn += 1
        found = {}
        for n in front:
            attempt, priority = at[n[0]]
            tries[n[1]] = tries.get(n[1], 0) + 1
            if tries[n[1]] <= broken(n[1]):
                if attempt + 1 > 3:
                    done.add(n[0])
                at[n[0]] = (attempt + 1, priority - 2)
                continue
            done.add(n[0])
            for pos, url in enumerate(x.split('"')[0] for x in SITE[n[1]].split('href="')[1:]):
                if url not in {m[1] for m in nodes}:
                    found[url] = min(found.get(url, (n[0], pos, n[3])), (n[0], pos, n[3]))
        for url in sorted(found, key=lambda u: (found[u][0], found[u][1], u)):
            parent, _, depth = found[url]
            nodes.append((len(nodes), url, parent, depth + 1, float(depth + 1), turn))
            at[len(nodes) - 1] = (0, float(depth + 1))
    return nodes


@pytest.mark.parametrize("max_nodes", [12, 1000])
def test_crawl_tries_failed_pages_again(spark, tmp_path, max_nodes):
    """A crawl by a client whose pages fail twice, or always, against plain Python; attempts are told by files, as tasks share nothing else."""
    folder, site, fails = str(tmp_path), dict(SITE), {u: broken(u) for u in SITE}

    def fetch(url):
        import os

        name = f"{folder}/{url.replace('/', '_')}"
        n = len([f for f in os.listdir(folder) if f.startswith(f"{os.path.basename(name)}-")])
        with open(f"{name}-{n}", "w"):
            pass
        if n < fails[url]:
            raise TimeoutError(url)
        return site[url]

    seeds = spark.createDataFrame([("http://h0/0",)], "url string")
    pace = pages.Pace(least=0.0, jitter=0.0, clock=lambda: 0.0, sleep=lambda s: None)
    got = crawl(seeds, None, max_nodes, 99, 4, lambda: F.col("depth").cast("double"), fetch=fetch, pace=pace)
    assert sorted((r.node_id, r.url, r.parent_id, r.depth, r.priority, r.wave) for r in got.collect()) == plain_crawl(max_nodes, 99, 4)


def test_pages_in_buckets(spark, tmp_path):
    df = spark.createDataFrame([(f"u{k}", f"h{k}") for k in range(50)] + [(None, "x")], "url string, html string")
    table = pages.PageTable(df, str(tmp_path / "p"), 8)
    front = spark.createDataFrame([("u3", 1), ("u7", 2), ("none", 3), ("u3", 4)], "url string, k long")
    assert {r.k: r.html for r in table.of(front).collect()} == {1: "h3", 2: "h7", 3: None, 4: "h3"}
    assert len(table.of(front.where("k = 1")).inputFiles()) < 8


def test_a_url_with_several_pages_gives_one(spark, tmp_path):
    df = spark.createDataFrame([("a", "h2"), ("a", "h1"), ("a", None), ("b", None), (None, "x"), (None, "y")], "url string, html string")
    front = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5)], "url string, k long")
    want = [(1, "h1"), (2, "h1"), (3, None), (4, None), (5, None)]
    assert sorted((r.k, r.html) for r in pages.from_table(front, df).collect()) == want
    assert sorted((r.k, r.html) for r in pages.PageTable(df, str(tmp_path / "p"), 4).of(front).collect()) == want


# The live view and lineage


def test_late_readers_see_the_whole_log(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice(["started", "completed", "failed", None]), rng.choice([None, k]), rng.choice([None, 1]), rng.choice([None, k % 7])) for k in range(60)]
    df = spark.createDataFrame(rows, "seq long, stage string, phase string, links long, items long, queue long")
    want = sorted(map(repr, live.counters(df).collect()))
    path = str(tmp_path / "view")
    assert live.latest(spark, path)[1:] == (0, -1)
    for n, upto in enumerate((0, 10, 31, 59), 1):
        assert live.publish(df, path, upto) == n
        now, rest = live.hand_over(df, path)
        assert rest.count() == 59 - upto
        assert sorted(map(repr, live.merged(now, live.counters(rest)).collect())) == want
    assert live.publish(df, path) == 4
    assert live.counters(df.where("false")).count() == 0


def test_lineage_takes_few_rounds(spark):
    chain = spark.range(10_000).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    lineage = graph.Lineage(chain)
    got = lineage.ancestors_of(spark.createDataFrame([(9_999,)], "node_id long"))
    assert got.count() == 10_000 and len(lineage.levels) <= 15
    assert sorted(r.node_id for r in lineage.ancestors_of(spark.createDataFrame([(3,), (1,), (3,)], "node_id long")).collect()) == [0, 1, 2, 3]
    lineage.close()
    odd = spark.createDataFrame([(1, 2), (2, 1), (3, None), (4, 77), (None, 1)], "node_id long, parent_id long")
    assert sorted(r.node_id for r in graph.ancestors(odd, spark.createDataFrame([(1,), (4,)], "node_id long")).collect()) == [1, 2, 4, 77]
    assert graph.ancestors(odd, odd.where("false").select("node_id")).count() == 0


# The event source


def test_event_source_gives_each_line_once(spark, tmp_path):
    from loomwork.sources import event_source as source

    class Flaky:
        """Lines of a file; every other call finds the connection gone. Tasks and driver share the file only."""

        def __init__(self, path):
            self.path, self.calls = path, 0

        def _all(self):
            self.calls += 1
            if self.calls % 2:
                raise ConnectionError("gone")
            with open(self.path) as f:
                return f.read().split("\n")[:-1]

        def size(self):
            return len(self._all())

        def lines(self, lo, hi):
            return self._all()[lo:hi]

    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    source.event_source(spark, "test_events", Flaky(path), sleep=lambda s: None, width=7)
    lines = [f'{{"type": "t{k % 3}", "k": {k}}}' if k % 5 else ["{broken", "[1]", '{"type": 4}', "plain"][k // 5 % 4] for k in range(50)]
    for lo, hi in ((0, 20), (20, 20), (20, 50)):
        with open(path, "a") as f:
            f.writelines(x + "\n" for x in lines[lo:hi])
        stream = spark.readStream.format("test_events").load()
        stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    got = sorted(spark.read.parquet(out).collect())
    assert [(r.line, r.payload) for r in got] == list(enumerate(lines))
    assert [r.type for r in got] == [f"t{k % 3}" if k % 5 else None for k in range(50)]
    batch = spark.read.format("test_events").load()
    assert tuple(source.line_counts(batch).first()) == (50, 10)


def test_waits_double():
    from loomwork.sources import event_source as source

    waits, left = [], [6]

    def call():
        left[0] -= 1
        if left[0]:
            raise OSError
        return "there"

    assert source.patient(call, waits.append) == "there" and waits == [1, 2, 4, 8, 15]
    with pytest.raises(ZeroDivisionError):
        source.patient(lambda: 1 / 0, waits.append, 2)


# Stops and bounded dedup


@pytest.mark.parametrize("idle", [None, 4.0, 9.0])
def test_first_stop_against_plain_python(spark, idle):
    from loomwork.operators import lifecycle

    rng = random.Random(4)
    for width in (1, 9000):
        t, rows = 0.0, []
        for k in range(40):
            t += rng.choice([0.5, 1.0, 2.0, 5.0 if k > 12 else 1.0])
            rows.append((k * width, t, rng.choice(["node_added", "other"]), rng.randrange(4), f"u{k}"))
        df = spark.createDataFrame(rows, "seq long, t double, type string, depth int, url string").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
        for limits in ((15, 9, None, 1e9), (99, 9, "u3", 1e9), (99, 9, None, 20.0), (99, 3, None, 1e9)):
            want, nodes, latest, last = None, 0, None, None
            for seq, at, kind, depth, url in rows:
                added = kind == "node_added"
                nodes += added
                if idle is not None and latest is not None and at - latest >= idle:
                    want = (last, "NO_PROGRESS")
                elif added and nodes >= limits[0]:
                    want = (seq, "MAX_NODES")
                elif added and depth >= limits[1]:
                    want = (seq, "MAX_DEPTH")
                elif added and limits[2] and limits[2] in url:
                    want = (seq, "TARGET_REACHED")
                elif at - rows[0][1] >= limits[3]:
                    want = (seq, "MAX_TIME")
                latest, last = at, seq
                if want:
                    break
            got = [(r.stop_seq, r.reason) for r in lifecycle.first_stop(df, *limits, idle=idle).collect()]
            assert got == ([want] if want else [])


def test_first_seen_with_bounded_state(spark, tmp_path):
    from loomwork.streaming import events as S

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, ts timestamp"
    for rows in ([("a", 0), ("a", 10), ("b", 20)], [("a", 30), ("c", 9000)], [("c", 9010), ("d", 9020)]):
        spark.createDataFrame(rows, "k string, t long").select("k", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        S.run_to(S.first_seen(spark.readStream.schema(schema).parquet(source), ["k"], "1 hour"), out, f"{out}-state")
    assert sorted(r.k for r in spark.read.schema(schema).parquet(out).collect()) == ["a", "b", "c", "d"]


def test_thresholds_in_order():
    from loomwork.sources import blueprint
    from test_functions import spec

    given = spec()
    given["scoring"]["params"] |= {"low_threshold": 0.4, "high_threshold": 0.7}
    assert blueprint.translate(given)["scoring"]["params"]["low_threshold"] == 0.4
    given["scoring"]["params"]["high_threshold"] = 0.4
    with pytest.raises(blueprint.SpecError):
        blueprint.translate(given)
