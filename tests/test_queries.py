"""Every registered query against its SQL, over the driver's small tables."""

import hashlib
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from loomwork.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(table, columns):
    found = [tuple(None if r[k] is None else repr(r[k]) if isinstance(r[k], float) else str(r[k]) for k in columns) for r in table.to_pylist()]
    return sorted(found, key=lambda r: tuple((x is None, x or "") for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toArrow()
    want = duck.execute(ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got, sorted(got.column_names)) == rows(want, sorted(got.column_names))


def test_every_query_but_the_loop_has_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"crawl_loop", "crawl_cascade"}


def plain_crawl(spark, judge, priority):
    """(node_id, url, parent_id, depth, priority, wave) of a crawl in plain Python."""
    pages = {f"p{k}": r.html for k, r in enumerate(spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect())}
    links = {u: [(pos, href, text) for pos, (href, text) in enumerate(re.findall(r'<a href="([^"]*)">([^<]*)</a>', h))] for u, h in pages.items()}
    nodes = [(0, "p0", None, 0, 0.01, 0), (1, "p1", None, 0, 0.01, 0)]
    visited, wave = set(), 0
    while len(nodes) < 60 and max(n[3] for n in nodes) < 6:
        front = sorted((n for n in nodes if n[0] not in visited), key=lambda n: (n[4], n[0]))[:10]
        if not front:
            break
        wave += 1
        visited |= {n[0] for n in front}
        found, known = {}, {n[1] for n in nodes}
        for n in front:
            for pos, href, text in links[n[1]]:
                # The page's own address is its name here, so that relative links keep their path.
                url = f"p{part(href) % len(pages)}"
                if url not in known:
                    found[url] = min(found.get(url, (n[0], pos, n[3], text)), (n[0], pos, n[3], text))
        scores = judge(found)
        kept = sorted((u for u in found if u in scores), key=lambda u: (found[u][0], found[u][1], u))
        nodes += [(len(nodes) + k, u, found[u][0], found[u][2] + 1, round(priority(scores[u], found[u][2] + 1, found[u][3]), 6), wave) for k, u in enumerate(kept)]
    return nodes


def part(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def crawled(spark, name):
    return sorted((r.node_id, r.url, r.parent_id, r.depth, round(r.priority, 6), r.wave) for r in QUERIES[name](spark, SF).collect())


def test_crawl_loop(spark):
    """The whole table of nodes against a crawl in plain Python."""
    assert crawled(spark, "crawl_loop") == plain_crawl(spark, lambda found: dict.fromkeys(found), lambda _, depth, text: depth + len(text) / 100.0)


def test_crawl_cascade(spark):
    """The same with the cascade: buckets, budgets, choices by md5, the model's answers, and what is trusted."""

    def judge(found):
        out = {}
        for parent in {f[0] for f in found.values()}:
            groups = {"low": [], "mid": [], "high": []}
            for u in (u for u, f in found.items() if f[0] == parent):
                s = part(u) % 100 / 100
                groups["low" if s < 0.3 else "high" if s > 0.7 else "mid"].append((s, u))
            dice = lambda x: (hashlib.md5(f"seed{x[1]}".encode()).hexdigest(), x[1])
            low = sorted(groups["low"], key=dice)[: int(len(groups["low"]) * 0.5)]
            budget = int(len(groups["high"]) * 0.5)
            chance = sorted(groups["high"], key=dice)[: int(budget * 0.5)]
            rest = sorted((x for x in groups["high"] if x not in chance), key=lambda x: (-x[0], x[1]))
            best = rest[: budget - int(budget * 0.5)]
            for _, u in low + groups["mid"] + chance + best:
                out[u] = 0 if u.endswith("7") else min(100, 10 * len(found[u][3]))
            for s, u in rest[len(best) :]:
                out[u] = int(s * 100 + 0.5)
        return out

    assert crawled(spark, "crawl_cascade") == plain_crawl(spark, judge, lambda score, depth, _: 100.0 - score + depth)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
