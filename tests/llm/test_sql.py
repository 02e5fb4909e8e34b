"""The numbered queries that have SQL, against DuckDB over the driver's small tables."""

import random

import duckdb
import pytest

from loomwork.llm import pii
from loomwork.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    with duckdb.connect() as c:
        for t in ("documents", "conversations"):
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = c.execute(ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) == len(want)
    assert sorted(map(tuple, got[cols].astype(str).values)) == sorted(map(tuple, want[cols].astype(str).values))


def brute_iban(text):
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_account_numbers_and_secrets_match_sql(spark, tmp_path):
    """Account numbers with valid and invalid check digits, secrets with context words on either side."""
    rng, rows = random.Random(4), []
    for k in range(400):
        body = "".join(rng.choices("ABCDXYZ0123456789", k=rng.choice([11, 12, 16, 20, 24, 30])))
        plain = next(f"{c}{d:02d}{body}" for c in ("GB", "DE") for d in range(2, 99) if brute_iban(f"{c}{d:02d}{body}"))
        if k % 3 == 0:
            plain = plain[:-1] + rng.choice("ABC123")
        number = " ".join(plain[j : j + 4] for j in range(0, len(plain), 4)) if k % 2 else plain
        secret = "".join(rng.choices("0123456789abcdef", k=rng.choice([31, 32, 40, 64, 65])))
        words = ["konto", "iban", number, number + ".", "_" + number, secret, secret + "!", "token", "the key is", "monkey", "a@b.cd", "x" * 38, "\n", ","]
        rows.append((k, " ".join(rng.choices(words, k=rng.randint(1, 12)))))
    rows += [(None, None), (7, ""), (7, "key " + "a" * 32), (7, "key " + "a" * 32)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.digest(pii.find(df)).toPandas()
    path = str(tmp_path / "documents.parquet")
    df.toPandas().to_parquet(path)
    with duckdb.connect() as c:
        c.execute(f"create view documents as select doc_id::bigint as doc_id, text from '{path}'")
        want = c.execute(ORACLE_SQL["op6_pii"]).df()
    assert sum("iban" in x for x in want["spans"]) > 50 and sum("secret" in x for x in want["spans"]) > 50
    text = lambda d: sorted(map(tuple, d[sorted(d.columns)].fillna(-1).astype({"doc_id": int}).astype(str).values))
    assert text(got) == text(want)
    for r, spans in [(t, s) for (d, t), s in zip(rows, got["spans"], strict=True) if d is not None]:
        for kind, lo, hi in (x.split(":") for x in spans.split(",") if x):
            assert kind != "iban" or brute_iban(r[int(lo) : int(hi)])
