"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

The labelled table has two parts. One is drawn by a rule from short word lists: hosts of either kind are made of a
kind's words, partly joined to invented names; paths are drawn apart from hosts, and most say nothing. The other is
written by hand (url_labels), each host with a few ends and subdomains. Ends and subdomains are the same for both kinds.
Hosts are split: FIT tenths of them fit the weights, CALIBRATE calibrate the probability, and the rest is for tests.
The word lists carry what is found among invented hosts; on hosts written by hand that took no part, the model is weak
(figures in the README), so a user with a labelled table of their own should give it to train().

Host and path of a null url, or one without ``://``, are both empty; such rows and repeated page_ids are
judged like any other, one by one. Further columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import random
import re
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import logistic, url_labels
from loomwork.llm.common import arrow_rows, mix64

#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with its path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DIGIT = re.compile("[0-9]")
BITS = 15
SCALE = 10.0
#: The lowest tenth at which at most 3 in 100 of the drawn plain hosts that calibrate are blocked.
BLOCK_AT = 0.6
#: Hosts of each kind in the labelled table, and urls of each.
HOSTS, URLS = 2000, 1
#: Urls of each host that is written by hand.
VARIANTS = 4
#: Of every ten hosts, so many fit, and so many after them calibrate.
FIT, CALIBRATE = 6, 2

UNWANTED = "casino bet bets poker slots jackpot bingo lotto win prize bonus free cheap pills viagra cialis pharma meds adult porn xxx sex cams nude dating escort crack keygen warez torrent download hack spam farm ads click track banner popup redirect affiliate loan payday credit fast cash money rich forex crypto replica watches".split()
WANTED = "news daily times post library docs manual guide wiki archive museum school college university campus science research journal physics history nature garden kitchen recipe travel city town council health clinic family sport music radio film theatre book books reading paper letter studio design code data open forum market house home green river mountain valley coast".split()
SYLLABLES = "ba be bi bo bu da de di do du fa fe fi fo ga go ha he ho ka ke ki ko la le li lo lu ma me mi mo mu na ne ni no nu pa pe pi po ra re ri ro ru sa se si so su ta te ti to tu va ve vi vo wa we wi th ng nt st er an in on al or".split()
SUBDOMAINS = ("", "", "www.", "blog.", "m.", "shop.", "en.")
ENDS = ("com", "net", "org", "info", "de", "fr", "es", "co.uk", "example.com", "example.net", "example.org")
PLAIN_PATHS = ("", "/", "/en/{n}", "/fr/{n}.html", "/de/{n}/", "/es/{n}", "/article/{n}", "/p/{n}", "/index.html", "/about", "/{w}", "/{w}/{n}", "/page/{n}/{w}")


def _name(rng: random.Random, words: list[str]) -> str:
    invented = "".join(rng.choices(SYLLABLES, k=rng.randint(2, 4)))
    parts = rng.choice(([rng.choice(words), rng.choice(words)], [rng.choice(words), invented], [invented, rng.choice(words)], [rng.choice(words)]))
    return rng.choice(("-", "-", "")).join(parts) + (str(rng.randint(1, 999)) if rng.random() < 0.15 else "")


def labelled_urls(seed: int = 0) -> list[tuple[str, str, int, int]]:
    """The small labelled table: (host, path, 1 to block, tenth of the hosts that it is in)."""
    rng, rows = random.Random(seed), []
    for k in range(2 * HOSTS):
        label = k % 2
        if label:
            name = _name(rng, UNWANTED)
        else:  # half of the plain hosts are invented names without a word
            name = _name(rng, WANTED) if rng.random() < 0.5 else "".join(rng.choices(SYLLABLES, k=rng.randint(2, 5)))
        host = f"{rng.choice(SUBDOMAINS)}{name}.{rng.choice(ENDS)}"
        for _ in range(URLS):
            word = rng.choice(UNWANTED if label and rng.random() < 0.4 else WANTED)
            rows.append((host, rng.choice(PLAIN_PATHS).format(n=rng.randint(1, 9999), w=word), label, zlib.crc32(host.encode()) % 10))
    return rows


def own_name(host: str) -> str:
    """A host without www and its last labels of up to four letters."""
    labels = host.removeprefix("www.").split(".")
    while len(labels) > 1 and len(labels[-1]) <= 4:
        labels.pop()
    return ".".join(labels)


def written_urls(seed: int = 1) -> list[tuple[str, str, int, int]]:
    """The hosts that are written by hand, VARIANTS urls of each, the first with its own path."""
    rng, rows = random.Random(seed), []
    for host, path, label in url_labels.labelled_urls():
        name = own_name(host)
        for k in range(VARIANTS):
            rest = path if k == 0 else rng.choice(PLAIN_PATHS).format(n=rng.randint(1, 9999), w="page")
            rows.append((f"{rng.choice(SUBDOMAINS)}{name}.{rng.choice(ENDS)}", rest, label, zlib.crc32(name.encode()) % 10))
    return rows


def grams(host: str, path: str) -> list[np.ndarray]:
    """Buckets of the 3-, 4- and 5-grams of bytes of host and of path, with marked ends, kept apart; all digits are alike."""
    out = []
    for seed, part in ((1, f"^{host}$"), (2, f"^{path}$")):
        raw = np.frombuffer(DIGIT.sub("0", part).encode(), np.uint8).astype(np.uint64)
        h, found = raw, []
        for n in range(2, 6):
            h = h[: max(0, len(raw) - n + 1)] * np.uint64(0x100000001B3) + raw[n - 1 :]
            if n > 2:
                found.append(mix64(h + np.uint64(n * 2**32 + seed)) >> np.uint64(64 - BITS))
        out.append(np.concatenate(found).astype(np.int64))
    return out


def margin_of(model: logistic.LogisticModel, host: str, path: str) -> float:
    """The mean weights of the host's and of the path's grams, added up."""
    return model.bias + SCALE * sum(float(model.weights[g].mean()) for g in grams(host, path) if len(g))


def train(rows: list[tuple[str, str, int, int]] | None = None) -> logistic.LogisticModel:
    """Fit on a small table of labelled urls, by default both parts of the table; calibrated on hosts that aren't fitted."""
    data, held = [], []
    for host, path, label, tenth in rows or labelled_urls() + written_urls():
        if tenth >= FIT + CALIBRATE:
            continue
        at, value = [], []
        for g in grams(host, path):
            some, n = np.unique(g, return_counts=True)
            at.append(some)
            value.append(SCALE * n / max(1, len(g)))
        data.append((label, np.concatenate(at), np.concatenate(value)))
        held.append(tenth >= FIT)
    return logistic.fit(data, 1 << BITS, rounds=150, l2=1e-3, held=np.array(held))


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    rest = F.when(F.col(url).contains("://"), F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumns({"host": lower, "path": path})


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds the longest fitting rule and what it says, null if none fits."""
    name, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    fits = []
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        on = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits.append((on & F.col("path").startswith(path), host + path, verdict))
    if fits:
        name = reduce(lambda c, x: c.when(x[0], x[1]), fits[1:], F.when(fits[0][0], fits[0][1]))
        says = reduce(lambda c, x: c.when(x[0], x[2]), fits[1:], F.when(fits[0][0], fits[0][2]))
    return df.withColumns({"rule": name, "rule_verdict": says})


def judge(pages: DataFrame, model: logistic.LogisticModel | None = None, rules=RULES, block_at: float = BLOCK_AT) -> DataFrame:
    """page_id, host, path, rule, verdict and the classifier's probability that the url is unwanted."""
    model = model or train()
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("block_prob", pa.float64())])

    def of(batch: pa.RecordBatch) -> dict:
        hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
        p = model.probability(np.array([margin_of(model, h, p) for h, p in zip(hosts, paths, strict=True)]))
        verdict = [r or ("block" if x >= block_at else "allow") for r, x in zip(batch.column("rule_verdict").to_pylist(), p.tolist(), strict=True)]
        return {"page_id": batch.column("page_id"), "host": hosts, "path": paths, "rule": batch.column("rule"), "verdict": verdict, "block_prob": p}

    parts = with_rule(with_parts(pages.select(F.col("page_id").cast("long").alias("page_id"), "url")), rules).drop("url")
    return parts.mapInArrow(arrow_rows(schema, of), "page_id long, host string, path string, rule string, verdict string, block_prob double")
