"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Only DataFrame functions are used. A null text is an empty one; it has no spans. Rows with equal doc_id
are treated one by one, further columns are ignored by find() and kept by redact(). The patterns are
possessive and start at the beginning of a run, so their time is linear in the text's length; what they
match is the leftmost, greedy match of the plain patterns. Matches are placed in chunks, so that a text with
very many of them takes time in proportion too. An account number takes as many groups as follow it, so one before a word in
capitals is read with it and dropped, if the whole has no valid check digits. An empty table gives an empty one. Context words count before and after a span, as far as the
next match of the same kind.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """needs: a text without this substring has no match. always: kept whatever the score."""

    name: str
    pattern: str
    context: str
    score: float
    always: bool = True
    needs: str | None = None


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"(?i)\b(?:e-?mail|mail|contact|write)\b", 0.7, needs="@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"(?i)\b(?:ip|host|server|address|login)\b", 0.6, needs="."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"(?i)\b(?:card|visa|mastercard|credit|payment|account)\b", 0.7),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"(?i)\b(?:phone|tel|call|mobile|fax|cell)\b", 0.6, needs="+"),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])", r"(?i)\b(?:iban|bank|account|transfer|konto)\b", 0.6, always=False),
    Kind("secret", r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])", r"(?i)\b(?:token|secret|key|password|passwd|api)\b", 0.3, always=False),
)
BASE = ("email", "ip", "card", "phone")
ORDER = [k.name for k in KINDS]
#: Added by a context word among the CONTEXT_CHARS before or after the span; spans that aren't always kept need KEEP_AT.
CONTEXT_BONUS = 0.3
CONTEXT_CHARS = 40
KEEP_AT = 0.5
#: Matches that are placed one after the other; results of chunks are put together afterwards.
CHUNK = 128
SPANS = "array<struct<start:bigint,ord:int,end:bigint,kind:string,score:double>>"
#: The phone is taken before the card and the address, which it may contain.
REDACT_ORDER = ("email", "phone", "card", "ip", "iban", "secret")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn check digit."""
    each = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the remainder of an account number, letters as 10 to 35, is one."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.left(iban, F.lit(4)))
    value = F.transform(_chars(turned), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda a, x: F.when(x > 9, a * 100 + x).otherwise(a * 10 + x) % 97) == 1


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(part, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p.cast("int")).otherwise(999) <= 255))
    if kind == "card":
        digits = F.regexp_replace(match, r"[\x20-]", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(match, r"[^0-9]", "")).between(10, 15)
    if kind == "iban":
        plain = F.regexp_replace(match, r"\x20", "")
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    return F.lit(True)


def _gaps(kind: Kind, text: Column) -> Column:
    """The text around the matches: one part more than there are matches."""
    return F.split(text, kind.pattern, -1)


def _matches(kind: Kind, text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    return F.when(text.contains(kind.needs), found).otherwise(F.array().cast("array<string>")) if kind.needs else found


def _score(kind: Kind, before: Column, after: Column) -> Column:
    near = F.right(before, F.lit(CONTEXT_CHARS)).rlike(kind.context) | F.left(after, F.lit(CONTEXT_CHARS)).rlike(kind.context)
    return F.lit(kind.score) + F.when(near, CONTEXT_BONUS).otherwise(0.0)


def _accepted(kind: Kind, match: Column, before: Column, after: Column) -> Column:
    ok = valid(kind.name, match)
    return ok if kind.always else ok & (_score(kind, before, after) >= KEEP_AT)


def _let(value: Column, body) -> Column:
    """body(value) with the value worked out once, and standing once in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _around(matches: Column, gaps: Column) -> Column:
    """Each match with the text before it (g) and after it (h), as far as the next matches."""
    n = F.size(matches)
    before = F.zip_with(matches, F.slice(gaps, 1, n), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    return F.zip_with(before, F.slice(gaps, 2, n), lambda x, h: F.struct(x.m.alias("m"), x.g.alias("g"), h.alias("h")))


def _chunks(items: Column) -> Column:
    """An array in parts of CHUNK members; an empty one has no parts."""

    def parts(held):
        n = F.size(held)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.transform(F.sequence(at, F.least(at + CHUNK, n) - 1), lambda k: F.get(held, k)))

    return _let(items, parts)


def _placed(k: Kind, order: int) -> Column:
    """Accepted matches with their places, by one pass over the matches and the text around them."""

    def step(acc, x):
        start = acc.pos + F.length(x.g)
        end = start + F.length(x.m)
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(k.name).alias("kind"), F.round(_score(k, x.g, x.h), 2).alias("score"))).cast(SPANS)
        return F.struct(end.alias("pos"), F.concat(acc.out, F.when(_accepted(k, x.m, x.g, x.h), one).otherwise(F.array().cast(SPANS))).alias("out"))

    def place(part, at):
        return F.aggregate(part, F.struct(at.alias("pos"), F.array().cast(SPANS).alias("out")), step, lambda acc: acc.out)

    def place_all(parts):
        sizes = F.transform(parts, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda n, x: n + F.length(x.g) + F.length(x.m)))
        begins = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(parts, F.slice(begins, 1, F.size(parts)), place))

    return _let(_chunks(_around(F.col(f"m_{k.name}"), F.col(f"g_{k.name}"))), place_all)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array<struct<start, ord, end, kind, score>> by start, then kind as listed; code points."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumns({f"m_{k.name}": _matches(k, F.col("text")) for k in KINDS})
    df = df.withColumns({f"g_{k.name}": F.when(F.size(f"m_{k.name}") > 0, _gaps(k, F.col("text"))) for k in KINDS}).drop("text")
    for order, k in enumerate(KINDS):
        df = df.withColumn(f"s_{k.name}", F.when(F.size(f"m_{k.name}") > 0, _placed(k, order)).otherwise(F.array().cast(SPANS)))
    return df.select("doc_id", F.array_sort(F.concat(*[F.col(f"s_{k.name}") for k in KINDS])).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def _same(name: str, kind: Column) -> Column:
    return kind == name


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans as text."""
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    kinds = F.transform("spans", lambda s: s.kind)
    counts = [F.size(F.filter(kinds, partial(_same, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _replaced(k: Kind, text: Column) -> Column:
    """The text with accepted matches of one kind replaced."""

    def marked(x):
        return F.concat(x.g, F.when(_accepted(k, x.m, x.g, x.h), f"[{k.name.upper()}]").otherwise(x.m))

    def joined(found):
        return F.concat(F.array_join(F.transform(_around(found.m, found.g), marked), ""), F.element_at(found.g, -1))

    def one(t):
        return _let(_matches(k, t), lambda m: F.when(F.size(m) > 0, _let(F.struct(m.alias("m"), _gaps(k, t).alias("g")), joined)).otherwise(t))

    return _let(text, one)


def redact(docs: DataFrame) -> DataFrame:
    """The same columns, accepted spans in text replaced by [KIND]; kinds go one after the other."""
    text = F.col("text")
    for name in REDACT_ORDER:
        text = _replaced(KINDS[ORDER.index(name)], text)
    return docs.withColumn("text", text)
