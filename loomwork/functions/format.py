"""Texts for reports: durations, shares, ids, ages, previews, error classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duration(ms: Column) -> Column:
    return F.when(ms.isNull(), "-").when(ms < 1000, F.format_string("%d ms", F.round(ms).cast("long"))).otherwise(F.format_string("%.1f s", ms / 1000))


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", F.coalesce(share, F.lit(0.0)) * 100)


def short_id(value: Column, n: int = 8) -> Column:
    return F.when(F.length(value) > n, F.concat(F.left(value, F.lit(n)), F.lit("…"))).otherwise(value)


def relative_age(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.concat(F.round(seconds).cast("long").cast("string"), F.lit("s ago")))
        .when(seconds < 3600, F.concat(F.round(seconds / 60).cast("long").cast("string"), F.lit("m ago")))
        .otherwise(F.concat(F.round(seconds / 3600).cast("long").cast("string"), F.lit("h ago")))
    )


def preview(text: Column, n: int = 80) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n)), F.lit("…"))).otherwise(flat)


def is_rate_limit(message: Column) -> Column:
    return F.coalesce(F.contains(message, F.lit("429")) | F.contains(message, F.lit("Too Many Requests")), F.lit(False))


def error_class(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("timeout")), "timeout").when(F.contains(low, F.lit("connect")), "connection").when(F.contains(low, F.lit("response")) | F.contains(low, F.lit("http")), "http_error").otherwise("unknown")


def request_delay(elapsed: Column, backoff: Column, jitter: Column) -> Column:
    """What is left of a second since the last request, the backoff and the given jitter."""
    return F.greatest(1 - elapsed, F.lit(0.0)) + backoff + jitter


def matches_search(url: Column, query: str) -> Column:
    """Case-blind substring; a blank query matches all."""
    return F.contains(F.lower(url), F.lit(query.strip().lower()))


def link_text(url: Column, anchor: Column, context: Column) -> Column:
    """What stands for a link where texts are embedded; parts that are null are empty."""
    parts = zip(("[URL]", " [ANCHOR]", " [CTX]"), (url, anchor, context), strict=True)
    return F.concat(*[x for mark, c in parts for x in (F.lit(mark), F.coalesce(c, F.lit("")))])


def crawl_id(template: Column, started: Column) -> Column:
    """The template's name up to its first dot, and the time of the start."""
    return F.concat(F.substring_index(template, ".", 1), F.lit("-"), F.date_format(started, "yyyy-MM-dd_HH:mm:ss"))


def at_path(document: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where the path, or the text, leads nowhere."""
    return F.get_json_object(document, "$" + "".join(f"['{name}']" for name in path.split(".")))


def json_lines(df: DataFrame, column: str) -> DataFrame:
    """df with each line of a text that isn't blank: line_no from 1, line, and payload, which is null if it isn't JSON."""
    flat = df.select(*[c for c in df.columns if c != column], F.posexplode(F.split(column, "\r?\n")).alias("line_no", "line"))
    return flat.where(F.trim("line") != "").withColumns({"line_no": F.col("line_no") + 1, "payload": F.try_parse_json("line")})
