"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_absolute(url: Column) -> Column:
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")


def hostname(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), r"^www\.", "")


def path_and_query(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def unquoted(url: Column) -> Column:
    """Percent-decoded, plus signs kept; null if it can't be decoded."""
    return F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))


def last_segment(url: Column) -> Column:
    """What stands for an empty anchor: the last path segment with blanks for hyphens."""
    return F.replace(F.element_at(F.split(url, "/"), -1), F.lit("-"), F.lit(" "))
