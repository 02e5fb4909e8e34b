"""Transform chains of item fields as column expressions; seven named steps, more can be registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A step takes (column, whether it is a list, its options) and gives (column, whether that is a list).
Step = Callable[[Column, bool, dict], tuple[Column, bool]]
STEPS: dict[str, Step] = {}
DEFAULT_MAX_LEN = 300


def register_transform(name: str, step: Step) -> None:
    STEPS[name] = step


def _text(c: Column, is_list: bool, sep: str = " ") -> Column:
    return F.array_join(c, sep) if is_list else c


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind that Unicode knows."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _regex(c, is_list, options):
    """First match, its group 1 if the pattern has groups; null without a match."""
    pattern = options.get("pattern")
    if not pattern:
        return c, is_list
    c = _text(c, is_list)
    group = 1 if re.compile(pattern).groups else 0
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group)), False


def _regex_extract(c, is_list, options):
    """All matches, as a list."""
    pattern = options.get("pattern")
    if not pattern:
        return c, is_list
    groups = re.compile(pattern).groups
    if groups > 1:
        raise ValueError("regex_extract takes patterns with one group at most")
    return F.regexp_extract_all(_text(c, is_list), F.lit(pattern), F.lit(groups)), True


def _deduplicate(c, is_list, options):
    """The first of elements that are equal without case and outer blanks; other values pass."""
    if not is_list:
        return c, False
    marked = F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x, i: F.struct(F.lower(strip(x)).alias("n"), i.alias("i"), x.alias("x")))

    def firsts(z):
        """Of members sorted by (n, i), the first of each n, back in their order; z is sorted once."""
        new = F.filter(z, lambda s, k: (k == 0) | (s.n != F.get(z, k - 1).n))
        return F.transform(F.array_sort(F.transform(new, lambda s: F.struct(s.i.alias("i"), s.x.alias("x")))), lambda s: s.x)

    return F.element_at(F.transform(F.array(F.array_sort(marked)), firsts), 1), True


register_transform("regex", _regex)
register_transform("regex_extract", _regex_extract)
register_transform("lowercase", lambda c, is_list, o: (c if is_list else F.lower(c), is_list))
register_transform("strip", lambda c, is_list, o: (c if is_list else strip(c), is_list))
register_transform("join", lambda c, is_list, o: (_text(c, is_list, o.get("sep", " ")), False))
register_transform("truncate", lambda c, is_list, o: (F.left(_text(c, is_list), F.lit(o.get("max_len", DEFAULT_MAX_LEN))), False))
register_transform("deduplicate", _deduplicate)


def chain(c: Column, steps: list[dict], is_list: bool = False, none_as_text: bool = False) -> Column:
    """All steps in order; unknown names are skipped. none_as_text: join and truncate turn null into "None"."""
    for options in steps:
        step = STEPS.get(options.get("type"))
        if step:
            c, is_list = step(c, is_list, options)
            if none_as_text and options["type"] in ("join", "truncate"):
                c = F.coalesce(c, F.lit("None"))
    return c
