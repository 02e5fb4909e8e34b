"""Text lines out of events by templates: a table of type and template instead of code for each type.

A template is text with {field} or {field:kind} in it. Kinds: plain (as text), round2 (two decimals at most, as a shortest
number), fixed2 and fixed4 (so many decimals), decoded (percent-decoded where that is possible), cut (80 characters at most),
short6 (six characters), size (of a list), tail (what follows the last slash). What is null is empty, a size 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.urls import unquoted

FIELD = re.compile(r"\{(\w+)(?::(\w+))?\}")
WIDTH = 80
KINDS = {
    "plain": lambda c: c.cast("string"),
    "round2": lambda c: F.regexp_replace(F.format_string("%.2f", c.cast("double")), r"\.?0+$", ""),
    "fixed2": lambda c: F.format_string("%.2f", c.cast("double")),
    "fixed4": lambda c: F.format_string("%.4f", c.cast("double")),
    "decoded": lambda c: F.coalesce(unquoted(c), c),
    "cut": lambda c: F.left(c, F.lit(WIDTH)),
    "short6": lambda c: F.left(c.cast("string"), F.lit(6)),
    "size": lambda c: F.coalesce(F.size(c), F.lit(0)).cast("string"),
    "tail": lambda c: F.substring_index(c, "/", -1),
}

#: The lines of the narrative log, which readers of such logs look for, by type.
NARRATIVE = {
    "CREATED": "[NODE] id={node_id} → CREATED url={url:decoded} depth={depth}",
    "FETCHED": "[NODE] id={node_id} → FETCHED",
    "FILTERED": "[NODE] id={node_id} → FILTERED (links={links:size}, items={items:size})",
    "TRANSFORMED": "[NODE] id={node_id} → TRANSFORMED (items={items:size})",
    "SCORED": "[NODE] id={node_id} → SCORED (links={links:size})",
    "EXPANDED": "[NODE] id={node_id} → EXPANDED (children={links:size})",
    "EXPORTED": "[EXPORT] COMPLETED table={table} inserted={n} duration_ms={duration:round2}",
    "RESCHEDULED": "[SCORE_RESCHEDULE] [NODE] id={node_id} new_priority={priority}",
    "STOPPED": "[CRAWL] STOPPED reason={reason} nodes={n} depth={depth} duration={duration:round2}s",
}
#: What an event is in short, by type.
SUMMARY = {
    "NODE_ADDED": "{url:tail}",
    "NODE_STATE_CHANGED": "{node_id:short6}… → {state}",
    "NODE_EXPANDED": "{parent_id:short6}… → {n} children",
    "SNAPSHOT_FULL": "{nodes:size} nodes",
    "CRAWL_STOPPED": "{reason}",
    "PIPELINE_EVENT": "{stage} {phase}",
    "NODE_SCORED_DETAIL": "{node_id:short6}… priority={priority:fixed2}",
    "NODE_ERROR": "{stage}: {error}",
}


def rendered(template: str, columns: set[str]) -> Column:
    """The template over the columns; a field that isn't there, or an unknown kind, is an error."""
    parts, at = [], 0
    for m in FIELD.finditer(template):
        name, kind = m[1], m[2] or "plain"
        if name not in columns or kind not in KINDS:
            raise ValueError(f"template {template!r}: no field {name!r} or no kind {kind!r}")
        parts += [F.lit(template[at : m.start()]), F.coalesce(KINDS[kind](F.col(name)), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def by_type(events: DataFrame, templates: dict[str, str], kind: str = "type") -> Column:
    """The line of each event by its type, null for types without a template. Templates whose fields are missing are errors."""
    names, out = set(events.columns), None
    for value, template in templates.items():
        line = rendered(template, names)
        out = F.when(F.col(kind) == value, line) if out is None else out.when(F.col(kind) == value, line)
    return F.lit(None).cast("string") if out is None else out


def prefix(ts: Column, worker: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("][W"), worker.cast("string"), F.lit("]"))


def narrative(events: DataFrame, order: str = "seq", templates: dict[str, str] | None = None) -> DataFrame:
    """(order, line) of events(order, ts, worker, type, ...) that have a template, NARRATIVE's unless others are given."""
    line = by_type(events, NARRATIVE if templates is None else templates)
    return events.select(order, F.concat(prefix(F.col("ts"), F.col("worker")), F.lit(" "), line).alias("line")).where("line is not null")


def clock_time(ts: Column) -> Column:
    """Hours to milliseconds in the session's zone; empty without a time."""
    return F.coalesce(F.date_format(ts, "HH:mm:ss.SSS"), F.lit(""))


def summary(events: DataFrame) -> Column:
    """An event in short: a detail of a stage follows a dash, candidates are counted, an added node without a name shows its number."""
    line = by_type(events, SUMMARY)
    n = F.coalesce(F.size("candidates"), F.lit(0))
    counted = F.concat(n.cast("string"), F.when(n == 1, " link ").otherwise(" links "), F.when(F.col("decision") == "dropped", "dropped").otherwise("trusted"))
    return (
        F.when((F.col("type") == "NODE_ADDED") & (F.coalesce(F.substring_index("url", "/", -1), F.lit("")) == ""), F.col("node_id").cast("string"))
        .when((F.col("type") == "PIPELINE_EVENT") & F.col("detail").isNotNull(), F.concat(line, F.lit(" — "), F.col("detail")))
        .when(F.col("type") == "CANDIDATE_EVALUATED", counted)
        .otherwise(F.coalesce(line, F.lit("")))
    )
