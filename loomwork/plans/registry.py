"""All queries of the analytics operators and their SQL for DuckDB."""

from __future__ import annotations

from loomwork.plans import queries_events, queries_pages, queries_reports, queries_space, queries_text

MODULES = (queries_pages, queries_text, queries_space, queries_events, queries_reports)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
