"""All registered queries over the reference tables, and their SQL."""

from __future__ import annotations

from . import correction_sql, metric_queries, pair_queries, text_queries

_MODULES = (text_queries, pair_queries, metric_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in (*_MODULES, correction_sql) for name, sql in m.SQL.items()}
