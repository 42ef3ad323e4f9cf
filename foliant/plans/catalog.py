"""All queries of the library and their SQL."""

from __future__ import annotations

from foliant.plans import layout_queries, link_queries, scalar_queries

MODULES = (scalar_queries, layout_queries, link_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
