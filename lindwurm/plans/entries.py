"""All queries of the core and their SQL."""

from __future__ import annotations

from lindwurm.plans import record_queries, spatial_queries, table_queries

MODULES = (spatial_queries, table_queries, record_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
