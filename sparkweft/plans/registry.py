"""All registered queries of the retrieval engine and their SQL."""

from __future__ import annotations

from sparkweft.plans import analytics_queries, document_queries, edit_queries, graph_queries, lookup_queries, rebuild_queries, retrieval_queries, stream_queries, table_queries

_MODULES = (graph_queries, document_queries, retrieval_queries, analytics_queries, edit_queries, rebuild_queries, lookup_queries, table_queries, stream_queries)

QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
