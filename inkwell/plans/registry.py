"""All registered queries of the analytics engine and their SQL equivalents."""

from __future__ import annotations

from inkwell.plans import answer_queries, document_queries, layout_queries, retrieval_queries, scalar_queries, source_queries, stats_queries, text_queries

MODULES = (retrieval_queries, stats_queries, text_queries, document_queries, scalar_queries, layout_queries, source_queries, answer_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL: dict = {k: v for m in MODULES for k, v in m.SQL.items()}
