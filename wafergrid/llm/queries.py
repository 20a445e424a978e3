"""All queries of the subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from wafergrid.llm import level_queries, overlap_queries, sample_queries, text_queries, vector_queries

_MODULES = (sample_queries, vector_queries, overlap_queries, text_queries, level_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
