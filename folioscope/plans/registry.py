"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from . import form_queries, gate_queries, identity_queries, page_queries, pair_queries, registry_queries, score_queries, stats_queries, text_queries

_MODULES = (text_queries, form_queries, gate_queries, pair_queries, page_queries, identity_queries, stats_queries, registry_queries, score_queries)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
