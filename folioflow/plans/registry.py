"""Registered queries and their DuckDB equivalents, gathered from the query modules."""

from __future__ import annotations

from folioflow.plans import calls_queries, flow_queries, layout_queries, segment_queries, text_queries

_MODULES = (segment_queries, calls_queries, layout_queries, text_queries, flow_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.REGISTER.queries.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.REGISTER.oracles.items()}
