"""Registry of the engine's queries and their oracles."""

from __future__ import annotations

from quarrylight.plans import analytics_queries, executor_queries, search_queries, streaming_queries

MODULES = (analytics_queries, search_queries, executor_queries, streaming_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
