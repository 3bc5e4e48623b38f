"""Registry of the corpus queries."""

from __future__ import annotations

from quarrylight.llm import align, chat, decontam, lloyd, neardup, passages, pieces, quality, suffix, tokencount, tokenout, toxicity, urls

MODULES = (align, chat, decontam, lloyd, neardup, passages, pieces, quality, suffix, tokencount, tokenout, toxicity, urls)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items() if sql}
