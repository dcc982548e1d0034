"""All queries outside the llm subpackage."""

from __future__ import annotations

from assaykit.plans import judged, metrics, preparation, texts, turns

_PARTS = (texts.REGISTRY, metrics.REGISTRY, turns.REGISTRY, judged.REGISTRY)
QUERIES = dict(preparation.QUERIES)
SQL = dict(preparation.SQL)
for _part in _PARTS:
    QUERIES |= _part.queries
    SQL |= _part.sql
