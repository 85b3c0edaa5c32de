"""All queries over the engine's own operators."""

from __future__ import annotations

from . import catalogue_queries, golden_queries, run_queries

MODULES = (catalogue_queries, golden_queries, run_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
