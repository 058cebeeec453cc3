"""All queries of the core with their SQL."""

from __future__ import annotations

from corpusloom.plans import assembly, base, extraction, retrieval, review, synthesis

MODULES = (retrieval, extraction, synthesis, review, assembly)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
