"""Named queries of the core operators and their SQL."""

from __future__ import annotations

from rhetorica.plans import corpus_queries, model_queries  # noqa: F401  (they register their queries)
from rhetorica.plans.model_queries import flagship  # noqa: F401
from rhetorica.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
