"""All registered queries of the point-in-time library."""

from __future__ import annotations

from tidemark.plans import catalog, catalog_logs, catalog_scores
from tidemark.plans.catalog import ORACLES, QUERIES, Query

__all__ = ["catalog", "catalog_logs", "catalog_scores", "oracle_sql", "queries"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: sql if isinstance(sql, str) else sql() for name, sql in ORACLES.items()}
