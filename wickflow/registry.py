"""All registered queries of the engine and their SQL twins."""

from __future__ import annotations

from wickflow.plans.queries import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
