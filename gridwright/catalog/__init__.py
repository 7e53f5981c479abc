"""The registered queries, one or more per operator."""

from __future__ import annotations

from gridwright.catalog.base import QUERIES, SQL


def _load() -> None:
    from gridwright.catalog import (  # noqa: F401
        boosting_queries, metric_queries, model_queries, prepare_queries, profile_queries, table_queries,
        training_queries,
    )


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
