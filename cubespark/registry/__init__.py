"""All registered queries."""

from __future__ import annotations

from cubespark.registry import cube_queries, io_queries, log_queries, model_queries  # noqa: F401
from cubespark.registry.base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
