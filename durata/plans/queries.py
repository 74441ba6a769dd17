"""All queries of the table operators."""

from __future__ import annotations

from . import q_scores, q_tables, q_time  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
