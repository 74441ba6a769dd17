"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import INTERVALS_SQL, RAW_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; ``iv`` and ``raw`` in its SQL are the interval and text views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            lead = ", ".join(f"{name} AS ({text})" for name, text in (("iv", INTERVALS_SQL), ("raw", RAW_SQL)))
            SQL[f.__name__] = f"WITH {lead}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {lead} {body}"
        return f

    return add
