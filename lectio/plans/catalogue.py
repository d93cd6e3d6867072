"""Every registered query of the engine's own operators, with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "score_systems"


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


from lectio.plans import moment_queries, pair_queries, text_queries, time_queries  # noqa: E402, F401  they register themselves
