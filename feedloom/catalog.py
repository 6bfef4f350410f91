"""All queries on the engine's own operators, with SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "srt_01_rank"


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL if it has any."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


from feedloom.plans import dashboard, feeds, gates, joins, live, reading, sources_and_rules, texts, writing  # noqa: E402, F401
