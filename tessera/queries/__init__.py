"""Queries of the library by name, each with the SQL it is compared with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def all_queries() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """(queries, SQL)."""
    from tessera.queries import markets, operators, research, ticks

    found: dict[str, Callable] = {}
    sql: dict[str, str] = {}
    for module in (operators, ticks, markets, research):
        found |= module.QUERIES
        sql |= module.SQL
    return found, sql
