"""Registered queries: a Spark callable and, where SQL can say it, its check text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annalist import History
from catalog import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def over(*tables: str, sql: str | None = None) -> Callable:
    """Register a query on the named history tables."""
    def register(function: Callable[[History], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(views.history(spark, sf_dir, *tables))

        return _add(function.__name__, run, sql)

    return register


def direct(sql: str | None = None) -> Callable:
    """Register a query that takes the session and the folder itself."""
    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        return _add(function.__name__, function, sql)

    return register


def _add(name: str, run: Callable, sql: str | None) -> Callable:
    if name in QUERIES:
        raise ValueError(f"query registered twice: {name}")
    QUERIES[name] = run
    if sql is not None:
        CHECKS[name] = views.sql(sql)
    return run
