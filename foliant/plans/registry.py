"""The catalogue of queries: a callable per operator and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load() -> None:
    """Import every module that registers queries."""
    from foliant.plans import (  # noqa: F401
        queries_classify,
        queries_docs,
        queries_extract,
        queries_kpi,
        queries_review,
        queries_rules,
        queries_stream,
    )
