"""Query registry: each entry pairs a Spark job with its DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` is omitted only for non-relational jobs."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def r6(c: str | Column, name: str | None = None) -> Column:
    """Round a computed double to 6 places (same rounding in the oracle)."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), 6)
    alias = name or (c if isinstance(c, str) else None)
    return out.alias(alias) if alias else out
