"""Registry of queries (one per operator ID of SURVEY §2) and their DuckDB
oracle SQL. ``__spark_entry__`` exposes both.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the full
driver tables (or views Spark derives from them). Building one may run jobs:
ordered scans, model fits and lineage cuts are written to the checkpoint
folder when the query is built.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its oracle (omit for rows-only checks)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from rivalry.queries_defs import (  # noqa: F401
        q_core,
        q_ingest,
        q_quality,
        q_reports,
        q_models,
        q_stream,
    )
