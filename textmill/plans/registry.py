"""Registry of named queries (one per SURVEY section 2 key) and their
independent SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key``; ``sql`` is
    the DuckDB oracle over the driver tables (omitted for jobs that SQL
    cannot express: iterative fits, SVD, models)."""
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco
