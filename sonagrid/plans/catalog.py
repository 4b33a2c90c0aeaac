"""All queries of the library and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL if there is any."""

    def register(f):
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"two queries are called {key}")
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return register


def _load() -> None:
    """The modules that register the queries; they import this one."""
    for name in ("density", "classification", "pairs", "tables", "metrics", "scalars", "composites", "signal", "streams", "policies", "regions", "models", "learning", "governance"):
        import_module(f"sonagrid.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
