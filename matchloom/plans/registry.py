"""All queries of the library over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.sources.projection import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_MODULES = ("sources", "validation", "identity", "features", "aggregates", "windows", "groups", "models", "scoring", "text", "streams")


def query(name: str, sql: str | None = None):
    """Registers a function of ``Views`` as a query, with the SQL that gives the same rows."""

    def add(f: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"matchloom.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
