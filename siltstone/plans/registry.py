"""Named queries: each is a function of (spark, sf_dir), most with the same query in SQL for an independent engine."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules that register queries when imported.
MODULES = ("tpch", "relational", "aggregates", "scalars", "tables")
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, and the oracle's SQL for it if there is any."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = f
        if sql is not None:
            _oracle[name] = sql
        return f

    return add


@functools.cache
def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"siltstone.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracle)
