"""Query registry: each query sits next to the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.plans.view_sql import with_views
from waymark.session import tune

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [
    "shaping", "joins", "aggregates", "windows", "ranking", "fairness", "audit", "contracts",
    "retrieval", "streams", "models",
]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register ``fn(spark, root)`` under ``key``; ``oracle`` may use the named views."""

    def register(fn: Query) -> Query:
        if key in _QUERIES:
            raise ValueError(f"duplicate query {key}")

        def run(spark: SparkSession, root: str) -> DataFrame:
            return fn(tune(spark), root)

        run.__doc__ = fn.__doc__
        _QUERIES[key] = run
        if oracle is not None:
            _ORACLES[key] = with_views(oracle)
        return fn

    return register


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"waymark.plans.{name}")


def all_queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    load()
    return dict(_ORACLES)
