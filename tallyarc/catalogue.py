"""The catalogue of operators: each is registered once, with its query and, where SQL can express it, its oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyarc.views import Views, oracle

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
#: Modules whose import registers operators.
MODULES = ["archive", "board", "search", "vectors", "similarity", "graph", "staleness", "telemetry", "hints", "evaluation", "relational", "scalars", "compaction", "snapshots", "streams", "upkeep"]


def query(name: str, sql: str | None = None):
    """Register ``f(views) -> DataFrame`` under ``name``; ``sql`` is its twin over the views, for the oracle's engine."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            _ORACLES[name] = oracle(sql)
        return f

    return register


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"tallyarc.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
