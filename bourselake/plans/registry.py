"""Name -> (Spark query, SQL twin). The SQL is text for an independent engine."""
from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from bourselake.plans.views import with_views
from bourselake.session import ship
from bourselake.sources.market import Market


@dataclass(frozen=True)
class Registered:
    run: Callable[[Market], DataFrame]
    views: tuple[str, ...]
    sql: str | None


REGISTRY: dict[str, Registered] = {}

MODULES = ("scans", "panel", "aggregates", "backtests", "scanners", "regimes", "breadth",
           "graph", "signals", "ideas", "postmortems", "news", "options", "statistics",
           "streams")


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query; `views` lists the derived tables its SQL reads."""
    def keep(fn: Callable[[Market], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Registered(fn, tuple(views.split()), sql)
        return fn
    return keep


def load() -> dict[str, Registered]:
    for module in MODULES:
        name = f"bourselake.plans.{module}"
        if importlib.util.find_spec(name):
            importlib.import_module(name)
    return REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Registered):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return entry.run(Market(spark, sf_dir))
        return run
    return {name: bind(entry) for name, entry in load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(entry.views, entry.sql) for name, entry in load().items() if entry.sql}
