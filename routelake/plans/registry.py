"""Registry of named queries: Spark builder + DuckDB oracle SQL.

Each query reads the driver's tables (through the fixtures) so its work grows
with the data.  Keys follow the SURVEY inventory IDs (``e10_route_labels``).
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from routelake.session import ensure_checkpoint_dir, ship_package
            ensure_checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    for m in MODULES:
        importlib.import_module(f"routelake.plans.{m}")


MODULES = ["q_labels", "q_ranking", "q_text", "q_sft", "q_routers", "q_thought", "q_assemble", "q_graph", "q_io", "q_adapters"]
