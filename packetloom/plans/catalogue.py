"""All registered queries of the analytics operators and their SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from packetloom.plans import registry

MODULES = ("q_functions", "q_joins", "q_grids", "q_stats", "q_windows", "q_sources", "q_signal")


def _loaded() -> None:
    for m in MODULES:
        importlib.import_module(f"packetloom.plans.{m}")


def queries() -> dict:
    _loaded()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(registry.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region tags by as-of join, occupancy per bin and region, and the occurrence rate."""
    return queries()["agg_rate"](spark, sf_dir)
