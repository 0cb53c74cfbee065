"""Registered queries (name -> callable(spark, sf_dir)) and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "knn_label_distance_filtered"


def query(name: str, sql: str | None = None):
    """Register the decorated callable under name, with the DuckDB text that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    import importlib

    for name in ("box_queries", "neighbor_queries", "gap_queries", "dataset_queries", "text_queries", "pipeline_queries", "io_queries"):
        importlib.import_module(f"sparkloom.plans.{name}")
