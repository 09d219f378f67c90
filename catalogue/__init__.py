"""Registered queries: each pairs a Spark job on the test tables with reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a query under ``name``; ``sql`` computes the same rows in DuckDB."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def load() -> None:
    """Import every module that registers queries."""
    for module in ("screening", "regime", "climate", "catchment", "statistics", "summaries"):
        import_module(f"catalogue.{module}")
