"""Queries by name over a folder of tables, each with the SQL that gives the same rows where SQL can."""
from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_MODULES = ("relational", "aggregates", "windows", "scalars", "similarity", "matching", "graphs", "streams", "composites", "more", "questions", "pages", "entities", "sections", "vectors", "cells", "synthesis", "runs", "registry")


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        ship(spark)

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a function of :class:`Tables` under a name."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql:
            ORACLE_SQL[name] = sql
        return plan

    return register


def load() -> None:
    """Registers all queries."""
    for module in _MODULES:
        importlib.import_module(f"tidemill.queries.{module}")
