"""Query registry: a Spark callable and, where one can be written, an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from .views import Data, duck_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROWS: dict[str, str] = {}


def query(name: str, item: str, sql: str | None = None, views: Sequence[str] = ()):
    """Register ``fn(data) -> DataFrame`` under ``name`` for the inventory rows ``item``."""

    def add(fn: Callable[[Data], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Data(spark, folder))
        ROWS[name] = item
        if sql is not None:
            ORACLES[name] = duck_with(views, sql.strip())
        return fn

    return add
