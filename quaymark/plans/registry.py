"""Name -> (Spark query, DuckDB oracle)."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quaymark.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")

        @wraps(query)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return query(spark, sf_dir)

        self.queries[name] = shipped
        if sql is not None:
            self.oracles[name] = sql

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def wrap(fn: Query) -> Query:
            self.add(name, fn, sql)
            return fn

        return wrap
