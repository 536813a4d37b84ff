"""How the suites register queries: a Spark function and, where SQL can say it, the oracle's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumine.data import run_sql

Query = Callable[[SparkSession, str], DataFrame]


class Suite:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a function as query ``name``."""

        def register(function: Query) -> Query:
            self.queries[name] = function
            if sql:
                self.sql[name] = sql
            return function

        return register

    def both(self, name: str, sql: str) -> None:
        """The same text for Spark and for the oracle."""
        self.texts(name, sql, sql)

    def texts(self, name: str, spark_sql: str, oracle: str) -> None:
        self.add(name, oracle)(lambda spark, folder: run_sql(spark, folder, spark_sql))
