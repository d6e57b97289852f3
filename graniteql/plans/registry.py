"""Registers queries by name, each with the DuckDB statement that has the same rows, where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def keep(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.oracle[name] = sql
            return f

        return keep

    def sql(self, name: str, tables: str, text: str, oracle: str | None = None) -> None:
        """A query written as SQL text over views of these tables; the oracle is the same text unless given."""
        from graniteql.session import register

        def run(spark: SparkSession, d: str) -> DataFrame:
            register(spark, d, tables.split())
            return spark.sql(text)

        self.queries[name] = run
        self.oracle[name] = oracle or text
