"""How a query and its SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Registers fn(t), where t(name) is a table, under a name; sql: the same in DuckDB, if it can say it."""

    def register(fn: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(lambda table_name: table(spark, sf_dir, table_name))
        if sql:
            SQL[name] = sql
        return fn

    return register
