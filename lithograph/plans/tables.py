"""Loading tables and registering queries with their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lithograph.functions.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str, per_task: int = 2048) -> DataFrame:
    """``rows`` by the hash of ``key`` in a number of partitions that follows theirs and that adaptive execution does not merge: small rows that much work follows."""
    number = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // per_task))
    return rows.repartition(number, key)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` after the library has been sent to the executors."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


class Catalog:
    """Queries by name; ``add`` is a decorator that takes the equivalent SQL."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def register(function):
            key = name or function.__name__
            self.queries[key] = shipped(function)
            if sql:
                self.sql[key] = sql
            return function

        return register
