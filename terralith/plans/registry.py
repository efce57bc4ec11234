"""Queries by name: each is a function of a view accessor, with SQL that says the same independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terralith.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
View = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Registers the function under its name; sql may name the fixture views and the driver's tables."""

    def add(f: Callable[[View], DataFrame]) -> Callable[[View], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: fixtures.spark_view(spark, sf_dir, name) if name in fixtures.VIEWS else spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = fixtures.sql(sql)
        return f

    return add
