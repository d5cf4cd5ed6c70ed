"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable], Query]:
    """Register a function of a table reader: it gets ``t``, where ``t("orders")`` is that table."""

    def register(build: Callable) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda name: table(spark, sf_dir, name))

        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql
        return run

    return register
