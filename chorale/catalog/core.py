"""The registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chorale.session import pin_time_zone

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory key, with the SQL that gives the same rows."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_time_zone(spark)
            return build(spark, sf_dir)

        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register
