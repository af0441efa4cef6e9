"""The registry of this subpackage's queries, and the small helpers all its operators use."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.session import work_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows where SQL can."""

    def register(build: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so that no other column of the input can clash; null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def packed(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, like ``settled``, for tables that hold texts."""
    path = work_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(n: float, per_part: float) -> int:
    """How many parts of about ``per_part`` hold ``n``; grows with the data, one at least."""
    return max(1, math.ceil(n / per_part))


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, n: int, share: int = 1_000) -> DataFrame:
    """``rows`` joined with the one row a key of ``keyed``, whose ``times`` counts the key in ``rows``; n: rows of ``rows``.

    Keys with more than one in ``share`` rows are fewer than ``share`` by pigeonhole and are broadcast; the rows
    of the others are shuffled, and no key of theirs is hot.
    """
    hot = F.col("times") * share > n
    much = F.broadcast(keyed.where(hot))
    few = rows.join(much.select(key), key, "left_anti").join(keyed.where(~hot), key)
    return rows.join(much, key).unionByName(few)
