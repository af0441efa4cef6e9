"""Adding per-group facts to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(rows: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """Join ``facts`` (one row per group) to the rows of the group.

    Without grouping columns there is one fact row: it becomes a scalar subquery, since a join on
    a constant would send all rows to one partition.
    """
    if by:
        return rows.join(facts, by)
    one = facts.select(F.struct(*facts.columns)).scalar()
    return rows.withColumn("_facts", one).select(*rows.columns, "_facts.*")


def fresh(df: DataFrame, columns: list[str]) -> list:
    """The columns under new attribute ids, for a frame that meets another one of its lineage."""
    return [F.col(c).alias(c) for c in columns]


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, n: int, share: int = 1_000) -> DataFrame:
    """``rows`` joined with the one row a key of ``keyed``, whose ``times`` counts the key in ``rows``; n: rows of ``rows``.

    Keys with more than one in ``share`` rows are fewer than ``share`` by pigeonhole and are broadcast; the rows
    of the others are shuffled, and no key of theirs is hot.
    """
    hot = F.col("times") * share > n
    much = F.broadcast(keyed.where(hot))
    few = rows.join(much.select(key), key, "left_anti").join(keyed.where(~hot), key)
    return rows.join(much, key).unionByName(few)
