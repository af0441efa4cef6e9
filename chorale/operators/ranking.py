"""Top-k per group.

``row_number() <= k`` lets Spark put a group limit before the shuffle, so a hot group sends at
most k rows per task and is never sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(
    df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_copies(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row per key in input order (``dropDuplicates`` would keep any row)."""
    return top_k(df, by, [F.col(order)], 1, "_copy").drop("_copy")


def latest(df: DataFrame, by: list[str], version: str) -> DataFrame:
    """The newest row per key."""
    return top_k(df, by, [F.col(version).desc()], 1, "_version").drop("_version")


def by_priority() -> list[Column]:
    return [F.col("priority_score").desc(), F.col("size").desc(), F.col("cluster_id")]


def top_clusters(clusters: DataFrame, k: int = 3) -> DataFrame:
    """The k clusters of highest priority per session."""
    return top_k(clusters, ["session_id"], by_priority(), k)


def quotes(reviews: DataFrame, limit: int = 3) -> DataFrame:
    """Strongest sentiment first, then longest text, then input order."""
    order = [F.abs("sentiment").desc(), F.length("text").desc(), F.col("raw_index")]
    return top_k(reviews, ["session_id", "cluster_id"], order, limit)


def recent_quotes(reviews: DataFrame, limit: int = 3) -> DataFrame:
    order = [F.abs("sentiment").desc(), F.col("created_at").desc(), F.col("review_id")]
    return top_k(reviews, ["session_id", "cluster_id"], order, limit)


def samples(reviews: DataFrame, limit: int = 5) -> DataFrame:
    """The first reviews of each cluster in input order."""
    return top_k(reviews, ["session_id", "cluster_id"], [F.col("raw_index")], limit)


def recent_turns(turns: DataFrame, limit: int = 6) -> DataFrame:
    """The last turns per session; ``position`` counts from the oldest of them."""
    last = top_k(turns, ["session_id"], [F.col("id").desc()], limit)
    count = F.count("*").over(Window.partitionBy("session_id"))
    return last.withColumn("position", (count - F.col("rank") + 1).cast("int")).drop("rank")


def next_job(jobs: DataFrame) -> DataFrame:
    """The oldest queued job."""
    return jobs.where(F.col("status") == "QUEUED").orderBy("created_at", "job_id").limit(1)


def cluster_ordinals(clusters: DataFrame) -> DataFrame:
    """Ordinal by size, then key as text; the final id is the label slug and the ordinal."""
    from chorale.functions.text import slugify

    window = Window.partitionBy("session_id").orderBy(F.col("size").desc(), F.col("cluster_key"))
    numbered = clusters.withColumn("ordinal", F.row_number().over(window))
    return numbered.withColumn("cluster_id", F.concat_ws("_", slugify(F.col("label")), F.col("ordinal")))
