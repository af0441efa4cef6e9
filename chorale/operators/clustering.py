"""Clusters of dense vectors, their quality, and the choice between attempts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale import rules
from chorale.session import settled


def cluster_counts(points: DataFrame, by: list[str], label: str) -> DataFrame:
    """Clusters without noise, and the share of noise."""
    noise = F.col(label) == -1
    return points.groupBy(*by).agg(
        F.count_distinct(F.when(~noise, F.col(label))).alias("cluster_count"),
        (F.count_if(noise) / F.count("*")).alias("noise_fraction"),
    )


def profiles(n: Column) -> list[tuple[str, Column, Column]]:
    """(name, min cluster size, min samples) derived from a session's number of points."""
    share = lambda parts, least: F.greatest(F.lit(least), F.floor(n / parts).cast("int"))
    size = F.least(F.lit(rules.MIN_CLUSTER_SIZE), share(4, 2))
    samples = F.least(F.lit(rules.MIN_SAMPLES), share(6, 1))
    n = n.cast("int")
    return [
        ("density_default", size, samples),
        ("density_smaller_clusters", F.greatest(F.lit(2), size - 1), samples),
        ("density_more_stable", F.least(F.greatest(F.lit(2), n - 1), size + 1), F.least(F.greatest(F.lit(1), n - 2), samples + 1)),
    ]


def _components(near: np.ndarray) -> np.ndarray:
    """Component number of the rows and columns of a boolean bipartite block (breadth first)."""
    rows, cols = near.shape
    part = np.full(rows + cols, -1)
    for start in range(rows):
        if part[start] >= 0:
            continue
        seen_r, seen_c = np.zeros(rows, bool), np.zeros(cols, bool)
        front = np.zeros(rows, bool)
        front[start] = True
        while front.any():
            seen_r |= front
            reached = near[front].any(0) & ~seen_c
            seen_c |= reached
            front = near[:, reached].any(1) & ~seen_r if reached.any() else np.zeros(rows, bool)
        part[:rows][seen_r] = start
        part[rows:][seen_c] = start
    return part


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each component, by alternating star steps.

    Each round joins every link with the smallest neighbour of its ends; checkpoints in the shared
    folder cut the lineage. Rounds grow with the logarithm of the component size.
    """
    start = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = settled(start.where("u <> v").distinct(), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small_low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(small_low.select("u", F.col("m").alias("v")))
        edges = settled(small.where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return nodes.join(edges.select(F.col("u").alias("node"), "v"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )


def selected_profile(
    attempts: DataFrame, gate: float = rules.QUALITY_GATE, max_clusters: int = rules.MAX_CLUSTERS
) -> DataFrame:
    """The winning attempt per session.

    ``attempts``: session_id, ord, backend, profile_name, quality_score, cluster_count. Density
    attempts stop at the first accepted one; the best has the highest quality, then the fewest
    clusters, then the last name. The sweep wins only when strictly better. Without any positive
    quality there is one cluster.
    """
    dense = F.col("backend") == "density"
    passes = (F.col("quality_score") >= gate) & (F.col("cluster_count") <= max_clusters)
    stop = attempts.where(dense & passes).groupBy("session_id").agg(F.min("ord").alias("_stop"))
    tried = attempts.join(stop, "session_id", "left").where(
        ~dense | F.col("_stop").isNull() | (F.col("ord") <= F.col("_stop"))
    )
    rank = F.struct("quality_score", dense.alias("dense"), (-F.col("cluster_count")).alias("fewer"), "profile_name", "backend", "cluster_count")
    best = tried.groupBy("session_id").agg(F.max(rank).alias("b"), F.count("*").alias("attempt_count"))
    positive = F.col("b.quality_score") > 0
    return best.select(
        "session_id", "attempt_count",
        F.when(positive, F.col("b.backend")).otherwise("single").alias("backend"),
        F.when(positive, F.col("b.profile_name")).otherwise("one_cluster").alias("profile_name"),
        F.when(positive, F.col("b.quality_score")).otherwise(0.0).alias("quality_score"),
        F.when(positive, F.col("b.cluster_count")).otherwise(1).cast("bigint").alias("cluster_count"),
        (F.col("b.quality_score") >= gate).alias("quality_gate_passed"),
    )


def run_mode(
    sessions: DataFrame, min_reviews: int = rules.MIN_CLUSTER_SIZE, low_data_rows: int = rules.LOW_DATA_ROWS,
    least_quality: float = rules.DEGRADED_QUALITY,
) -> DataFrame:
    """Degraded and low-data flags; ``sessions``: session_id, reviews, quality_score."""
    tiny = F.col("reviews") < min_reviews
    low_data = F.col("reviews") < low_data_rows
    quality = F.when(tiny, 0.0).otherwise(F.col("quality_score"))
    return sessions.select(
        "session_id", "reviews", quality.alias("quality_score"), tiny.alias("one_cluster"),
        low_data.alias("low_data_mode"),
        (tiny | (quality < least_quality) | low_data).alias("degraded_mode"),
    )


def label_key(label: Column) -> Column:
    return F.when(label == -1, "weak_signals").otherwise(F.concat(F.lit("cluster_"), (label + 1).cast("string")))


def chosen_vectors(
    items: DataFrame, external: DataFrame, fallback: DataFrame, backend: str, model: str
) -> tuple[DataFrame, DataFrame]:
    """(vectors, source per session): given vectors where a session has them all, else the fallback.

    Vectors of one session must share a space, so one missing vector moves the whole session.
    ``items``: session_id, item_id; ``external`` and ``fallback``: item_id, vector.
    """
    given = items.join(external.withColumnRenamed("vector", "_given"), "item_id", "left")
    sources = given.groupBy("session_id").agg(
        F.count("*").alias("items"), F.bool_and(F.col("_given").isNotNull()).alias("complete")
    ).select(
        "session_id", "items", "complete",
        F.when(F.col("complete"), backend).otherwise("projection").alias("embedding_backend_effective"),
        F.when(F.col("complete"), model).otherwise("tfidf-svd-projection").alias("embedding_model_effective"),
        F.when(~F.col("complete"), "vectors_missing").alias("embedding_degraded_reason"),
    )
    joined = given.join(sources.select("session_id", "complete"), "session_id").join(
        fallback.withColumnRenamed("vector", "_fallback"), "item_id", "left"
    )
    vector = F.when(F.col("complete"), F.col("_given").cast("array<double>")).otherwise(F.col("_fallback"))
    return joined.select("session_id", "item_id", vector.alias("vector")), sources
