"""The clustering of every session: density profiles in turn, then the sweep, then the better one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale import rules
from chorale.operators import clustering, density, sweep
from chorale.operators.similarity import silhouette_linear
from chorale.session import settled

ATTEMPT = ["session_id", "ord", "backend", "profile_name", "quality_score", "cluster_count", "noise_fraction"]


def density_attempts(points: DataFrame, eps: float, gate: float, max_clusters: int) -> tuple[DataFrame, DataFrame]:
    """(labels with their ``profile_name``, attempts): a profile runs only for sessions that none before it satisfied.

    Points meet once for all profiles; a profile that asks for as many neighbours as the one before takes over its groups.
    """
    todo = points.groupBy("session_id").agg(F.count("*").alias("n"))
    keyed, nodes, rows = density.met(points, density.settings(points, eps))
    labels, attempts, asked = [], [], None
    for number, (name, size, samples) in enumerate(clustering.profiles(F.col("n")), 1):
        mine = points.join(todo, "session_id", "left_semi")
        wanted = density.settings(mine, eps, size, samples)
        if samples is not asked:
            member, asked = density.grouped(nodes, rows, wanted), samples
        found = settled(density.labelled(mine, keyed, member, wanted), "profile-labels")
        quality = silhouette_linear(mine.join(found, ["session_id", "item_id"]), ["session_id"], "label").select("session_id", "quality_score")
        counts = clustering.cluster_counts(found, ["session_id"], "label").join(quality, "session_id", "left")
        tried = settled(counts.select(
            "session_id", F.lit(number).alias("ord"), F.lit("density").alias("backend"), F.lit(name).alias("profile_name"),
            F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"), "cluster_count", "noise_fraction",
        ), "profile-attempts")
        labels.append(found.withColumn("profile_name", F.lit(name)))
        attempts.append(tried)
        accepted = tried.where((F.col("quality_score") >= gate) & (F.col("cluster_count") <= max_clusters))
        todo = todo.join(accepted, "session_id", "left_anti")
    return reduce(DataFrame.unionByName, labels), reduce(DataFrame.unionByName, attempts)


def clustered(
    points: DataFrame, eps: float, max_k: int, gate: float = rules.QUALITY_GATE, max_clusters: int = rules.MAX_CLUSTERS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, attempts, selection): session_id, item_id, label by the attempt that ``selection`` names for the session.

    ``points``: session_id, item_id, vector. Sessions below the least cluster size, or where no attempt has a quality above zero,
    are one cluster, labelled 0.
    """
    dense, tried = density_attempts(points, eps, gate, max_clusters)
    swept, sweeps, _ = sweep.sweep(points, max_k)
    more = sweeps.select("session_id", (F.col("k") + 100).alias("ord"), "backend", "profile_name", "quality_score", "cluster_count", "noise_fraction")
    attempts = settled(tried.unionByName(more), "attempts")
    sizes = points.groupBy("session_id").agg(F.count("*").alias("n"))
    selection = settled(clustering.selected_profile(attempts, gate, max_clusters).join(sizes, "session_id"), "selection")
    few = F.col("n") < rules.MIN_CLUSTER_SIZE
    backend = F.when(few, "single").otherwise(F.col("backend"))
    picked = selection.select("session_id", backend.alias("backend"), "profile_name")
    by_density = dense.join(picked.where("backend = 'density'").drop("backend"), ["session_id", "profile_name"], "left_semi").drop("profile_name")
    by_sweep = swept.join(picked.where("backend = 'kmeans'"), "session_id", "left_semi")
    single = points.select("session_id", "item_id").join(picked.where("backend = 'single'"), "session_id", "left_semi").withColumn("label", F.lit(0))
    return by_density.unionByName(by_sweep).unionByName(single), attempts, selection


def themed(reviews: DataFrame, vectors: DataFrame, eps: float, max_k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reviews with their ``cluster_id``, attempts, selection): what roll-ups, quotes and alerts are made from.

    ``reviews``: sanitized rows with session_id and review_id; ``vectors``: session_id, review_id, vector, one space a session.
    Reviews without a vector are weak signals, as is the noise of the clustering.
    """
    points = reviews.select("session_id", F.col("review_id").alias("item_id")).join(
        vectors.select("session_id", F.col("review_id").alias("item_id"), "vector"), ["session_id", "item_id"], "left"
    )
    labels, attempts, selection = clustered(settled(points, "review-points"), eps, max_k)
    named = labels.select("session_id", F.col("item_id").alias("review_id"), clustering.label_key(F.col("label")).alias("cluster_id"))
    return reviews.join(named, ["session_id", "review_id"]), attempts, selection
