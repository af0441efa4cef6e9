"""Theme roll-ups: one row per session and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale import rules
from chorale.functions import concepts as concept_rules
from chorale.functions.values import exact, fixed, week_key
from chorale.operators.trends import trend_delta

KEYS = ["session_id", "cluster_id"]


def weekly_stats(assigned: DataFrame) -> DataFrame:
    """First stage of the roll-up, one row per cluster and week.

    The only shuffle of review rows; each task sends at most one row per cluster and week.
    """
    score = F.col("sentiment")
    return assigned.groupBy(*KEYS, week_key(F.col("created_at")).alias("week_key")).agg(
        F.count("*").alias("n"),
        F.sum(exact(score)).alias("sentiment_sum"),
        F.max(score).alias("sentiment_max"),
        F.min(score).alias("sentiment_min"),
        F.collect_set("source").alias("sources"),
        F.bool_or(F.col("language") == "mixed").alias("mixed_language"),
    )


def rollup(weekly: DataFrame) -> DataFrame:
    """Second stage: size, sentiment, sources, share, trend and priority per cluster."""
    latest = F.max_by("n", "week_key")
    weeks = F.count("*")
    earlier = (F.sum("n") - latest).cast("double") / F.nullif(weeks - 1, F.lit(0)).cast("double")
    per_cluster = weekly.groupBy(*KEYS).agg(
        F.sum("n").alias("size"),
        (F.sum("sentiment_sum").cast("double") / F.sum("n")).alias("mean_sentiment"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        ((F.max("sentiment_max") > rules.MIXED_MARGIN) & (F.min("sentiment_min") < -rules.MIXED_MARGIN))
        .alias("mixed_sentiment"),
        F.bool_or("mixed_language").alias("mixed_language"),
        trend_delta(latest, earlier).alias("trend_delta"),
    )
    session = Window.partitionBy("session_id")
    sized = per_cluster.withColumn("total", F.sum("size").over(session)).withColumn(
        "freq_norm", F.col("size") / F.max("size").over(session)
    )
    return sized.select(
        *KEYS, "size", "total", "freq_norm",
        (F.col("size") / F.col("total")).alias("share"),
        "mean_sentiment", F.round("mean_sentiment", 4).alias("sentiment_score"), "trend_delta",
        "sources", "mixed_sentiment", "mixed_language",
        priority(F.col("freq_norm"), F.col("mean_sentiment"), F.col("trend_delta")).alias("priority_score"),
    )


def priority(
    freq_norm: Column,
    sentiment: Column,
    trend: Column,
    weights: tuple[float, float, float] = rules.PRIORITY_WEIGHTS,
) -> Column:
    growth = F.greatest(F.lit(0.0), F.least(F.lit(1.0), trend / rules.TREND_SCALE))
    return F.round(weights[0] * freq_norm + weights[1] * F.abs(sentiment) + weights[2] * growth, 4)


def is_weak(cluster: Column, size: Column, max_size: int = rules.WEAK_SIGNAL_SIZE) -> Column:
    return (cluster == "weak_signals") | (size <= max_size)


def confidence(size: Column, degraded: Column, weak: Column) -> Column:
    return (
        F.when(degraded | weak, "low")
        .when(size >= rules.HIGH_CONFIDENCE_SIZE, "high")
        .when(size >= rules.MEDIUM_CONFIDENCE_SIZE, "medium")
        .otherwise("low")
    )


def degraded_reason(low_data: Column, degraded: Column, weak: Column) -> Column:
    return (
        F.when(low_data, "low_data_mode")
        .when(degraded, "low_clustering_quality")
        .when(weak, "weak_signals_mode")
    )


def trend_note(trend: Column) -> Column:
    return F.when(trend > rules.SPIKING_TREND, "spiking").otherwise("stable")


def summary_text(label: Column) -> Column:
    """The theme sentence, from the columns of :func:`rollup`."""
    score = F.col("mean_sentiment")
    mood = (
        F.when(score < -rules.MOOD_MARGIN, "negative sentiment")
        .when(score > rules.MOOD_MARGIN, "positive sentiment")
        .otherwise("mixed sentiment")
    )
    tone = F.when(F.col("mixed_sentiment"), "mixed sentiment with both praise and complaints")
    bilingual = F.when(
        F.col("mixed_language"),
        " Includes chunk-level RU+EN processing for mixed-language feedback.",
    )
    return F.concat(
        F.lit("Theme '"), label, F.lit("' covers "), F.col("size").cast("string"),
        F.lit(" reviews ("), fixed(F.col("share") * 100, 1), F.lit("% of the batch), shows "),
        F.coalesce(tone, mood), F.lit(", and looks "), trend_note(F.col("trend_delta")),
        F.lit(". Sources: "), F.array_join(F.slice("sources", 1, 3), ", "), F.lit("."),
        F.coalesce(bilingual, F.lit("")),
    )


def dominant_concepts(tagged: DataFrame, concepts: concept_rules.Concepts = rules.CONCEPTS) -> DataFrame:
    """The most frequent concept per cluster, ties by first occurrence, with its label.

    ``tagged`` has session_id, cluster_id, raw_index and the array ``concepts``.
    """
    seen = tagged.select(*KEYS, "raw_index", F.posexplode("concepts").alias("_pos", "concept"))
    counts = seen.groupBy(*KEYS, "concept").agg(
        F.count("*").alias("n"), F.min(F.struct("raw_index", "_pos")).alias("_first")
    )
    best = counts.groupBy(*KEYS).agg(
        F.min(F.struct(-F.col("n"), "_first", "concept")).alias("_best"), F.max("n").alias("n")
    )
    return best.select(
        *KEYS, F.col("_best.concept").alias("concept"), "n",
    ).withColumn("label", concept_rules.label_of(F.col("concept"), concepts))


def diagnostics(clusters: DataFrame, mixed_reviews: DataFrame) -> DataFrame:
    """Per session: weak and mixed-sentiment clusters, mixed-language reviews, low-data flag.

    ``mixed_reviews`` has session_id and mixed_language_review_count. The id lists hold
    clusters, which are few per session, never reviews.
    """
    def ids(condition: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, F.col("cluster_id"))))

    weak, mixed = F.col("weak"), F.col("mixed_sentiment")
    return clusters.groupBy("session_id").agg(
        F.count("*").alias("total_clusters"),
        F.sum("size").alias("reviews"),
        ids(weak).alias("weak_signal_cluster_ids"),
        F.count_if(weak).alias("weak_signal_cluster_count"),
        ids(mixed).alias("mixed_sentiment_cluster_ids"),
        F.count_if(mixed).alias("mixed_sentiment_cluster_count"),
    ).join(mixed_reviews, "session_id", "left").withColumn(
        "low_data_mode", F.col("reviews") < rules.LOW_DATA_ROWS
    )


def backend_label(values: Column) -> Column:
    """A single value as it is, several as ``mixed(a, b)`` in order."""
    ordered = F.array_sort(F.collect_set(values))
    joined = F.concat(F.lit("mixed("), F.array_join(ordered, ", "), F.lit(")"))
    return F.when(F.size(ordered) == 1, ordered.getItem(0)).when(F.size(ordered) > 1, joined)


def split_weak(clusters: DataFrame, weak_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(top themes, weak signals) by a table of weak session_id, cluster_id."""
    return clusters.join(weak_ids, KEYS, "left_anti"), clusters.join(weak_ids, KEYS, "left_semi")
