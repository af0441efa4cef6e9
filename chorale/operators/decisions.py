"""Decisions of an outside reviewer, which arrive as tables, applied by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale import rules
from chorale.functions import values
from chorale.functions.text import tokens

KEYS = ["session_id", "cluster_id"]


def flag_decisions(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """Remove the flags a reviewer rejected.

    ``decisions``: session_id, review_id, keep_spam, keep_injection, keep_low_information, note.
    Adds ``note`` and ``reviewed``; :func:`flag_decision_counts` sums them up.
    """
    keeps = {
        "spam": "keep_spam",
        "injection_suspected": "keep_injection",
        "low_information": "keep_low_information",
    }
    rejected = F.array_compact(
        F.array(*[F.when(~values.loose_boolean(F.col(column), True), flag) for flag, column in keeps.items()])
    )
    marked = decisions.select(
        "session_id", "review_id", rejected.alias("_rejected"),
        F.nullif(values.clean_summary(F.col("note")), F.lit("")).alias("note"),
        F.lit(True).alias("reviewed"),
    )
    joined = reviews.join(marked, ["session_id", "review_id"], "left")
    remaining = F.coalesce(F.filter("flags", lambda f: ~F.array_contains("_rejected", f)), "flags")
    remaining = F.when(F.col("reviewed"), remaining).otherwise(F.col("flags"))
    return (
        joined.withColumn("removed_flags", F.size("flags") - F.size(remaining))
        .withColumn("flags", remaining)
        .withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))
        .drop("_rejected")
    )


def flag_decision_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("session_id").agg(
        F.count_if("reviewed").alias("reviewed"), F.sum("removed_flags").alias("removed_flags")
    )


def taxonomy_updates(clusters: DataFrame, updates: DataFrame) -> DataFrame:
    """Override label, summary and confidence; ``changed`` tells whether anything differs.

    ``updates``: session_id, cluster_id, new_label, new_summary, new_confidence (null or blank
    keeps the old value).
    """
    joined = clusters.join(updates.withColumn("_hit", F.lit(True)), KEYS, "left")
    hit = F.col("_hit").isNotNull()

    def chosen(name: str, clean) -> Column:
        given = F.coalesce(F.nullif(F.col(f"new_{name}"), F.lit("")), F.col(name))
        return F.when(hit, clean(given)).otherwise(F.col(name))

    new = {
        "label": chosen("label", values.clean_label),
        "summary": chosen("summary", values.clean_summary),
        "confidence": chosen("confidence", values.clean_confidence),
    }
    changed = F.lit(False)
    for name, value in new.items():
        changed = changed | (value != F.col(name))
    staged = joined.withColumn("changed", changed).withColumns(new)
    return staged.drop("_hit", "new_label", "new_summary", "new_confidence")


def alert_explanations(alerts: DataFrame, explanations: DataFrame) -> DataFrame:
    """Override the reason of alerts with history. ``explanations``: session_id, alert_id, explanation."""
    joined = alerts.join(explanations, ["session_id", "alert_id"], "left")
    given = F.nullif(values.clean_summary(F.col("explanation")), F.lit(""))
    applies = given.isNotNull() & ~F.col("insufficient_history")
    return joined.withColumn("changed", applies).withColumn(
        "reason", F.when(applies, given).otherwise(F.col("reason"))
    ).drop("explanation")


def split_marks(clusters: DataFrame, splits: DataFrame) -> DataFrame:
    """Mark clusters that look too broad. ``splits``: session_id, cluster_id, split_reason."""
    joined = clusters.join(splits, KEYS, "left")
    given = F.nullif(values.clean_summary(F.col("split_reason")), F.lit(""))
    reason = F.left(F.concat(F.lit(f"{rules.SPLIT_REASON}: "), given), F.lit(160))
    return joined.withColumn(
        "confidence", F.when(given.isNotNull(), "low").otherwise(F.col("confidence"))
    ).withColumn(
        "degraded_reason", F.when(given.isNotNull(), reason).otherwise(F.col("degraded_reason"))
    ).drop("split_reason")


def cluster_tokens(label: Column, summary: Column, keywords: Column, sources: Column) -> Column:
    """Distinct tokens longer than two characters over all texts of a cluster."""
    joined = F.concat_ws(" ", label, summary, F.array_join(keywords, " "), F.array_join(sources, " "))
    return F.array_distinct(F.filter(tokens(joined), lambda t: F.length(t) > 2))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), union)


def guarded_pairs(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Proposed pairs of existing clusters that are similar enough to merge, with both sides.

    ``pairs``: session_id, ord, left_id, right_id.
    """
    side = clusters.withColumn(
        "_tokens", cluster_tokens(F.col("label"), F.col("summary"), F.col("keywords"), F.col("sources"))
    )
    facts = F.struct("size", "priority_score", "cluster_id", "sentiment_score", "_tokens")
    left = side.select("session_id", F.col("cluster_id").alias("left_id"), facts.alias("l"))
    right = side.select("session_id", F.col("cluster_id").alias("right_id"), facts.alias("r"))
    joined = (
        pairs.where(F.col("left_id") != F.col("right_id"))
        .join(left, ["session_id", "left_id"])
        .join(right, ["session_id", "right_id"])
    )
    rank = lambda c: F.struct(c["size"], c["priority_score"], c["cluster_id"])
    gap = F.abs(F.col("l.sentiment_score") - F.col("r.sentiment_score"))
    overlap = jaccard(F.col("l._tokens"), F.col("r._tokens"))
    passing = (
        (F.size("l._tokens") > 0) & (F.size("r._tokens") > 0)
        & (overlap >= rules.MERGE_MIN_JACCARD) & (gap <= rules.MERGE_MAX_SENTIMENT_GAP)
    )
    left_first = rank(F.col("l")) >= rank(F.col("r"))
    return joined.where(passing).select(
        "session_id", "ord",
        F.when(left_first, F.col("left_id")).otherwise(F.col("right_id")).alias("primary_id"),
        F.when(left_first, F.col("right_id")).otherwise(F.col("left_id")).alias("secondary_id"),
    )


def accepted_merges(guarded: DataFrame) -> DataFrame:
    """In pair order, keep a pair only while both of its clusters are unused.

    A repeated pair can never be accepted after its first occurrence was seen, so only the first
    is kept; a session then holds at most one entry per pair of its (few) clusters.
    """
    first = guarded.groupBy("session_id", "primary_id", "secondary_id").agg(F.min("ord").alias("ord"))
    ordered = first.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "primary_id", "secondary_id"))).alias("pairs")
    )
    empty = F.struct(
        F.array().cast("array<string>").alias("used"),
        F.array().cast(ordered.schema["pairs"].dataType).alias("kept"),
    )

    def step(state: Column, pair: Column) -> Column:
        ends = F.array(pair["primary_id"], pair["secondary_id"])
        taken = F.struct(
            F.concat(state["used"], ends).alias("used"), F.array_append(state["kept"], pair).alias("kept")
        )
        return F.when(F.arrays_overlap(state["used"], ends), state).otherwise(taken)

    kept = F.aggregate("pairs", empty, step)["kept"]
    return ordered.select("session_id", F.explode(kept).alias("p")).select("session_id", "p.*")


def merge_clusters(clusters: DataFrame, merges: DataFrame) -> DataFrame:
    """Fold each secondary cluster into its primary; other clusters stay as they are."""
    roles = merges.select("session_id", F.col("primary_id").alias("cluster_id"), F.col("primary_id").alias("target"), F.lit(0).alias("role")).unionByName(
        merges.select("session_id", F.col("secondary_id").alias("cluster_id"), F.col("primary_id").alias("target"), F.lit(1).alias("role"))
    )
    joined = clusters.join(roles, KEYS, "left").withColumn("target", F.coalesce("target", "cluster_id"))
    joined = joined.withColumn("role", F.coalesce("role", F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct(
        "role", "label", "summary", "top_quote_ids", "keywords", "sources", "confidence", "degraded_reason",
    )))
    weighted = lambda c: F.sum(values.exact(F.col(c)) * F.col("size")).cast("double") / F.sum("size")
    grouped = joined.groupBy("session_id", F.col("target").alias("cluster_id")).agg(
        parts.alias("p"), F.count("*").alias("members"),
        F.sum("size").alias("size"), F.bool_or("anomaly_flag").alias("anomaly_flag"),
        *[F.round(weighted(c), 4).alias(c) for c in ("priority_score", "sentiment_score", "trend_delta")],
    )
    merged = F.col("members") > 1
    flat = lambda c: F.flatten(F.col(f"p.{c}"))
    level = lambda c: F.array_position(F.array(*[F.lit(x) for x in ("low", "medium", "high")]), c)
    first, second = F.col("p")[0], F.get(F.col("p"), F.lit(1))
    lower = F.when(level(first["confidence"]) <= level(second["confidence"]), first["confidence"]).otherwise(second["confidence"])
    reasons = F.concat_ws("; ", first["degraded_reason"], second["degraded_reason"], F.lit(rules.MERGE_REASON))
    return grouped.select(
        "session_id", "cluster_id", first["label"].alias("label"), first["summary"].alias("summary"), "size",
        "priority_score", "sentiment_score", "trend_delta", "anomaly_flag",
        F.when(merged, F.slice(F.array_distinct(flat("top_quote_ids")), 1, 5)).otherwise(first["top_quote_ids"]).alias("top_quote_ids"),
        F.when(merged, F.slice(F.array_distinct(flat("keywords")), 1, 5)).otherwise(first["keywords"]).alias("keywords"),
        F.array_sort(F.array_distinct(flat("sources"))).alias("sources"),
        F.when(merged, lower).otherwise(first["confidence"]).alias("confidence"),
        F.when(merged, F.left(reasons, F.lit(160))).otherwise(first["degraded_reason"]).alias("degraded_reason"),
    )


def remapped(assigned: DataFrame, merges: DataFrame) -> DataFrame:
    """Move the reviews of merged clusters to the surviving cluster."""
    moves = merges.select("session_id", F.col("secondary_id").alias("cluster_id"), "primary_id")
    return assigned.join(moves, KEYS, "left").withColumn(
        "cluster_id", F.coalesce("primary_id", "cluster_id")
    ).drop("primary_id")
