"""Row filters and per-session gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale import rules
from chorale.functions.text import squeeze


def missing_fields(fields: list[str] = rules.REQUIRED_FIELDS) -> Column:
    """Names of the blank required fields, sorted. JSON null counts as blank."""
    return F.array_sort(
        F.array_compact(F.array(*[F.when(squeeze(F.col(f)) == "", f) for f in fields]))
    )


def split_required(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with all required fields, rejected rows with code and message)."""
    checked = raw.withColumn("missing", missing_fields())
    bad = checked.where(F.size("missing") > 0).withColumn("code", F.lit("INPUT_SCHEMA_INVALID"))
    message = F.concat(
        F.lit("Record #"), (F.col("raw_index") + 1).cast("string"),
        F.lit(" is missing required fields: "), F.array_join("missing", ", "), F.lit("."),
    )
    return checked.where(F.size("missing") == 0).drop("missing"), bad.withColumn("message", message)


def required_strict(raw: DataFrame) -> DataFrame:
    """Fail the job at the first row that lacks a required field."""
    checked = raw.withColumn("_missing", missing_fields())
    message = F.concat(F.lit("INPUT_SCHEMA_INVALID: "), F.array_join("_missing", ", "))
    broken = F.when(F.size("_missing") > 0, F.raise_error(message).cast("string"))
    return checked.withColumn("review_id", F.coalesce(broken, "review_id")).drop("_missing")


def session_ratios(reviews: DataFrame, totals: DataFrame) -> DataFrame:
    """Quarantined rows against all input rows; ``totals`` has session_id, total_records."""
    held = reviews.groupBy("session_id").agg(F.count_if("residual").alias("quarantined_records"))
    return totals.join(held, "session_id", "left").withColumn(
        "quarantined_records", F.coalesce("quarantined_records", F.lit(0))
    ).withColumn("ratio", F.col("quarantined_records") / F.col("total_records"))


def privacy_gate(
    reviews: DataFrame, totals: DataFrame, max_ratio: float = rules.MAX_QUARANTINE_RATIO
) -> tuple[DataFrame, DataFrame]:
    """(clean rows of passing sessions, failed sessions). Failing is strict: ratio > limit."""
    ratios = session_ratios(reviews, totals)
    failed = ratios.where(F.col("ratio") > max_ratio).withColumn("code", F.lit("PRIVACY_GATE_FAILED"))
    kept = reviews.where(~F.col("residual")).join(failed, "session_id", "left_anti")
    return kept, failed


def empty_sessions(totals: DataFrame, kept: DataFrame) -> DataFrame:
    """Sessions for which nothing was kept."""
    return totals.join(kept.select("session_id").distinct(), "session_id", "left_anti").withColumn(
        "code", F.lit("FAILED_INPUT")
    )


def review_candidates(reviews: DataFrame) -> DataFrame:
    """Rows with a flag that a reviewer may overrule, reduced to those flags."""
    wanted = F.array(*[F.lit(f) for f in rules.REVIEWABLE_FLAGS])
    return reviews.where(F.arrays_overlap("flags", wanted)).withColumn(
        "flags", F.filter("flags", lambda f: F.array_contains(wanted, f))
    )


def material_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where(~F.col("insufficient_history"))


def jobs_in(jobs: DataFrame, states: list[str]) -> DataFrame:
    return jobs.where(F.col("status").isin(states))


def session_scope(table: DataFrame, session_id: str) -> DataFrame:
    """One session; on a table partitioned by session this prunes partitions."""
    return table.where(F.col("session_id") == session_id)


def ready_questions(questions: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions to sessions that are ready, the rest with an error code)."""
    ready = jobs_in(sessions, rules.READY_SESSION_STATES).select("session_id")
    open_ = questions.join(ready, "session_id", "left_semi")
    rest = questions.join(ready, "session_id", "left_anti")
    return open_, rest.withColumn("code", F.lit("SESSION_NOT_READY"))
