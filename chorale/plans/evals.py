"""Acceptance checks as tables: one row per check, then one verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale import rules


def leaks(text: Column) -> Column:
    """Whether a published text still shows an e-mail address or a phone number."""
    return text.rlike(rules.LEAK_EMAIL) | text.rlike(rules.LEAK_PHONE)


def leak_check(texts: DataFrame) -> DataFrame:
    """Leaking texts per session; ``texts`` has session_id and text."""
    return texts.groupBy("session_id").agg(
        F.count("*").alias("texts"), F.count_if(leaks(F.col("text"))).alias("leaks")
    ).withColumn("passed", F.col("leaks") == 0)


def fixed_questions(sessions: DataFrame) -> DataFrame:
    """The fixed questions asked of every session: question_id, session_id, question, expected_prefix."""
    asked = F.array(*[
        F.struct(F.lit(str(i)).alias("i"), F.lit(q).alias("question"), F.lit(p).alias("expected_prefix"))
        for i, (q, p) in enumerate(rules.FIXED_QUESTIONS)
    ])
    rows = sessions.select("session_id", F.explode(asked).alias("a"))
    return rows.select(F.concat_ws("-", "session_id", "a.i").alias("question_id"), "session_id", "a.question", "a.expected_prefix")


def fixed_question_check(first_hits: DataFrame, expected: DataFrame) -> DataFrame:
    """Rank-1 hits against the expected cluster prefix; a question without a hit fails.

    ``first_hits``: session_id, question, cluster_id; ``expected``: session_id, question, expected_prefix.
    """
    joined = expected.join(first_hits, ["session_id", "question"], "left")
    return joined.withColumn(
        "passed", F.coalesce(F.startswith("cluster_id", "expected_prefix"), F.lit(False))
    )


def completeness_check(sessions: DataFrame, metadata: DataFrame, events: DataFrame) -> DataFrame:
    """Completed state, metadata present, and a correlation id on every event, per session.

    ``sessions``: session_id, status, job_status; ``metadata``: session_id,
    retrieval_backend_effective; ``events``: session_id, correlation_id.
    """
    traced = events.groupBy("session_id").agg(
        F.bool_and(F.trim(F.coalesce("correlation_id", F.lit(""))) != "").alias("events_traced")
    )
    no = F.lit(False)
    return (
        sessions.join(metadata, "session_id", "left").join(traced, "session_id", "left")
        .select(
            "session_id",
            (F.col("status").isin(rules.READY_SESSION_STATES) & (F.col("job_status") == "COMPLETED")).alias("completed"),
            F.col("retrieval_backend_effective").isNotNull().alias("metadata_present"),
            F.coalesce("events_traced", no).alias("events_traced"),
        )
        .withColumn("passed", F.col("completed") & F.col("metadata_present") & F.col("events_traced"))
    )


def verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count("*").alias("check_count"), F.count_if("passed").alias("passed_count"),
        F.bool_and("passed").alias("passed"),
    )
