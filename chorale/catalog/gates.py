"""Filters and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale import rules
from chorale.catalog.core import query
from chorale.catalog.text import SQL_FLAGS, SQL_MASKS
from chorale.catalog.views import clusters, feedback, job_events, parsed, questions, sql, table
from chorale.functions import privacy
from chorale.operators import gates, themes, trends


def dirty(spark, d):
    """Feedback in which some required fields are blank."""
    n = F.col("raw_index")
    return feedback(spark, d).withColumns({
        "source": F.when(n % 40 == 1, "  ").otherwise(F.col("source")),
        "created_at": F.when(n % 60 == 1, None).otherwise(F.col("created_at")),
        "review_id": F.when(n % 100 == 3, "\n").otherwise(F.col("review_id")),
    })


SQL_DIRTY = """
    drt AS (SELECT session_id, raw_index, CASE WHEN raw_index % 40 = 1 THEN '' ELSE source END AS source,
      CASE WHEN raw_index % 60 = 1 THEN '' ELSE created_at END AS created_at,
      CASE WHEN raw_index % 100 = 3 THEN '' ELSE review_id END AS review_id, text FROM fb),
    mis AS (SELECT *, array_to_string(list_filter([CASE WHEN created_at = '' THEN 'created_at' END, CASE WHEN review_id = '' THEN 'review_id' END,
      CASE WHEN source = '' THEN 'source' END, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'text' END],
      lambda m: m IS NOT NULL), ', ') AS missing FROM drt)"""


@query("gate_required", sql("fb", f"""WITH {SQL_DIRTY}
    SELECT session_id, raw_index, 'INPUT_SCHEMA_INVALID' AS code,
      'Record #' || CAST(raw_index + 1 AS VARCHAR) || ' is missing required fields: ' || missing || '.' AS message
    FROM mis WHERE missing <> ''
    UNION ALL SELECT session_id, raw_index, 'VALID', '' FROM mis WHERE missing = ''"""))
def gate_required(spark, d):
    valid, invalid = gates.split_required(dirty(spark, d))
    good = valid.select("session_id", "raw_index", F.lit("VALID").alias("code"), F.lit("").alias("message"))
    return invalid.select("session_id", "raw_index", "code", "message").unionByName(good)


SQL_RESIDUAL = " OR ".join(f"regexp_matches(text, '{p}')" for p, _ in SQL_MASKS[:3])


@query("gate_privacy", sql("fb", f"""
    WITH r AS (SELECT session_id, review_id, {SQL_RESIDUAL} AS residual FROM fb),
    s AS (SELECT session_id, count(*) FILTER (residual) / CAST(count(*) AS DOUBLE) AS ratio FROM r GROUP BY ALL)
    SELECT session_id, count(*) AS kept FROM r JOIN s USING (session_id) WHERE NOT residual AND ratio <= 0.29 GROUP BY ALL
    UNION ALL SELECT session_id, 0 FROM s WHERE ratio > 0.29"""))
def gate_privacy(spark, d):
    rows = feedback(spark, d).select("session_id", "review_id", privacy.has_residual(F.col("text")).alias("residual"))
    totals = rows.groupBy("session_id").agg(F.count("*").alias("total_records"))
    kept, failed = gates.privacy_gate(rows, totals, max_ratio=0.29)
    return kept.groupBy("session_id").agg(F.count("*").alias("kept")).unionByName(
        failed.select("session_id", F.lit(0).cast("bigint").alias("kept"))
    )


@query("gate_nonempty", sql("fb", """
    SELECT session_id, 'FAILED_INPUT' AS code FROM (SELECT 'sess_' || CAST(nextsess AS VARCHAR) AS session_id
      FROM (SELECT DISTINCT doc_id % 9 AS nextsess FROM documents))
    WHERE session_id NOT IN (SELECT session_id FROM fb)"""))
def gate_nonempty(spark, d):
    declared = table(spark, d, "documents").select(
        F.concat(F.lit("sess_"), (F.col("doc_id") % 9).cast("string")).alias("session_id")
    ).distinct()
    return gates.empty_sessions(declared, feedback(spark, d)).select("session_id", "code")


@query("flt_review_candidates", sql("nrm", SQL_FLAGS + """
    SELECT review_id, array_to_string(list_filter([CASE WHEN injection THEN 'injection_suspected' END, CASE WHEN spam THEN 'spam' END,
      CASE WHEN low THEN 'low_information' END], lambda f: f IS NOT NULL), ',') AS flags FROM flg WHERE injection OR spam OR low"""))
def flt_review_candidates(spark, d):
    return gates.review_candidates(parsed(spark, d)).select("review_id", F.array_join("flags", ",").alias("flags"))


def alerts(spark, d, assigned=None):
    """Spike alerts of the themes; ``assigned``: the reviews with their cluster, where they are stored."""
    from chorale.catalog.views import assignments

    weekly = trends.weekly_counts(assignments(spark, d) if assigned is None else assigned, themes.KEYS, "created_at")
    return trends.spike_alerts(trends.history(weekly, themes.KEYS), min_weeks=4)


@query("flt_material_alerts", sql("alr", "SELECT session_id, alert_id, severity, reason FROM alr WHERE NOT insufficient_history"))
def flt_material_alerts(spark, d):
    return gates.material_alerts(alerts(spark, d)).select("session_id", "alert_id", "severity", "reason")


STATES = ["QUEUED", "RUNNING", "RETRYING", "DEGRADED_RUNNING", "COMPLETED", "FAILED_INPUT", "CANCELED"]
SQL_STATES = "['QUEUED', 'RUNNING', 'RETRYING', 'DEGRADED_RUNNING', 'COMPLETED', 'FAILED_INPUT', 'CANCELED']"


def jobs(spark, d):
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("k") % len(STATES) + 1)
    return job_events(spark, d).select("id", "job_id", "created_at", state.alias("status"))


@query("flt_active_jobs", sql("je", f"""
    WITH j AS (SELECT job_id, {SQL_STATES}[k % 7 + 1] AS status FROM je)
    SELECT 'active' AS kind, count(*) AS n FROM j WHERE status IN ('QUEUED', 'RUNNING', 'RETRYING', 'DEGRADED_RUNNING')
    UNION ALL SELECT 'recovery', count(*) FROM j WHERE status IN ('RUNNING', 'RETRYING', 'DEGRADED_RUNNING')"""))
def flt_active_jobs(spark, d):
    def count(kind, states):
        return gates.jobs_in(jobs(spark, d), states).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")

    return count("active", rules.ACTIVE_JOB_STATES).unionByName(count("recovery", rules.RECOVERY_JOB_STATES))


@query("flt_session_scope", "SELECT vec_id, label FROM embeddings WHERE label = 3")
def flt_session_scope(spark, d):
    vectors = table(spark, d, "embeddings").withColumn("session_id", F.col("label").cast("string"))
    return gates.session_scope(vectors, "3").select("vec_id", "label")


@query("flt_ready_sessions", sql("qs", """
    SELECT question_id, CASE WHEN session_id IN ('sess_0', 'sess_2') THEN 'READY' ELSE 'SESSION_NOT_READY' END AS code FROM qs"""))
def flt_ready_sessions(spark, d):
    states = F.array(F.lit("COMPLETED"), F.lit("PROCESSING"), F.lit("DEGRADED_COMPLETED"), F.lit("FAILED"))
    digit = F.substr("session_id", F.lit(6)).cast("int")
    sessions = clusters(spark, d).select("session_id").distinct().withColumn("status", F.element_at(states, digit + 1))
    ready, rest = gates.ready_questions(questions(spark, d), sessions)
    return ready.select("question_id", F.lit("READY").alias("code")).unionByName(rest.select("question_id", "code"))
