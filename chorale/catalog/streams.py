"""Streaming jobs run over the files of a table until all are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale import rules
from chorale.catalog.core import query
from chorale.catalog.text import SQL_FINAL_MASK
from chorale.catalog.views import RUN_TS, SQL_SQUEEZE, events_weekly, feedback, job_events, parsed, sql
from chorale.plans import prepare
from chorale.session import work_path
from chorale.streaming import jobs

def as_stream(spark, rows, label):
    """The rows written as files and read back as a stream of batches of bounded size."""
    path = work_path(spark, label)
    rows.write.parquet(path)
    return jobs.file_stream(spark, path, rows.schema)


def uploads(spark, d, per_batch=None):
    """Upload files in a folder that names their session; a session may have many."""
    path = work_path(spark, "uploads")
    rows = feedback(spark, d).drop("ingested_from")
    rows.write.partitionBy("session_id").parquet(path)
    stream = jobs.file_stream(spark, path, rows.schema, per_batch=per_batch)
    return stream.withColumn("ingested_from", F.col("_metadata.file_path"))


SQL_INGESTED = sql("nrm", f"""
    WITH {SQL_FINAL_MASK.strip()},
    h AS (SELECT session_id, raw_index, review_id, sha256({SQL_SQUEEZE.format('lower(masked)')}) AS dedupe_hash, pii_hits FROM fin)
    SELECT session_id, review_id, dedupe_hash, pii_hits FROM h
    QUALIFY row_number() OVER (PARTITION BY session_id, dedupe_hash ORDER BY raw_index) = 1""")
INGESTED = ["session_id", "review_id", "dedupe_hash", "pii_hits"]


@query("st_ingest_files", SQL_INGESTED)
def st_ingest_files(spark, d):
    out = work_path(spark, "ingested")
    jobs.ingest(uploads(spark, d), F.lit(RUN_TS).cast("timestamp"), out, work_path(spark, "state")).awaitTermination()
    return jobs.ingested(spark, out)[0].select(*INGESTED)


@query("st_recover", SQL_INGESTED)
def st_recover(spark, d):
    """Two runs on one checkpoint: the second takes up what came after the first ended (crashes: tests/test_streams.py)."""
    out, state, path = work_path(spark, "recovered"), work_path(spark, "state"), work_path(spark, "uploads")
    rows, run_ts = feedback(spark, d).drop("ingested_from"), F.lit(RUN_TS).cast("timestamp")
    later = F.col("created_at") >= "2024-02-12"
    for arrived in (rows.where(~later), rows.where(later)):
        arrived.write.mode("append").partitionBy("session_id").parquet(path)
        stream = jobs.file_stream(spark, path, rows.schema).withColumn("ingested_from", F.col("_metadata.file_path"))
        jobs.ingest(stream, run_ts, out, state).awaitTermination()
    return jobs.ingested(spark, out)[0].select(*INGESTED)


@query("st_dedupe", SQL_INGESTED.replace("SELECT session_id, review_id, dedupe_hash, pii_hits FROM h", "SELECT session_id, dedupe_hash FROM h"))
def st_dedupe(spark, d):
    out = work_path(spark, "deduplicated")
    rows = as_stream(spark, feedback(spark, d), "reviews")
    once = jobs.deduplicated(prepare.parsed(rows, F.lit(RUN_TS).cast("timestamp")), "created_at", "90 days", ["session_id", "dedupe_hash"])
    jobs.event_log(once.select("session_id", "dedupe_hash"), out, work_path(spark, "state"), "session_id").awaitTermination()
    return spark.read.parquet(out).select(F.col("session_id").cast("string").alias("session_id"), "dedupe_hash")


def moments(spark, d):
    return events_weekly(spark, d).select("key", F.col("moment").cast("timestamp").alias("moment"))


#: Files of the tables hold rows of all dates in no order: no row is late within their whole span.
SPAN = "4000 days"
SQL_WEEKS = "wks AS (SELECT key, date_trunc('week', moment) AS week_start, count(*) AS n FROM ev GROUP BY ALL)"


@query("st_weekly_counts", sql("ev", f"WITH {SQL_WEEKS} SELECT key, strftime(week_start, '%Y-%m-%d') AS week_start, n FROM wks"))
def st_weekly_counts(spark, d):
    out = work_path(spark, "weekly")
    counts = jobs.weekly_counts(as_stream(spark, moments(spark, d), "moments"), ["key"], "moment", SPAN)
    jobs.keep_current(counts, ["key", "week_start"], out, work_path(spark, "state")).awaitTermination()
    return jobs.current(spark, out).select("key", F.date_format("week_start", "yyyy-MM-dd").alias("week_start"), "n")


@query("st_spike_alerts", sql("ev", f"""
    WITH {SQL_WEEKS},
    h AS (SELECT key, count(*) AS weeks, CAST(arg_max(n, week_start) AS BIGINT) AS latest, CAST(sum(n) - arg_max(n, week_start) AS DOUBLE) / (count(*) - 1) AS mean,
      sqrt(CAST((count(*) - 1) * (sum(n*n) - arg_max(n, week_start) * arg_max(n, week_start))
        - (sum(n) - arg_max(n, week_start)) * (sum(n) - arg_max(n, week_start)) AS DOUBLE)) / (count(*) - 1) AS std FROM wks GROUP BY ALL)
    SELECT key, 'alert_' || key || '_history' AS alert_id, 'info' AS severity FROM h WHERE weeks < 6
    UNION ALL SELECT key, 'alert_' || key || '_spike', CASE WHEN latest / greatest(1.0, mean) >= 2 THEN 'high' ELSE 'medium' END FROM h WHERE weeks >= 6 AND latest > mean + 2 * std AND latest > mean"""))
def st_spike_alerts(spark, d):
    out = work_path(spark, "alerts")
    # Events span five weeks: a minimum of six shows the short-history row next to the spike rule.
    weekly = jobs.weekly_counts(as_stream(spark, moments(spark, d), "moments"), ["key"], "moment", SPAN)
    jobs.spike_alerts(weekly, ["key"], out, work_path(spark, "state"), min_weeks=6).awaitTermination()
    return jobs.current(spark, f"{out}/alerts").select("key", "alert_id", "severity")


@query("st_event_log", sql("je", "SELECT stage, count(*) AS n, count(DISTINCT 'corr_' || job_id) AS correlated FROM je GROUP BY ALL"))
def st_event_log(spark, d):
    out = work_path(spark, "log")
    rows = job_events(spark, d).withColumn("correlation_id", F.concat(F.lit("corr_"), "job_id"))
    jobs.event_log(as_stream(spark, rows, "events"), out, work_path(spark, "state"), "stage").awaitTermination()
    return spark.read.parquet(out).groupBy("stage").agg(F.count("*").alias("n"), F.count_distinct("correlation_id").alias("correlated"))


@query("st_metrics", sql("je", """
    WITH e AS (SELECT unnest([1.0, 3.0, 5.0, 10.0, 20.0, 30.0, 45.0, 60.0, 120.0, 'Infinity'::DOUBLE]) AS edge,
      unnest(['1', '3', '5', '10', '20', '30', '45', '60', '120', '+Inf']) AS le)
    SELECT stage, le, count(*) FILTER (latency <= edge) AS n, CAST(sum(CAST(latency AS DECIMAL(28,9))) AS DOUBLE) AS sum, count(*) AS count
    FROM je CROSS JOIN e GROUP BY stage, le, edge"""))
def st_metrics(spark, d):
    out = work_path(spark, "metrics")
    stream = as_stream(spark, job_events(spark, d), "events")
    jobs.metrics(stream, ["stage"], "latency", rules.JOB_LATENCY_EDGES, out, work_path(spark, "state")).awaitTermination()
    return jobs.current(spark, out)
