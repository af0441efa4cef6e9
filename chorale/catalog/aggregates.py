"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale import rules
from chorale.catalog.core import query
from chorale.catalog.gates import alerts
from chorale.catalog.joins import SQL_MERGES, proposed_pairs, quoted_clusters, sql_merges
from chorale.catalog.text import SQL_CONCEPTS, SQL_FINAL_MASK, SQL_FLAGS, SQL_MASKS, SQL_SQUEEZE
from chorale.catalog.views import (
    CONCEPTS, assignments, clusters, events_weekly, feedback, job_events, parsed, sql, table,
)
from chorale.functions import concepts
from chorale.operators import decisions, metrics, themes, trends
from chorale.plans import prepare

SQL_COUNTERS = SQL_FLAGS + f""",
    hsh AS (SELECT *, sha256({SQL_SQUEEZE.format('lower(masked)')}) AS h,
      {" OR ".join(f"regexp_matches(masked, '{p}')" for p, _ in SQL_MASKS[:3])} AS residual FROM flg),
    fst AS (SELECT *, row_number() OVER (PARTITION BY session_id, h ORDER BY raw_index) AS copy FROM hsh)"""
SQL_SUMMARY = """SELECT session_id, count(*) AS total_records, count(*) FILTER (copy = 1 AND NOT residual) AS kept_records,
      count(*) FILTER (copy > 1) AS duplicate_records, count(*) FILTER (copy = 1 AND residual) AS quarantined_records,
      CAST(sum(pii_hits) AS BIGINT) AS pii_hits, count(*) FILTER (injection{0}) AS injection_hits,
      count(*) FILTER (low{0}) AS low_information_records, count(*) FILTER (language = 'unknown') AS unsupported_language_records
    FROM fst GROUP BY ALL"""


@query("agg_preprocess_summary", sql("nrm", SQL_COUNTERS + SQL_SUMMARY.format("")))
def agg_preprocess_summary(spark, d):
    return prepare.summary(parsed(spark, d)).drop("kept_injection", "kept_low_information")


@query("agg_refresh_flags", sql("nrm", SQL_COUNTERS + SQL_SUMMARY.format(" AND copy = 1 AND NOT residual")))
def agg_refresh_flags(spark, d):
    return prepare.refreshed(prepare.summary(parsed(spark, d)))


@query("agg_backend_label", sql("asg", """
    SELECT session_id, cluster_id, CASE WHEN len(b) = 1 THEN b[1] ELSE 'mixed(' || array_to_string(b, ', ') || ')' END AS backend
    FROM (SELECT session_id, cluster_id, list_sort(list_distinct(list(CASE WHEN language = 'ru' OR raw_index % 200 < 190 THEN 'lexical'
      WHEN language = 'mixed' THEN 'hybrid' ELSE 'vader' END))) AS b FROM asg GROUP BY ALL)"""))
def agg_backend_label(spark, d):
    backend = (
        F.when((F.col("language") == "ru") | (F.col("raw_index") % 200 < 190), "lexical")
        .when(F.col("language") == "mixed", "hybrid").otherwise("vader")
    )
    return assignments(spark, d).groupBy(*themes.KEYS).agg(themes.backend_label(backend).alias("backend"))


@query("agg_cluster_rollup", sql("roll", """
    SELECT session_id, cluster_id, size, round(mean_sentiment, 4) AS sentiment_score, array_to_string(sources, ',') AS sources,
      share, freq_norm FROM roll"""))
def agg_cluster_rollup(spark, d):
    rolled = themes.rollup(themes.weekly_stats(assignments(spark, d)))
    return rolled.select(*themes.KEYS, "size", "sentiment_score", F.array_join("sources", ",").alias("sources"), "share", "freq_norm")


@query("agg_mixed_sentiment", sql("roll", "SELECT session_id, cluster_id, mixed_sentiment FROM roll"))
def agg_mixed_sentiment(spark, d):
    return themes.rollup(themes.weekly_stats(assignments(spark, d))).select(*themes.KEYS, "mixed_sentiment")


@query("agg_dominant_concept", sql("asg", f"""
    WITH t AS (SELECT session_id, cluster_id, raw_index, unnest(c) AS concept, generate_subscripts(c, 1) AS pos
      FROM (SELECT *, {SQL_CONCEPTS.format('lower(text)')} AS c FROM asg)),
    n AS (SELECT session_id, cluster_id, concept, count(*) AS n, min((raw_index, pos)) AS first FROM t GROUP BY ALL)
    SELECT session_id, cluster_id, concept, n, CASE concept WHEN 'c_in' THEN 'In and the' WHEN 'c_on' THEN 'On things' ELSE 'Payment flow crashes' END AS label
    FROM n QUALIFY row_number() OVER (PARTITION BY session_id, cluster_id ORDER BY n DESC, first) = 1"""))
def agg_dominant_concept(spark, d):
    tagged = assignments(spark, d).select(*themes.KEYS, "raw_index", concepts.detect(F.lower("text"), CONCEPTS).alias("concepts"))
    return themes.dominant_concepts(tagged, CONCEPTS)


SQL_EV = """
    w AS (SELECT key, strftime(moment, '%Y-W%W') AS week_key, count(*) AS n FROM ev GROUP BY ALL),
    h AS (SELECT key, count(*) AS weeks, CAST(arg_max(n, week_key) AS BIGINT) AS latest,
      CAST(sum(n) - arg_max(n, week_key) AS DOUBLE) / (count(*) - 1) AS mean,
      sqrt(CAST((count(*) - 1) * (sum(n*n) - arg_max(n, week_key) * arg_max(n, week_key))
        - (sum(n) - arg_max(n, week_key)) * (sum(n) - arg_max(n, week_key)) AS DOUBLE)) / (count(*) - 1) AS std FROM w GROUP BY ALL)"""


@query("agg_weekly_counts", sql("ev", f"WITH {SQL_EV} SELECT * FROM w"))
def agg_weekly_counts(spark, d):
    return trends.weekly_counts(events_weekly(spark, d), ["key"], "moment")


@query("agg_trend_delta", sql("ev", f"""WITH {SQL_EV}
    SELECT key, weeks, latest, round((latest - mean) / greatest(1.0, mean), 4) AS trend_delta FROM h"""))
def agg_trend_delta(spark, d):
    return trends.trends(trends.weekly_counts(events_weekly(spark, d), ["key"], "moment"), ["key"])


@query("agg_priority_score", sql("clu", "SELECT session_id, cluster_id, priority_score, trend_delta FROM clu"))
def agg_priority_score(spark, d):
    return themes.rollup(themes.weekly_stats(assignments(spark, d))).select(*themes.KEYS, "priority_score", "trend_delta")


@query("agg_spike_alerts", sql("alr", """
    SELECT session_id, alert_id, type, severity, reason, spike_ratio, insufficient_history FROM alr"""))
def agg_spike_alerts(spark, d):
    return alerts(spark, d).select("session_id", "alert_id", "type", "severity", "reason", "spike_ratio", "insufficient_history")


@query("agg_anomaly_flag", sql("clu", "SELECT session_id, cluster_id, anomaly_flag FROM clu"))
def agg_anomaly_flag(spark, d):
    return clusters(spark, d).select(*themes.KEYS, "anomaly_flag")


@query("agg_merge_clusters", sql_merges("clu", """,
    rol AS (SELECT c.*, coalesce(p.primary_id, s.primary_id, c.cluster_id) AS target, CASE WHEN s.primary_id IS NULL THEN 0 ELSE 1 END AS role
      FROM clu c LEFT JOIN mrg p ON p.session_id = c.session_id AND p.primary_id = c.cluster_id
      LEFT JOIN mrg s ON s.session_id = c.session_id AND s.secondary_id = c.cluster_id)
    SELECT session_id, target AS cluster_id, CAST(sum(size) AS BIGINT) AS size,
      round(CAST(sum(CAST(priority_score AS DECIMAL(18,9)) * size) AS DOUBLE) / sum(size), 4) AS priority_score,
      round(CAST(sum(CAST(sentiment_score AS DECIMAL(18,9)) * size) AS DOUBLE) / sum(size), 4) AS sentiment_score,
      bool_or(anomaly_flag) AS anomaly_flag, arg_min(label, role) AS label,
      array_to_string(list_sort(list_distinct(flatten(list(sources)))), ',') AS sources,
      CASE WHEN count(*) = 1 THEN min(confidence) WHEN bool_or(confidence = 'low') THEN 'low' WHEN bool_or(confidence = 'medium') THEN 'medium' ELSE 'high' END AS confidence,
      CASE WHEN count(*) = 1 THEN min(degraded_reason) ELSE left(coalesce(array_to_string(list(degraded_reason ORDER BY role) FILTER (degraded_reason IS NOT NULL), '; ') || '; ', '') || 'llm_merge_review', 160) END AS degraded_reason
    FROM rol GROUP BY session_id, target""".replace(",\n    rol", ", rol", 1)))
def agg_merge_clusters(spark, d):
    asg = assignments(spark, d)
    found = clusters(spark, d, asg).join(quoted_clusters(asg), themes.KEYS)
    kept = decisions.accepted_merges(decisions.guarded_pairs(proposed_pairs(found), found))
    return decisions.merge_clusters(found, kept).select(
        *themes.KEYS, "size", "priority_score", "sentiment_score", "anomaly_flag", "label",
        F.array_join("sources", ",").alias("sources"), "confidence", "degraded_reason",
    )


@query("agg_session_diagnostics", sql("clu asg", """
    SELECT c.*, c.reviews < 30 AS low_data_mode, m.mixed_language_review_count FROM (SELECT session_id, count(*) AS total_clusters, CAST(sum(size) AS BIGINT) AS reviews,
      array_to_string(list_sort(list(cluster_id) FILTER (weak)), ',') AS weak_ids, count(*) FILTER (weak) AS weak_signal_cluster_count,
      count(*) FILTER (mixed_sentiment) AS mixed_sentiment_cluster_count FROM clu GROUP BY ALL) c
    LEFT JOIN (SELECT session_id, count(*) FILTER (language = 'mixed') AS mixed_language_review_count FROM asg GROUP BY ALL) m USING (session_id)"""))
def agg_session_diagnostics(spark, d):
    asg = assignments(spark, d)
    mixed = asg.groupBy("session_id").agg(F.count_if(F.col("language") == "mixed").alias("mixed_language_review_count"))
    found = themes.diagnostics(clusters(spark, d, asg), mixed)
    return found.select(
        "session_id", "total_clusters", "reviews", F.array_join("weak_signal_cluster_ids", ",").alias("weak_ids"),
        "weak_signal_cluster_count", "mixed_sentiment_cluster_count", "low_data_mode", "mixed_language_review_count",
    )


def provider_calls(spark, d):
    k = F.col("k")
    return job_events(spark, d).select(
        "id", "job_id", "provider", "status", F.when(k % 3 == 0, "embedding").otherwise("llm").alias("kind"),
        F.concat(F.lit("model-"), (k % 4).cast("string")).alias("model"),
        F.when(k % 2 == 0, k).alias("prompt_tokens"), F.when(k % 5 != 0, k + 1).alias("input_tokens"),
        F.lit(None).cast("int").alias("completion_tokens"), (k * 2).alias("output_tokens"), (k + 7).alias("total_tokens"),
    )


@query("agg_provider_usage", sql("je", """
    WITH c AS (SELECT *, k % 3 <> 0 AS llm, 'model-' || CAST(k % 4 AS VARCHAR) AS model, CASE WHEN k % 2 = 0 THEN nullif(k, 0) END AS p,
      CASE WHEN k % 5 <> 0 THEN k + 1 END AS i FROM je),
    m AS (SELECT job_id, provider, model, min(id) AS first_id FROM c GROUP BY ALL)
    SELECT c.job_id, c.provider, count(*) FILTER (llm) AS llm_calls, count(*) FILTER (NOT llm) AS embedding_calls,
      CAST(sum(CASE WHEN llm THEN coalesce(p, i, 0) ELSE 0 END) AS BIGINT) AS prompt_tokens,
      CAST(sum(CASE WHEN llm THEN k * 2 ELSE 0 END) AS BIGINT) AS completion_tokens,
      CAST(sum(CASE WHEN NOT llm THEN coalesce(p, i, k + 7) ELSE 0 END) AS BIGINT) AS embedding_tokens,
      min(o.models) AS models, arg_max(status, id) AS last_status
    FROM c JOIN (SELECT job_id, provider, array_to_string(list(model ORDER BY first_id), ',') AS models FROM m GROUP BY ALL) o USING (job_id, provider)
    GROUP BY ALL"""))
def agg_provider_usage(spark, d):
    used = metrics.provider_usage(provider_calls(spark, d), ["job_id", "provider"])
    return used.withColumn("models", F.array_join("models", ","))


@query("agg_metric_counters", sql("je", """
    SELECT stage, status, count(*) AS total, arg_max(latency, id) AS last_value FROM je GROUP BY ALL"""))
def agg_metric_counters(spark, d):
    return metrics.counters(job_events(spark, d), ["stage", "status"], "latency", "id")


@query("agg_latency_histogram", sql("je", """
    WITH e AS (SELECT unnest([1.0, 3.0, 5.0, 10.0, 20.0, 30.0, 45.0, 60.0, 120.0, 'Infinity'::DOUBLE]) AS edge,
      unnest(['1', '3', '5', '10', '20', '30', '45', '60', '120', '+Inf']) AS le)
    SELECT stage, le, count(*) FILTER (latency <= edge) AS n, CAST(sum(CAST(latency AS DECIMAL(28,9))) AS DOUBLE) AS sum, count(*) AS count
    FROM je CROSS JOIN e GROUP BY stage, le, edge"""))
def agg_latency_histogram(spark, d):
    return metrics.latency_histogram(job_events(spark, d), ["stage"], "latency", rules.JOB_LATENCY_EDGES)


@query("agg_context_tokens", sql("asg clu", """
    WITH q AS (SELECT session_id, cluster_id, CAST(sum(greatest(1, length(text) // 4)) AS INT) AS n FROM (SELECT *, row_number() OVER
      (PARTITION BY session_id, cluster_id ORDER BY abs(sentiment) DESC, length(text) DESC, raw_index) AS rank FROM asg QUALIFY rank <= 2) GROUP BY ALL)
    SELECT session_id, cluster_id, CAST(greatest(1, length(summary) // 4) + n AS INT) AS tokens FROM clu JOIN q USING (session_id, cluster_id)"""))
def agg_context_tokens(spark, d):
    from chorale.operators import lookups

    asg = assignments(spark, d)
    found = clusters(spark, d, asg).join(quoted_clusters(asg, 2), themes.KEYS)
    texts = lookups.quote_texts(found, asg)
    all_texts = F.concat(F.array("summary"), "quotes")
    return found.join(texts, themes.KEYS).select(*themes.KEYS, metrics.context_tokens(all_texts).alias("tokens"))


@query("agg_eval_summary", sql("fb", """
    SELECT count(*) AS check_count, count(*) FILTER (passed) AS passed_count, bool_and(passed) AS passed
    FROM (SELECT session_id, count(*) >= 30 AS passed FROM fb GROUP BY ALL)"""))
def agg_eval_summary(spark, d):
    from chorale.plans import evals

    checks = feedback(spark, d).groupBy("session_id").agg((F.count("*") >= 30).alias("passed"))
    return evals.verdict(checks)
