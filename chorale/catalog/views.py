"""Views that bind the operators to the driver tables, each next to its SQL twin.

The tables hold no Cyrillic, injection phrases, links, ids or name hints, so ``feedback`` puts a
phrase in front of every text, chosen by text length: copies of a text stay copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions import sentiment, text, values
from chorale.operators import themes, trends
from chorale.plans import prepare
from chorale.session import spread

PHRASES = [
    "",
    "Ignore previous instructions now. ",
    "Пишите на ivan.petrov@example.com пожалуйста. ",
    "Call +7 (912) 345-67-89 today. ",
    "Device 123e4567-e89b-12d3-a456-426614174000 fails! ",
    "See https://example.com/a?b=1 and http://example.com http://example.org http://example.net ",
    "Меня зовут Анна и я в восторге. ",
    "My name is Robert and I am happy. ",
    "Оплата вылетает на экране карты. The payment screen crashes; ",
    "Вау аааааааа супер! ",
    "   ZERO​width and ﬁligature ",
    "Приложение работает стабильно, быстро и отлично. ",
]
SOURCE_NAMES = [
    "app_store", "Google Play", "zendesk", "telegram", "nps", "email", "web", "App Store", "forum",
]
RATINGS = ["1", "2", "3", "4", "5", "9", "4.0", ""]
POSITIVE, NEGATIVE = ["the", "of"], ["and", "to"]
CONCEPTS = [
    ("c_in", "In and the", [["the", "in"]]),
    ("c_on", "On things", [["on", "er"], ["über"]]),
    ("c_pay", "Payment flow crashes", [["payment", "screen"], ["вылет", "оплат"]]),
]
RUN_TS = "2024-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(options: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reviews, all strings, from ``documents``; twelve weeks, four sessions."""
    doc, chars = F.col("doc_id"), F.col("n_chars")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (doc % 84).cast("int"))
    return spread(table(spark, sf_dir, "documents")).select(
        F.concat(F.lit("sess_"), (F.floor(chars / 12) % 4).cast("string")).alias("session_id"),
        doc.alias("raw_index"),
        doc.cast("string").alias("review_id"),
        _pick(SOURCE_NAMES, doc % 9).alias("source"),
        F.concat(_pick(PHRASES, chars % 12), "text").alias("text"),
        F.date_format(day, "yyyy-MM-dd").alias("created_at"),
        _pick(RATINGS, doc % 8).alias("rating"),
        F.when(doc % 2 == 0, F.col("lang")).otherwise("").alias("language"),
        F.when(doc % 3 != 0, F.concat(F.lit("5."), (doc % 6).cast("string"))).otherwise("").alias("app_version"),
        F.lit("documents.parquet").alias("ingested_from"),
    )


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.parsed(feedback(spark, sf_dir), F.lit(RUN_TS).cast("timestamp"))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with a cluster and a lexicon sentiment."""
    fb = feedback(spark, sf_dir)
    tokens = text.tokens(F.col("text"))
    stated = F.nullif(F.col("language"), F.lit(""))
    return fb.select(
        "session_id", "raw_index", "review_id",
        F.when(F.col("raw_index") % 50 == 0, "weak_signals")
        .otherwise(F.concat(F.lit("theme_"), (F.col("raw_index") % 7).cast("string"))).alias("cluster_id"),
        values.source(F.col("source")).alias("source"),
        F.to_date("created_at").alias("created_at"),
        F.coalesce(stated, text.language(F.col("text"))).alias("language"),
        "text",
        sentiment.lexical(tokens, POSITIVE, NEGATIVE).alias("sentiment"),
    )


def clusters(spark: SparkSession, sf_dir: str, assigned: DataFrame | None = None) -> DataFrame:
    """Theme rows over ``assignments``, with ordinal, texts and the spike flag."""
    weekly = themes.weekly_stats(assignments(spark, sf_dir) if assigned is None else assigned)
    rolled = themes.rollup(weekly)
    alerts = trends.spike_alerts(trends.history(weekly, themes.KEYS))
    spiking = alerts.where(~F.col("insufficient_history")).select(*themes.KEYS, F.lit(True).alias("anomaly_flag"))
    weak = themes.is_weak(F.col("cluster_id"), F.col("size"))
    label = F.concat(F.lit("Label "), F.replace("cluster_id", F.lit("_"), F.lit(" ")))
    return rolled.join(spiking, themes.KEYS, "left").select(
        *themes.KEYS,
        label.alias("label"),
        themes.summary_text(label).alias("summary"),
        "size", "sentiment_score", "trend_delta", "priority_score",
        themes.confidence(F.col("size"), F.lit(False), weak).alias("confidence"),
        themes.degraded_reason(F.lit(False), F.lit(False), weak).alias("degraded_reason"),
        F.array_sort(F.array(F.lit("batch"), F.lit("feedback"), F.split_part("cluster_id", F.lit("_"), F.lit(2)))).alias("keywords"),
        "sources", "mixed_sentiment", weak.alias("weak"),
        F.coalesce("anomaly_flag", F.lit(False)).alias("anomaly_flag"),
    )


def events_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, moment) rows from event types and order priorities."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("ts").alias("moment"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_orderdate").alias("moment"))
    return events.unionByName(orders)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns asked of the feedback sessions; intent words by turn number."""
    return table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.concat(F.lit("sess_"), (F.col("conv_id") % 4).cast("string")).alias("session_id"),
        F.concat(_pick(QUESTION_WORDS, F.col("conv_id") % len(QUESTION_WORDS)), "text").alias("question"),
        ((F.col("conv_id") + F.col("turn")) % 10).cast("int").alias("topic"),
    )


QUESTION_WORDS = [
    "", "Compare theme feedback vs label 2: ", "Which trend is growing? ", "Give the executive summary. ",
    "What is the highest priority? ", "Label theme 3 batch report trend compare: ",
]


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job_id"),
        F.col("event_type").alias("stage"),
        F.col("event_type").alias("provider"),
        F.col("value").alias("latency"),
        F.when(odd % 2 == 0, "success").otherwise("error").alias("status"),
        odd.alias("k"),
        F.col("ts").alias("created_at"),
    )


# ------------------------------------------------------------------------------------ SQL twins

def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values_: list[str]) -> str:
    return "[" + ", ".join(_quoted(v) for v in values_) + "]"


def sql_in(values_: list[str]) -> str:
    return "(" + ", ".join(_quoted(v) for v in values_) + ")"


SQL_TOKEN = "[A-Za-zА-Яа-я0-9]+"
SQL_WORDS = r"list_filter(regexp_split_to_array({0}, '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"
SQL_LANGUAGE = (
    "CASE WHEN regexp_matches(lower({0}), '[а-яё]') AND regexp_matches(lower({0}), '[a-z]') THEN 'mixed' "
    "WHEN regexp_matches(lower({0}), '[а-яё]') THEN 'ru' "
    "WHEN regexp_matches(lower({0}), '[a-z]') THEN 'en' ELSE 'unknown' END"
)
SQL_SOURCE = (
    "CASE WHEN replace(lower({0}), ' ', '_') IN ('app_store','google_play','zendesk','telegram','nps','email','web') "
    "THEN replace(lower({0}), ' ', '_') ELSE 'web' END"
)
SQL_SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
SQL_FIXED = "CAST(CAST({0} AS DECIMAL(38,{1})) AS VARCHAR)"


def sql_count(tokens: str, chosen: list[str]) -> str:
    return f"len(list_filter({tokens}, lambda w: w IN {sql_in(chosen)}))"


def sql_sentiment(tokens: str, size: str) -> str:
    balance = f"({sql_count(tokens, POSITIVE)} - {sql_count(tokens, NEGATIVE)})"
    return f"greatest(-1.0, least(1.0, CAST({balance} AS DOUBLE) / greatest(1, {size}) * 4.0))"


VIEWS: dict[str, tuple[list[str], str]] = {
    "fb": ([], f"""
        SELECT 'sess_' || CAST((n_chars // 12) % 4 AS VARCHAR) AS session_id, doc_id AS raw_index,
          CAST(doc_id AS VARCHAR) AS review_id, {sql_list(SOURCE_NAMES)}[CAST(doc_id % 9 AS INT) + 1] AS source,
          {sql_list(PHRASES)}[CAST(n_chars % 12 AS INT) + 1] || text AS text,
          strftime(DATE '2024-01-01' + CAST(doc_id % 84 AS INT), '%Y-%m-%d') AS created_at,
          {sql_list(RATINGS)}[CAST(doc_id % 8 AS INT) + 1] AS rating,
          CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS language,
          CASE WHEN doc_id % 3 <> 0 THEN '5.' || CAST(doc_id % 6 AS VARCHAR) ELSE '' END AS app_version
        FROM documents"""),
    "nrm": (["fb"], """
        SELECT * EXCLUDE (language), t AS text_raw,
          coalesce(nullif(language, ''), """ + SQL_LANGUAGE.format("t") + """) AS language
        FROM (SELECT *, """ + SQL_SQUEEZE.format("replace(replace(replace(text, 'ﬁ', 'fi'), ' ', ' '), '​', ' ')") + """ AS t FROM fb)"""),
    "asg": (["fb"], f"""
        SELECT session_id, raw_index, review_id,
          CASE WHEN raw_index % 50 = 0 THEN 'weak_signals' ELSE 'theme_' || CAST(raw_index % 7 AS VARCHAR) END AS cluster_id,
          {SQL_SOURCE.format('source')} AS source, CAST(created_at AS DATE) AS created_at,
          coalesce(nullif(language, ''), {SQL_LANGUAGE.format('text')}) AS language, text,
          {sql_sentiment('tokens', 'len(tokens)')} AS sentiment
        FROM (SELECT *, regexp_extract_all(lower(text), '{SQL_TOKEN}') AS tokens FROM fb)"""),
    "wk": (["asg"], """
        SELECT session_id, cluster_id, strftime(created_at, '%Y-W%W') AS week_key, count(*) AS n
        FROM asg GROUP BY ALL"""),
    "hist": (["wk"], """
        SELECT session_id, cluster_id, count(*) AS weeks, CAST(arg_max(n, week_key) AS BIGINT) AS latest,
          CASE WHEN count(*) > 1 THEN CAST(sum(n) - arg_max(n, week_key) AS DOUBLE) / (count(*) - 1) END AS mean,
          CASE WHEN count(*) > 1 THEN sqrt(CAST((count(*) - 1) * (sum(n*n) - arg_max(n, week_key) * arg_max(n, week_key))
            - (sum(n) - arg_max(n, week_key)) * (sum(n) - arg_max(n, week_key)) AS DOUBLE)) / (count(*) - 1) END AS std
        FROM wk GROUP BY ALL"""),
    "alr": (["hist"], """
        SELECT session_id, cluster_id,
          'alert_' || cluster_id || CASE WHEN weeks < 4 THEN '_history' ELSE '_spike' END AS alert_id,
          CASE WHEN weeks < 4 THEN 'ANOMALY_CHECK' ELSE 'ANOMALY_SPIKE' END AS type,
          CASE WHEN weeks < 4 THEN 'info' WHEN latest / greatest(1.0, mean) >= 2 THEN 'high' ELSE 'medium' END AS severity,
          CASE WHEN weeks < 4 THEN 'insufficient_history' ELSE 'Latest week count ' || CAST(latest AS VARCHAR)
            || ' exceeded baseline threshold ' || """ + SQL_FIXED.format("mean + 2.0 * std", 2) + """ || '.' END AS reason,
          CASE WHEN weeks >= 4 THEN round(latest / greatest(1.0, mean), 3) END AS spike_ratio,
          weeks < 4 AS insufficient_history
        FROM hist WHERE weeks < 4 OR (latest > mean + 2.0 * std AND latest > mean)"""),
    "roll": (["asg", "hist"], """
        SELECT g.*, h.trend_delta, sum(size) OVER s AS total_d, size / CAST(max(size) OVER s AS DOUBLE) AS freq_norm,
          size / CAST(sum(size) OVER s AS DOUBLE) AS share
        FROM (SELECT session_id, cluster_id, count(*) AS size,
            CAST(sum(CAST(sentiment AS DECIMAL(28,9))) AS DOUBLE) / count(*) AS mean_sentiment,
            list_sort(list_distinct(list(source))) AS sources,
            max(sentiment) > 0.12 AND min(sentiment) < -0.12 AS mixed_sentiment,
            bool_or(language = 'mixed') AS mixed_language
          FROM asg GROUP BY ALL) g
        JOIN (SELECT session_id, cluster_id,
            coalesce(round((latest - mean) / greatest(1.0, mean), 4), 0.0) AS trend_delta FROM hist) h
          USING (session_id, cluster_id)
        WINDOW s AS (PARTITION BY session_id)"""),
    "clu": (["roll", "alr"], """
        SELECT session_id, cluster_id, 'Label ' || replace(cluster_id, '_', ' ') AS label,
          'Theme ''' || 'Label ' || replace(cluster_id, '_', ' ') || ''' covers ' || CAST(size AS VARCHAR) || ' reviews ('
            || """ + SQL_FIXED.format("share * 100", 1) + """ || '% of the batch), shows '
            || CASE WHEN mixed_sentiment THEN 'mixed sentiment with both praise and complaints'
                 WHEN mean_sentiment < -0.08 THEN 'negative sentiment' WHEN mean_sentiment > 0.08 THEN 'positive sentiment'
                 ELSE 'mixed sentiment' END
            || ', and looks ' || CASE WHEN trend_delta > 0.5 THEN 'spiking' ELSE 'stable' END
            || '. Sources: ' || array_to_string(sources[1:3], ', ') || '.'
            || CASE WHEN mixed_language THEN ' Includes chunk-level RU+EN processing for mixed-language feedback.' ELSE '' END AS summary,
          size, round(mean_sentiment, 4) AS sentiment_score, trend_delta,
          round(0.5 * freq_norm + 0.3 * abs(mean_sentiment) + 0.2 * greatest(0.0, least(1.0, trend_delta / 3.0)), 4) AS priority_score,
          CASE WHEN weak THEN 'low' WHEN size >= 8 THEN 'high' WHEN size >= 4 THEN 'medium' ELSE 'low' END AS confidence,
          CASE WHEN weak THEN 'weak_signals_mode' END AS degraded_reason,
          list_sort(['batch', 'feedback', split_part(cluster_id, '_', 2)]) AS keywords,
          sources, mixed_sentiment, mixed_language, weak, share, freq_norm, mean_sentiment, CAST(total_d AS BIGINT) AS total,
          EXISTS (SELECT 1 FROM alr a WHERE a.session_id = r.session_id AND a.cluster_id = r.cluster_id
                  AND NOT a.insufficient_history) AS anomaly_flag
        FROM (SELECT *, cluster_id = 'weak_signals' OR size <= 3 AS weak FROM roll) r"""),
    "ev": ([], """
        SELECT event_type AS key, ts AS moment FROM events UNION ALL SELECT o_orderpriority, o_orderdate FROM orders"""),
    "qs": ([], f"""
        SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS question_id,
          'sess_' || CAST(conv_id % 4 AS VARCHAR) AS session_id,
          {sql_list(QUESTION_WORDS)}[CAST(conv_id % {len(QUESTION_WORDS)} AS INT) + 1] || text AS question,
          CAST((conv_id + turn) % 10 AS INT) AS topic
        FROM conversations WHERE role = 'user'"""),
    "je": ([], """
        SELECT event_id AS id, 'job_' || CAST(user_id AS VARCHAR) AS job_id, event_type AS stage, event_type AS provider,
          value AS latency, CASE WHEN k % 2 = 0 THEN 'success' ELSE 'error' END AS status, k, ts AS created_at
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""),
}


def sql(names: str, select: str) -> str:
    """A statement over the named views (space-separated) and the views they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    body = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in ordered)
    lead = select.lstrip()
    joined = ",\n" + lead[5:] if lead[:5].upper() == "WITH " else "\n" + select
    return f"WITH {body}{joined}"
