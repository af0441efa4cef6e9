"""Row-level text and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale import rules
from chorale.catalog.core import query
from chorale.catalog.views import (
    CONCEPTS, NEGATIVE, POSITIVE, RUN_TS, SQL_FIXED, SQL_LANGUAGE, SQL_SOURCE, SQL_SQUEEZE, SQL_TOKEN,
    SQL_WORDS, assignments, clusters, events_weekly, feedback, job_events, parsed, questions, sql,
    sql_in, sql_sentiment, table,
)
from chorale.functions import concepts, flags, privacy, sentiment, text, values, vectors
from chorale.operators import themes
from chorale.plans import prepare
from chorale.session import settled



def normalized(spark, d):
    """Feedback with the normalized text and the detected or given language."""
    fb = feedback(spark, d).withColumn("text_raw", text.pinned(text.normalize(F.col("text"))))
    return fb.withColumn(
        "language", F.coalesce(F.nullif("language", F.lit("")), text.language(F.col("text_raw")))
    )


@query("txt_normalize", sql("nrm", "SELECT review_id, text_raw FROM nrm"))
def txt_normalize(spark, d):
    return normalized(spark, d).select("review_id", "text_raw")


@query("txt_slugify", sql("nrm", """
    SELECT review_id, coalesce(nullif(trim(regexp_replace(lower(text_raw), '[^a-zа-я0-9]+', '_', 'g'), '_'), ''), 'cluster') AS slug
    FROM nrm"""))
def txt_slugify(spark, d):
    return normalized(spark, d).select("review_id", text.slugify(F.col("text_raw")).alias("slug"))


@query("txt_tokenize", sql("fb", f"""
    SELECT review_id, CAST(len(t) AS INT) AS n_tokens, array_to_string(t, ' ') AS tokens
    FROM (SELECT review_id, regexp_extract_all(lower(text), '{SQL_TOKEN}') AS t FROM fb)"""))
def txt_tokenize(spark, d):
    found = feedback(spark, d).select("review_id", text.tokens(F.col("text")).alias("t"))
    return found.select("review_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("txt_word_split", sql("fb", f"""
    SELECT review_id, CAST(len(w) AS INT) AS n_words, array_to_string(w, ' ') AS words
    FROM (SELECT review_id, {SQL_WORDS.format('text')} AS w FROM fb)"""))
def txt_word_split(spark, d):
    found = feedback(spark, d).select("review_id", text.words(F.col("text")).alias("w"))
    return found.select("review_id", F.size("w").alias("n_words"), F.array_join("w", " ").alias("words"))


@query("txt_estimate_tokens", sql("fb", "SELECT review_id, CAST(greatest(1, length(text) // 4) AS INT) AS n FROM fb"))
def txt_estimate_tokens(spark, d):
    return feedback(spark, d).select("review_id", text.estimate_tokens(F.col("text")).alias("n"))


@query("txt_trim_words", sql("nrm", """
    SELECT review_id, CASE WHEN len(p) > 200 THEN array_to_string(p[1:200], ' ') || '...' ELSE text_raw END AS trimmed
    FROM (SELECT review_id, text_raw, string_split(text_raw, ' ') AS p FROM nrm)"""))
def txt_trim_words(spark, d):
    return normalized(spark, d).select("review_id", text.trim_words(F.col("text_raw"), 200).alias("trimmed"))


DATE_FORMS = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy", "dd.MM.yyyy HH:mm",
              "yyyy-MM-dd'T'HH:mm:ss+03:00", "'on 'yyyy"]


@query("ts_parse", r"""
    WITH raw AS (SELECT o_orderkey, o_orderdate + INTERVAL (o_orderkey % 86400) SECOND AS t FROM orders),
    txt AS (SELECT o_orderkey, CASE o_orderkey % 7
        WHEN 0 THEN strftime(t, '%Y-%m-%d') WHEN 1 THEN strftime(t, '%Y-%m-%dT%H:%M:%SZ')
        WHEN 2 THEN strftime(t, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(t, '%d.%m.%Y')
        WHEN 4 THEN strftime(t, '%d.%m.%Y %H:%M') WHEN 5 THEN strftime(t, '%Y-%m-%dT%H:%M:%S+03:00')
        ELSE strftime(t, 'on %Y') END AS c FROM raw)
    SELECT o_orderkey, c AS given, strftime(coalesce(
        try_strptime(c, ['%Y-%m-%d', '%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%d %H:%M:%S', '%d.%m.%Y', '%d.%m.%Y %H:%M']),
        try_strptime(c, '%Y-%m-%dT%H:%M:%S+03:00') - INTERVAL 3 HOUR, TIMESTAMP '2024-06-01 00:00:00'),
        '%Y-%m-%d %H:%M:%S') AS parsed FROM txt""")
def ts_parse(spark, d):
    moment = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400)
    forms = F.array(*[F.date_format(moment, form) for form in DATE_FORMS])
    given = F.element_at(forms, (F.col("o_orderkey") % 7 + 1).cast("int"))
    found = values.timestamp(F.col("given"), F.lit(RUN_TS).cast("timestamp"))
    rows = table(spark, d, "orders").select("o_orderkey", given.alias("given"))
    return rows.select("o_orderkey", "given", F.date_format(found, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("ts_week_key", sql("ev", "SELECT key, strftime(moment, '%Y-W%W') AS week_key, count(*) AS n FROM ev GROUP BY ALL"))
def ts_week_key(spark, d):
    keyed = events_weekly(spark, d).select("key", values.week_key(F.col("moment")).alias("week_key"))
    return keyed.groupBy("key", "week_key").agg(F.count("*").alias("n"))


@query("num_parse_rating", sql("fb", r"""
    SELECT review_id, r AS given, CASE WHEN regexp_matches(r, '^\s*[+-]?\d+\s*$')
      THEN CAST(greatest(1, least(5, CAST(trim(r) AS HUGEINT))) AS INT) END AS rating
    FROM (SELECT review_id, CASE CAST(raw_index % 11 AS INT) WHEN 3 THEN '-' || rating WHEN 5 THEN ' ' || rating || ' '
      WHEN 7 THEN rating || '00000000000000000000' ELSE rating END AS r FROM fb)"""))
def num_parse_rating(spark, d):
    form = F.col("raw_index") % 11
    given = (
        F.when(form == 3, F.concat(F.lit("-"), "rating")).when(form == 5, F.concat(F.lit(" "), "rating", F.lit(" ")))
        .when(form == 7, F.concat("rating", F.lit("0" * 20))).otherwise(F.col("rating"))
    )
    rows = feedback(spark, d).select("review_id", given.alias("given"))
    return rows.select("review_id", "given", values.rating(F.col("given")).alias("rating"))


@query("src_canonical", sql("fb", f"SELECT review_id, source AS given, {SQL_SOURCE.format('source')} AS source FROM fb"))
def src_canonical(spark, d):
    return feedback(spark, d).select(
        "review_id", F.col("source").alias("given"), values.source(F.col("source")).alias("source")
    )


@query("lang_detect", sql("fb", f"SELECT review_id, {SQL_LANGUAGE.format('text')} AS language FROM fb"))
def lang_detect(spark, d):
    return feedback(spark, d).select("review_id", text.language(F.col("text")).alias("language"))


SQL_CHUNKS = r"list_filter(string_split(regexp_replace({0}, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda p: trim(p) <> '')"


@query("lang_chunks", sql("nrm", f"""
    SELECT review_id, CAST(len(c) AS INT) AS n_chunks,
      array_to_string(list_transform(c, lambda p: {SQL_LANGUAGE.format('p')}), ',') AS languages,
      CAST(list_sum(list_transform(c, lambda p: length(p))) AS BIGINT) AS chars,
      CAST(list_sum(list_transform(c, lambda p: len({SQL_WORDS.format('p')}))) AS BIGINT) AS words
    FROM (SELECT review_id, {SQL_CHUNKS.format('text_raw')} AS c FROM nrm)"""))
def lang_chunks(spark, d):
    chunks = normalized(spark, d).select("review_id", text.language_chunks(F.col("text_raw")).alias("c"))
    total = lambda f: F.aggregate("c", F.lit(0).cast("bigint"), lambda n, c: n + c[f])
    return chunks.select(
        "review_id", F.size("c").alias("n_chunks"),
        F.array_join(F.transform("c", lambda c: c["language"]), ",").alias("languages"),
        total("char_count").alias("chars"), total("token_count").alias("words"),
    )


@query("flag_injection", sql("fb", f"SELECT review_id, regexp_matches(text, '(?i){'|'.join(rules.INJECTION_PHRASES)}') AS flagged FROM fb"))
def flag_injection(spark, d):
    return feedback(spark, d).select("review_id", flags.is_injection(F.col("text")).alias("flagged"))


@query("flag_low_information", sql("fb", f"""
    SELECT review_id, len({SQL_WORDS.format('text')}) < 3 OR length(text) < 12 AS flagged FROM fb"""))
def flag_low_information(spark, d):
    return feedback(spark, d).select("review_id", flags.is_low_information(F.col("text"), text.words(F.col("text"))).alias("flagged"))


# Counts per character, then the entropy; the twin explodes characters, which Spark never does.
SQL_PERPLEXITY = r"""
    WITH chars AS (SELECT review_id, unnest(string_split(lower(regexp_replace(text, '[\s\p{{Z}}]', '', 'g')), '')) AS c FROM {0}),
    cnt AS (SELECT review_id, c, CAST(count(*) AS DOUBLE) AS n FROM chars WHERE c <> '' GROUP BY ALL),
    ppl AS (SELECT review_id, CASE WHEN sum(n) < 8 THEN 1.0
      ELSE pow(2.0, log2(sum(n)) - sum(n * log2(n)) / sum(n)) END AS p FROM cnt GROUP BY ALL)
"""


@query("txt_perplexity", sql("fb", SQL_PERPLEXITY.format("fb") + "SELECT review_id, round(p, 5) AS perplexity FROM ppl"))
def txt_perplexity(spark, d):
    return feedback(spark, d).select("review_id", F.round(text.perplexity(F.col("text")), 5).alias("perplexity"))


SQL_REPEATED = r"regexp_matches(lower({0}), 'а{{7}}|a{{7}}|e{{7}}|-{{7}}|={{7}}|\*{{7}}|_{{7}}|0{{7}}|1{{7}}|!{{7}}|\.{{7}}|#{{7}}|~{{7}}|x{{7}}')"
SQL_SPAM = f"""
    SELECT review_id, (length(l) - length(replace(l, 'http', ''))) // 4 > 2 OR {SQL_REPEATED.format('l')}
      OR (len(w) >= 6 AND CAST(len(list_distinct(w)) AS DOUBLE) / greatest(1, len(w)) < 0.35) OR (len(w) >= 8 AND p < 3.2) AS flagged
    FROM (SELECT review_id, lower(text) AS l, {SQL_WORDS.format('lower(text)')} AS w, p FROM {{0}} JOIN ppl USING (review_id))"""


@query("flag_spam", sql("fb", SQL_PERPLEXITY.format("fb") + SQL_SPAM.replace("{0}", "fb")))
def flag_spam(spark, d):
    rows = feedback(spark, d).withColumn("w", text.words(F.lower(F.col("text"))))
    return rows.select("review_id", flags.is_spam(F.col("text"), F.col("w")).alias("flagged"))


SQL_MASKS = [
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[EMAIL]"),
    (r"(?:(?:\+|00)\d{1,3}[-\s()]*)?(?:\d[-\s()]*){9,14}\d", "[PHONE]"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "[DEVICE_ID]"),
    (r"(?i)https?://\S+", "[URL]"),
    (r"(?i)(^|[^\p{L}\p{N}_])(?:(my) name is|(i) am|(i''m)|(меня) зовут|(это)|(зовут))\s+[A-ZА-Я][a-zа-я]{2,20}($|[^\p{L}\p{N}_])",
     r"\1\2\3\4\5\6\7 [PERSON]\8"),
]


def sql_masked(expr: str) -> str:
    for pattern, replacement in SQL_MASKS:
        expr = f"regexp_replace({expr}, '{pattern}', '{replacement}', 'g')"
    return expr


def sql_hits(expr: str) -> str:
    parts = []
    for pattern, replacement in SQL_MASKS:
        parts.append(f"len(regexp_extract_all({expr}, '{pattern}'))")
        expr = f"regexp_replace({expr}, '{pattern}', '{replacement}', 'g')"
    return "(" + " + ".join(parts) + ")"


@query("pii_mask_regex", sql("nrm", f"""
    SELECT review_id, {sql_masked('text_raw')} AS masked, CAST({sql_hits('text_raw')} AS INT) AS pii_hits FROM nrm"""))
def pii_mask_regex(spark, d):
    return privacy.with_masked(normalized(spark, d), "text_raw").select("review_id", "masked", "pii_hits")


SQL_BY_CHUNK = f"""
    SELECT *, array_to_string(list_transform(c, lambda p: {sql_masked('p')}), ' ') AS m,
      CAST(list_sum(list_transform(c, lambda p: {sql_hits('p')})) AS INT) AS h
    FROM (SELECT *, {SQL_CHUNKS.format('text_raw')} AS c FROM nrm)"""


@query("pii_mask_chunks", sql("nrm", f"""
    SELECT review_id, m AS masked, h AS pii_hits, CAST(len(c) AS INT) AS n_chunks FROM ({SQL_BY_CHUNK})"""))
def pii_mask_chunks(spark, d):
    found = normalized(spark, d).select("review_id", privacy.masked_by_chunk(F.col("text_raw")).alias("m"))
    return found.select(
        "review_id", F.col("m.text").alias("masked"), F.col("m.hits").alias("pii_hits"), F.size("m.chunks").alias("n_chunks")
    )


# Spans as a name model would give them: the first two long capitalised words of every text, one
# of them overlapping, one labelled as a place.
def person_spans(rows, column="masked"):
    words = F.regexp_extract_all(column, F.lit("([A-Z][a-z]{3,})"), F.lit(1))
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    begin = lambda w: F.instr(F.col(column), w) - 1
    span = lambda w, start, size, label: F.struct(
        start.alias("start"), (start + size).alias("end"), F.lit(label).alias("label"), w.alias("text")
    )
    options = F.array(
        span(first, begin(first), F.length(first), "PERSON"),
        span(first, begin(first) + 1, F.length(first), "PER"),
        span(second, begin(second), F.length(second), "ORG"),
    )
    found = rows.select("session_id", "review_id", F.explode(options).alias("s"))
    return found.where(F.col("s.text").isNotNull()).select("session_id", "review_id", F.lit("en").alias("model"), "s.*")


@query("pii_mask_spans", sql("nrm", r"""
    WITH w AS (SELECT review_id, text_raw AS t, regexp_extract_all(text_raw, '[A-Z][a-z]{3,}')[1] AS f FROM nrm)
    SELECT review_id, CASE WHEN f IS NULL THEN t ELSE substr(t, 1, instr(t, f)) || '[PERSON]' || substr(t, instr(t, f) + 1 + length(f)) END AS masked,
      CASE WHEN f IS NULL THEN 0 ELSE 1 END AS span_hits FROM w"""))
def pii_mask_spans(spark, d):
    rows = normalized(spark, d).select("session_id", "review_id", F.col("text_raw").alias("masked"))
    return privacy.with_spans_masked(rows, person_spans(rows), ["en"]).select("review_id", "masked", "span_hits")


@query("pii_mask_pipeline", sql("nrm", f"""
    WITH r AS (SELECT review_id, language, {sql_masked('text_raw')} AS t, CAST({sql_hits('text_raw')} AS INT) AS h FROM nrm),
    w AS (SELECT *, CASE WHEN language IN ('en', 'mixed') THEN regexp_extract_all(t, '[A-Z][a-z]{{3,}}')[1] END AS f FROM r)
    SELECT review_id, CASE WHEN f IS NULL THEN t ELSE substr(t, 1, instr(t, f)) || '[PERSON]' || substr(t, instr(t, f) + 1 + length(f)) END AS masked,
      h + CASE WHEN f IS NULL THEN 0 ELSE 1 END AS pii_hits,
      CASE WHEN language IN ('ru', 'en', 'mixed') THEN 'regex+spacy' ELSE 'regex' END AS pii_backend FROM w"""))
def pii_mask_pipeline(spark, d):
    rows = privacy.with_masked(normalized(spark, d), "text_raw").select("session_id", "review_id", "language", "masked", "pii_hits")
    rows = settled(rows, "masked")  # what the span models read
    done = privacy.with_person_pipeline(rows, person_spans(rows))
    return done.select("review_id", "masked", "pii_hits", "pii_backend")


@query("pii_residual", sql("fb", f"""
    SELECT review_id, {" OR ".join(f"regexp_matches(text, '{p}')" for p, _ in SQL_MASKS[:3])} AS residual FROM fb"""))
def pii_residual(spark, d):
    return feedback(spark, d).select("review_id", privacy.has_residual(F.col("text")).alias("residual"))


SQL_FINAL_MASK = f"""
    fin AS (SELECT n.*, CASE WHEN n.language = 'mixed' THEN b.m ELSE {sql_masked('n.text_raw')} END AS masked,
      CASE WHEN n.language = 'mixed' THEN b.h ELSE CAST({sql_hits('n.text_raw')} AS INT) END AS pii_hits
      FROM nrm n LEFT JOIN (SELECT review_id, m, h FROM ({SQL_BY_CHUNK}) WHERE language = 'mixed') b USING (review_id))"""


@query("hash_dedupe", sql("nrm", f"""
    WITH {SQL_FINAL_MASK} SELECT review_id, sha256({SQL_SQUEEZE.format('lower(masked)')}) AS dedupe_hash FROM fin"""))
def hash_dedupe(spark, d):
    return parsed(spark, d).select("review_id", "dedupe_hash")


SQL_FLAGS = SQL_PERPLEXITY.format("(SELECT review_id, text_raw AS text FROM nrm)") + f""",
    {SQL_FINAL_MASK.strip()},
    spm AS ({SQL_SPAM.replace("{0}", "(SELECT review_id, text_raw AS text FROM nrm)")}),
    flg AS (SELECT f.*, regexp_matches(text_raw, '(?i){'|'.join(rules.INJECTION_PHRASES)}') AS injection, flagged AS spam,
      len({SQL_WORDS.format('text_raw')}) < 3 OR length(text_raw) < 12 AS low FROM fin f JOIN spm USING (review_id))"""


@query("flags_build", sql("nrm", SQL_FLAGS + """
    SELECT review_id, array_to_string(list_filter([CASE WHEN injection THEN 'injection_suspected' END, CASE WHEN spam THEN 'spam' END,
      CASE WHEN low THEN 'low_information' END, CASE WHEN pii_hits > 0 THEN 'pii_found' END,
      CASE WHEN language = 'mixed' THEN 'mixed_language' END], lambda f: f IS NOT NULL), ',') AS flags FROM flg"""))
def flags_build(spark, d):
    return parsed(spark, d).select("review_id", F.array_join("flags", ",").alias("flags"))


@query("sent_lexical", sql("asg", "SELECT review_id, sentiment FROM asg"))
def sent_lexical(spark, d):
    return assignments(spark, d).select("review_id", "sentiment")


@query("sent_route", sql("asg", """
    SELECT review_id, round(CASE WHEN x IS NULL OR language = 'ru' THEN sentiment
        WHEN language = 'mixed' AND sentiment <> 0 THEN greatest(-1.0, least(1.0, (x + sentiment) / 2.0)) ELSE x END, 6) AS score,
      CASE WHEN x IS NULL OR language = 'ru' THEN 'lexical' WHEN language = 'mixed' AND sentiment <> 0 THEN 'hybrid' ELSE 'vader' END AS backend,
      CASE WHEN NOT (x IS NULL OR language = 'ru') THEN 'vaderSentiment' END AS model
    FROM (SELECT *, CASE WHEN raw_index % 5 <> 0 THEN (raw_index % 21 - 10) / 10.0 END AS x FROM asg)"""))
def sent_route(spark, d):
    external = F.when(F.col("raw_index") % 5 != 0, (F.col("raw_index") % 21 - 10) / F.lit(10.0))
    routed = sentiment.routed(F.col("sentiment"), F.col("language"), F.col("x"), "vaderSentiment")
    rows = assignments(spark, d).withColumn("x", external).select("review_id", routed.alias("r"))
    return rows.select("review_id", F.round("r.score", 6).alias("score"), "r.backend", "r.model")


SQL_CONCEPTS = "list_filter([" + ", ".join(
    "CASE WHEN " + " OR ".join("(" + " AND ".join(f"contains({{0}}, '{f}')" for f in p) + ")" for p in patterns) + f" THEN '{name}' END"
    for name, _, patterns in CONCEPTS
) + "], lambda c: c IS NOT NULL)"


@query("concept_detect", sql("nrm", f"SELECT review_id, array_to_string({SQL_CONCEPTS.format('lower(text_raw)')}, ',') AS concepts FROM nrm"))
def concept_detect(spark, d):
    found = concepts.detect(F.lower("text_raw"), CONCEPTS)
    return normalized(spark, d).select("review_id", F.array_join(found, ",").alias("concepts"))


@query("concept_enrich", sql("nrm", f"""
    SELECT review_id, CASE WHEN len(c) = 0 THEN text_raw ELSE text_raw || ' ' || array_to_string(list_transform(c,
      lambda x: 'concept_' || x || ' concept_' || x || ' concept_' || x), ' ') END AS enriched
    FROM (SELECT review_id, text_raw, {SQL_CONCEPTS.format('lower(text_raw)')} AS c FROM nrm)"""))
def concept_enrich(spark, d):
    rows = normalized(spark, d).withColumn("c", concepts.detect(F.lower("text_raw"), CONCEPTS))
    return rows.select("review_id", concepts.enrich(F.col("text_raw"), F.col("c")).alias("enriched"))


@query("case_confidence", sql("clu", """
    SELECT session_id, cluster_id, size, CASE WHEN weak THEN 'low' WHEN size >= 8 THEN 'high' WHEN size >= 4 THEN 'medium' ELSE 'low' END AS confidence,
      'low' AS when_degraded FROM clu"""))
def case_confidence(spark, d):
    size, weak = F.col("size"), F.col("weak")
    return clusters(spark, d).select(
        *themes.KEYS, "size", themes.confidence(size, F.lit(False), weak).alias("confidence"),
        themes.confidence(size, F.lit(True), weak).alias("when_degraded"),
    )


@query("case_degraded_reason", sql("clu", """
    SELECT session_id, cluster_id, CASE WHEN total < 30 THEN 'low_data_mode' WHEN sentiment_score < 0.1 THEN 'low_clustering_quality'
      WHEN weak THEN 'weak_signals_mode' END AS degraded_reason FROM clu"""))
def case_degraded_reason(spark, d):
    from pyspark.sql import Window

    total = F.sum("size").over(Window.partitionBy("session_id"))
    reason = themes.degraded_reason(F.col("total") < rules.LOW_DATA_ROWS, F.col("sentiment_score") < 0.1, F.col("weak"))
    return clusters(spark, d).withColumn("total", total).select(*themes.KEYS, reason.alias("degraded_reason"))


@query("case_summary_text", sql("clu", "SELECT session_id, cluster_id, summary FROM clu"))
def case_summary_text(spark, d):
    return clusters(spark, d).select(*themes.KEYS, "summary")


@query("case_status_map", sql("je", """
    SELECT id, code, CASE code WHEN 'INPUT_SCHEMA_INVALID' THEN 'FAILED_INPUT' WHEN 'INPUT_LIMIT_EXCEEDED' THEN 'FAILED_INPUT'
      WHEN 'PRIVACY_GATE_FAILED' THEN 'FAILED_PRIVACY' ELSE 'FAILED_RUNTIME' END AS state
    FROM (SELECT id, ['INPUT_SCHEMA_INVALID', 'INPUT_LIMIT_EXCEEDED', 'PRIVACY_GATE_FAILED', 'TIMEOUT'][k % 4 + 1] AS code FROM je)"""))
def case_status_map(spark, d):
    codes = F.array(*[F.lit(c) for c in ("INPUT_SCHEMA_INVALID", "INPUT_LIMIT_EXCEEDED", "PRIVACY_GATE_FAILED", "TIMEOUT")])
    rows = job_events(spark, d).select("id", F.element_at(codes, F.col("k") % 4 + 1).alias("code"))
    return rows.select("id", "code", values.failure_state(F.col("code")).alias("state"))


@query("clean_decision_text", sql("nrm", """
    SELECT review_id, CASE WHEN l = '' THEN 'Untitled cluster' ELSE left(l, 80) END AS label, left(text_raw, 400) AS summary,
      CASE WHEN lower(c) IN ('high', 'medium', 'low') THEN lower(c) ELSE 'medium' END AS confidence,
      CASE WHEN lower(b) IN ('true', 'yes', '1') THEN true WHEN lower(b) IN ('false', 'no', '0') THEN false ELSE true END AS keep
    FROM (SELECT review_id, text_raw, trim(text_raw, ' .') AS l, ['High', 'low', 'sure', 'MEDIUM'][CAST(raw_index % 4 AS INT) + 1] AS c,
      ['Yes', 'no', 'maybe', 'FALSE', '1'][CAST(raw_index % 5 AS INT) + 1] AS b FROM nrm)"""))
def clean_decision_text(spark, d):
    pick = lambda opts: F.element_at(F.array(*[F.lit(o) for o in opts]), (F.col("raw_index") % len(opts) + 1).cast("int"))
    return normalized(spark, d).select(
        "review_id", values.clean_label(F.col("text_raw")).alias("label"), values.clean_summary(F.col("text_raw")).alias("summary"),
        values.clean_confidence(pick([" High", "low ", "sure", "MEDIUM"])).alias("confidence"),
        values.loose_boolean(pick(["Yes", " no", "maybe", "FALSE", "1"]), True).alias("keep"),
    )


@query("json_from_text", """
    SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS k FROM events""")
def json_from_text(spark, d):
    props, form = F.col("props"), F.col("event_id") % 5
    raw = (
        F.when(form == 0, props).when(form == 1, F.concat(F.lit("Sure:\n```json\n"), props, F.lit("\n``` done")))
        .when(form == 2, F.concat(F.lit("The answer is "), props, F.lit(" as asked")))
        .when(form == 3, F.concat(F.lit("  "), props, F.lit(" "))).otherwise(F.concat(F.lit("["), F.lit("1]")))
    )
    rows = table(spark, d, "events").select("event_id", text.first_json_object(raw).alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "int").alias("k"))


@query("sim_from_distance", """
    SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - value / 10.0)) END AS similarity FROM events""")
def sim_from_distance(spark, d):
    distance = F.when(F.col("event_id") % 9 != 0, F.col("value") / 10.0)
    return table(spark, d, "events").select("event_id", values.similarity(distance).alias("similarity"))


@query("vec_l2_normalize", """
    WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings)
    SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / norm, 6) AS first, round(CAST(embedding[64] AS DOUBLE) / norm, 6) AS last,
      round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)) / norm)), 6) AS l1 FROM n""")
def vec_l2_normalize(spark, d):
    unit = table(spark, d, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("v"))
    l1 = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x))
    return unit.select(
        "vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"), F.round(l1, 6).alias("l1")
    )


SQL_INTENTS = {
    "compare": "compare|vs|versus|сравн", "trend": "trend|spike|growing|growth|динамик|всплеск|рост",
    "report": "report|summary|executive|отч[её]т|резюме", "priority": "highest|top|priority|urgent|critical|приоритет|главн|срочн",
}


def sql_intent(name: str, column: str = "question") -> str:
    return rf"regexp_matches({column}, '(?i)(^|[^\p{{L}}\p{{N}}_])({SQL_INTENTS[name]})($|[^\p{{L}}\p{{N}}_])')"


@query("intent_flags", sql("qs", "SELECT question_id, " + ", ".join(f"{sql_intent(n)} AS {n}" for n in SQL_INTENTS) + " FROM qs"))
def intent_flags(spark, d):
    from chorale.operators.search import intents

    return questions(spark, d).select("question_id", *[c.alias(n) for n, c in intents(F.col("question")).items()])
