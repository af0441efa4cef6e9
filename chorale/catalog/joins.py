"""Joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chorale.catalog.core import query
from chorale.catalog.gates import alerts
from chorale.catalog.text import SQL_FLAGS
from chorale.catalog.views import assignments, clusters, parsed, sql, table
from chorale.operators import decisions, lookups, ranking, themes
from chorale.operators.attach import fresh


@query("join_latest_job", """
    WITH j AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY ALL)
    SELECT c.c_custkey AS session_id, o.o_orderkey AS latest_job_id, o.o_orderstatus AS status, o.o_totalprice AS cost
    FROM customer c JOIN j ON c.c_custkey = j.o_custkey JOIN orders o ON o.o_orderkey = j.latest""")
def join_latest_job(spark, d):
    orders = table(spark, d, "orders")
    latest = orders.groupBy(F.col("o_custkey").alias("session_id")).agg(
        F.max(F.struct("o_orderdate", "o_orderkey")).getField("o_orderkey").alias("latest_job_id")
    )
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"))
    jobs = orders.select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("job_id"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("cost"),
    )
    return lookups.latest_jobs(customers.join(latest, "session_id"), jobs)


def parts(spark, d):
    """(reviews, assignments, scores) of all reviews: a text without a word of the lexicon has no score."""
    asg = assignments(spark, d)
    return (
        asg.select("session_id", "review_id", "source", "text"),
        asg.select("session_id", "review_id", "cluster_id"),
        asg.where("sentiment <> 0").select("session_id", "review_id", "sentiment"),
    )


@query("join_review_payload", sql("asg", """
    SELECT session_id, review_id, cluster_id, source, sentiment FROM asg"""))
def join_review_payload(spark, d):
    return lookups.review_payload(*parts(spark, d)).select("session_id", "review_id", "cluster_id", "source", "sentiment")


@query("join_update_analysis", sql("asg", """
    SELECT session_id, review_id, cluster_id, CASE WHEN sentiment <> 0 THEN sentiment END AS sentiment FROM asg"""))
def join_update_analysis(spark, d):
    return lookups.with_analysis(*parts(spark, d)).select("session_id", "review_id", "cluster_id", "sentiment")


@query("join_preview_cluster", sql("asg clu", """
    WITH r AS (SELECT session_id, cluster_id, row_number() OVER (PARTITION BY session_id ORDER BY priority_score DESC, size DESC, cluster_id) AS rank FROM clu),
    m AS (SELECT session_id, review_id, cluster_id FROM asg WHERE cluster_id IN (SELECT cluster_id FROM clu WHERE NOT weak AND clu.session_id = asg.session_id)
      UNION ALL SELECT session_id, review_id, 'theme_0' FROM asg WHERE source = 'web')
    SELECT a.session_id, a.review_id, b.cluster_id FROM asg a LEFT JOIN
      (SELECT session_id, review_id, arg_min(cluster_id, rank) AS cluster_id FROM m JOIN r USING (session_id, cluster_id) GROUP BY ALL) b
      USING (session_id, review_id)"""))
def join_preview_cluster(spark, d):
    asg = assignments(spark, d)
    window = Window.partitionBy("session_id").orderBy(*ranking.by_priority())
    found = clusters(spark, d, asg)
    ranked = found.withColumn("rank", F.row_number().over(window)).select(*themes.KEYS, "rank")
    # weak clusters list no reviews; web reviews are listed by a second theme
    strong = found.where(~F.col("weak")).select(*fresh(found, themes.KEYS))
    members = asg.select(*themes.KEYS, "review_id").join(strong, themes.KEYS, "left_semi").unionByName(
        asg.where("source = 'web'").select("session_id", F.lit("theme_0").alias("cluster_id"), "review_id")
    )
    return lookups.preview_cluster(asg.select("session_id", "review_id"), members, ranked)


def quoted_clusters(asg, limit=5):
    best = ranking.quotes(asg, limit)
    ids = F.array_sort(F.collect_list(F.struct("rank", "review_id")))
    return best.groupBy(*themes.KEYS).agg(F.transform(ids, lambda q: q["review_id"]).alias("top_quote_ids"))


SQL_QUOTES = """
    qt AS (SELECT session_id, cluster_id, review_id, text, raw_index, source, created_at, sentiment, row_number() OVER (PARTITION BY session_id, cluster_id
      ORDER BY abs(sentiment) DESC, length(text) DESC, raw_index) AS rank FROM asg QUALIFY rank <= 5)"""


@query("join_quote_text", sql("asg", f"""WITH {SQL_QUOTES}
    SELECT session_id, cluster_id, count(*) AS n, md5(array_to_string(list(text ORDER BY rank), '|')) AS texts
    FROM qt GROUP BY ALL"""))
def join_quote_text(spark, d):
    asg = assignments(spark, d)
    stored = asg.select("session_id", "review_id", "text")
    found = lookups.quote_texts(quoted_clusters(asg), stored)
    return found.select(*themes.KEYS, F.size("quotes").cast("bigint").alias("n"), F.md5(F.array_join("quotes", "|")).alias("texts"))


@query("join_alert_cluster", sql("alr clu", """
    SELECT a.session_id, a.alert_id, coalesce(c.label, a.cluster_id) AS label, coalesce(c.summary, '') AS summary, c.size, c.priority_score
    FROM alr a LEFT JOIN (SELECT * FROM clu WHERE NOT weak) c USING (session_id, cluster_id)"""))
def join_alert_cluster(spark, d):
    known = clusters(spark, d).where(~F.col("weak"))  # weak clusters have no theme row
    return lookups.alert_facts(alerts(spark, d), known).select("session_id", "alert_id", "label", "summary", "size", "priority_score")


@query("split_weak_semi_anti", sql("clu", """
    SELECT session_id, cluster_id, CASE WHEN weak THEN 'weak' ELSE 'top' END AS part, size FROM clu"""))
def split_weak_semi_anti(spark, d):
    found = clusters(spark, d)
    top, weak = themes.split_weak(found, found.where("weak").select(*themes.KEYS))
    part = lambda df, name: df.select(*themes.KEYS, F.lit(name).alias("part"), "size")
    return part(top, "top").unionByName(part(weak, "weak"))


@query("join_flag_decisions", sql("nrm", SQL_FLAGS + """,
    dcs AS (SELECT *, raw_index % 3 <> 0 AS reviewed, raw_index % 3 <> 0 AND raw_index % 2 = 0 AS drop_spam,
      raw_index % 3 = 1 AS drop_low FROM flg)
    SELECT review_id, reviewed, array_to_string(list_filter([CASE WHEN injection THEN 'injection_suspected' END,
      CASE WHEN spam AND NOT drop_spam THEN 'spam' END, CASE WHEN low AND NOT drop_low THEN 'low_information' END,
      CASE WHEN pii_hits > 0 THEN 'pii_found' END, CASE WHEN language = 'mixed' THEN 'mixed_language' END], lambda f: f IS NOT NULL), ',') AS flags,
      CAST((spam AND drop_spam) AS INT) + CAST((low AND drop_low) AS INT) AS removed_flags,
      CASE WHEN reviewed AND raw_index % 5 <> 0 THEN 'seen ' || review_id END AS note FROM dcs"""))
def join_flag_decisions(spark, d):
    rows = parsed(spark, d)
    n = F.col("raw_index")
    choice = rows.where(n % 3 != 0).select(
        "session_id", "review_id",
        F.when(n % 2 == 0, "no").otherwise("perhaps").alias("keep_spam"), F.lit("true").alias("keep_injection"),
        F.when(n % 3 == 1, " False ").otherwise("YES").alias("keep_low_information"),
        F.when(n % 5 != 0, F.concat(F.lit(" seen  "), "review_id")).alias("note"),
    )
    done = decisions.flag_decisions(rows, choice)
    return done.select("review_id", "reviewed", F.array_join("flags", ",").alias("flags"), "removed_flags", "note")


@query("join_taxonomy_updates", sql("clu", """
    SELECT session_id, cluster_id, CASE WHEN hit THEN 'New ' || cluster_id ELSE label END AS label, left(summary, 400) AS summary,
      CASE WHEN hit THEN 'medium' ELSE confidence END AS confidence, hit AS changed
    FROM (SELECT *, cluster_id IN ('theme_1', 'theme_4') AS hit FROM clu)"""))
def join_taxonomy_updates(spark, d):
    found = clusters(spark, d)
    updates = found.where(F.col("cluster_id").isin("theme_1", "theme_4")).select(
        *themes.KEYS, F.concat(F.lit(" New  "), "cluster_id", F.lit(" .")).alias("new_label"),
        F.lit("").alias("new_summary"), F.lit("certain").alias("new_confidence"),
    )
    return decisions.taxonomy_updates(found, updates).select(*themes.KEYS, "label", "summary", "confidence", "changed")


@query("join_alert_explanations", sql("alr", """
    SELECT session_id, alert_id, CASE WHEN NOT insufficient_history AND cluster_id <> 'theme_2' THEN 'Because of ' || cluster_id ELSE reason END AS reason,
      NOT insufficient_history AND cluster_id <> 'theme_2' AS changed FROM alr"""))
def join_alert_explanations(spark, d):
    found = alerts(spark, d)
    texts = found.select(
        "session_id", "alert_id",
        F.when(F.col("cluster_id") != "theme_2", F.concat(F.lit("Because  of "), "cluster_id")).otherwise(" ").alias("explanation"),
    )
    return decisions.alert_explanations(found, texts).select("session_id", "alert_id", "reason", "changed")


@query("join_split_marks", sql("clu", """
    SELECT session_id, cluster_id, CASE WHEN cluster_id = 'theme_5' THEN 'low' ELSE confidence END AS confidence,
      CASE WHEN cluster_id = 'theme_5' THEN left('llm_split_review: ' || left(summary, 400), 160) ELSE degraded_reason END AS degraded_reason FROM clu"""))
def join_split_marks(spark, d):
    found = clusters(spark, d)
    splits = found.where(F.col("cluster_id").isin("theme_5", "theme_6")).select(
        *themes.KEYS, F.when(F.col("cluster_id") == "theme_5", F.col("summary")).otherwise("").alias("split_reason")
    )
    return decisions.split_marks(found, splits).select(*themes.KEYS, "confidence", "degraded_reason")


def proposed_pairs(found):
    """Each cluster with the next one by size, and some pairs given twice or with themselves."""
    window = Window.partitionBy("session_id").orderBy(F.col("size").desc(), "cluster_id")
    numbered = found.select("session_id", "cluster_id", F.row_number().over(window).alias("ord"), F.lead("cluster_id").over(window).alias("next"))
    chain = numbered.select("session_id", "ord", F.col("cluster_id").alias("left_id"), F.coalesce("next", "cluster_id").alias("right_id"))
    again = numbered.where(F.col("next").isNotNull()).select(
        "session_id", (F.col("ord") + 100).alias("ord"), F.col("next").alias("left_id"), F.col("cluster_id").alias("right_id")
    )
    return chain.unionByName(again)


SQL_TOKENS_OF = "list_distinct(list_filter(regexp_extract_all(lower(label || ' ' || summary || ' ' || array_to_string(keywords, ' ') || ' ' || array_to_string(sources, ' ')), '[A-Za-zА-Яа-я0-9]+'), lambda t: length(t) > 2))"
SQL_JACCARD = "CAST(len(list_intersect({0}, {1})) AS DOUBLE) / greatest(1, len(list_distinct(list_concat({0}, {1}))))"
SQL_MERGES = f"""
    num AS (SELECT *, {SQL_TOKENS_OF} AS toks, row_number() OVER (PARTITION BY session_id ORDER BY size DESC, cluster_id) AS ord FROM clu),
    grd AS (SELECT l.session_id, l.ord,
        CASE WHEN (l.size, l.priority_score, l.cluster_id) >= (r.size, r.priority_score, r.cluster_id) THEN l.cluster_id ELSE r.cluster_id END AS primary_id,
        CASE WHEN (l.size, l.priority_score, l.cluster_id) >= (r.size, r.priority_score, r.cluster_id) THEN r.cluster_id ELSE l.cluster_id END AS secondary_id
      FROM num l JOIN num r ON l.session_id = r.session_id AND r.ord = l.ord + 1
      WHERE {SQL_JACCARD.format('l.toks', 'r.toks')} >= 0.1 AND abs(l.sentiment_score - r.sentiment_score) <= 0.6),
    fold AS (SELECT session_id, CAST(0 AS BIGINT) AS ord, CAST([] AS VARCHAR[]) AS used, NULL::VARCHAR AS primary_id, NULL::VARCHAR AS secondary_id
        FROM (SELECT DISTINCT session_id FROM grd)
      UNION ALL SELECT g.session_id, g.ord, CASE WHEN ok THEN list_concat(g.used, [g.primary_id, g.secondary_id]) ELSE g.used END,
        CASE WHEN ok THEN g.primary_id END, CASE WHEN ok THEN g.secondary_id END
      FROM (SELECT g.*, f.used, NOT list_has_any(f.used, [g.primary_id, g.secondary_id]) AS ok,
          row_number() OVER (PARTITION BY g.session_id ORDER BY g.ord) AS pick
        FROM fold f JOIN grd g ON f.session_id = g.session_id AND g.ord > f.ord) g WHERE pick = 1),
    mrg AS (SELECT session_id, ord, primary_id, secondary_id FROM fold WHERE primary_id IS NOT NULL)"""


def sql_merges(names: str, select: str) -> str:
    return sql(names, f"WITH {SQL_MERGES} {select}").replace("WITH fb AS", "WITH RECURSIVE fb AS", 1)


@query("join_merge_guard", sql_merges("clu", "SELECT session_id, primary_id, secondary_id FROM mrg"))
def join_merge_guard(spark, d):
    found = clusters(spark, d)
    kept = decisions.accepted_merges(decisions.guarded_pairs(proposed_pairs(found), found))
    return kept.select("session_id", "primary_id", "secondary_id")


@query("join_compare_pair", sql("clu", """
    SELECT a.session_id, a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, a.priority_score AS priority_score_a, b.priority_score AS priority_score_b,
      a.sentiment_score AS sentiment_score_a, b.sentiment_score AS sentiment_score_b, a.size AS size_a, b.size AS size_b
    FROM clu a JOIN clu b ON a.session_id = b.session_id AND a.cluster_id = 'theme_1' AND b.cluster_id = 'theme_2'"""))
def join_compare_pair(spark, d):
    found = clusters(spark, d)
    pairs = found.where(F.col("cluster_id") == "theme_1").select(
        "session_id", F.col("cluster_id").alias("cluster_a"), F.lit("theme_2").alias("cluster_b")
    )
    return lookups.compared(pairs, found).drop("label_a", "label_b", "trend_delta_a", "trend_delta_b")
