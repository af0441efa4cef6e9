"""Windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale.catalog.aggregates import SQL_EV
from chorale.catalog.core import query
from chorale.catalog.joins import SQL_JACCARD, SQL_QUOTES, SQL_TOKENS_OF
from chorale.catalog.text import SQL_FINAL_MASK, SQL_SQUEEZE
from chorale.catalog.views import SQL_TOKEN, assignments, clusters, events_weekly, parsed, questions, sql, table
from chorale.functions.text import tokens
from chorale.operators import decisions, ranking, search, themes, trends
from chorale.plans import prepare


@query("win_dedupe_first", sql("nrm", f"""
    WITH {SQL_FINAL_MASK.strip()},
    h AS (SELECT session_id, raw_index, review_id, sha256({SQL_SQUEEZE.format('lower(masked)')}) AS dedupe_hash FROM fin)
    SELECT session_id, review_id, dedupe_hash FROM h
    QUALIFY row_number() OVER (PARTITION BY session_id, dedupe_hash ORDER BY raw_index) = 1"""))
def win_dedupe_first(spark, d):
    return prepare.first_per_hash(parsed(spark, d)).select("session_id", "review_id", "dedupe_hash")


@query("win_prior_weeks", sql("ev", f"""WITH {SQL_EV},
    p AS (SELECT key, week_key, n, count(n) OVER b AS c, sum(n) OVER b AS s, sum(n*n) OVER b AS q FROM w
      WINDOW b AS (PARTITION BY key ORDER BY week_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT key, week_key, n, CAST(s AS DOUBLE) / nullif(c, 0) AS prior_mean,
      sqrt(CAST(c * q - s * s AS DOUBLE)) / nullif(c, 0) AS prior_std FROM p"""))
def win_prior_weeks(spark, d):
    return trends.prior_week_stats(trends.weekly_counts(events_weekly(spark, d), ["key"], "moment"), ["key"])


@query("win_cluster_ordinal", sql("clu", """
    SELECT session_id, cluster_key, CAST(o AS INT) AS ordinal, regexp_replace(lower(label), '[^a-zа-я0-9]+', '_', 'g') || '_' || CAST(o AS VARCHAR) AS cluster_id
    FROM (SELECT session_id, cluster_id AS cluster_key, label, row_number() OVER (PARTITION BY session_id ORDER BY size DESC, cluster_id) AS o FROM clu)"""))
def win_cluster_ordinal(spark, d):
    keyed = clusters(spark, d).withColumnRenamed("cluster_id", "cluster_key")
    return ranking.cluster_ordinals(keyed).select("session_id", "cluster_key", "ordinal", "cluster_id")


@query("topk_priority", sql("clu", """
    SELECT session_id, cluster_id, priority_score, CAST(row_number() OVER (PARTITION BY session_id ORDER BY priority_score DESC, size DESC, cluster_id) AS INT) AS rank
    FROM clu QUALIFY rank <= 3"""))
def topk_priority(spark, d):
    return ranking.top_clusters(clusters(spark, d), 3).select(*themes.KEYS, "priority_score", "rank")


@query("topk_quotes", sql("asg", f"WITH {SQL_QUOTES} SELECT session_id, cluster_id, review_id, CAST(rank AS INT) AS rank FROM qt WHERE rank <= 3"))
def topk_quotes(spark, d):
    return ranking.quotes(assignments(spark, d), 3).select(*themes.KEYS, "review_id", "rank")


@query("topk_quotes_recent", sql("asg", """
    SELECT session_id, cluster_id, review_id, CAST(row_number() OVER (PARTITION BY session_id, cluster_id
      ORDER BY abs(sentiment) DESC, created_at DESC, review_id) AS INT) AS rank FROM asg QUALIFY rank <= 3"""))
def topk_quotes_recent(spark, d):
    return ranking.recent_quotes(assignments(spark, d), 3).select(*themes.KEYS, "review_id", "rank")


@query("topk_samples", sql("asg", """
    SELECT session_id, cluster_id, review_id, CAST(row_number() OVER (PARTITION BY session_id, cluster_id ORDER BY raw_index) AS INT) AS rank
    FROM asg QUALIFY rank <= 5"""))
def topk_samples(spark, d):
    return ranking.samples(assignments(spark, d), 5).select(*themes.KEYS, "review_id", "rank")


@query("topk_recent_turns", """
    WITH l AS (SELECT conv_id AS session_id, turn AS id, role, text AS content FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6)
    SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY id) AS INT) AS position FROM l""")
def topk_recent_turns(spark, d):
    turns = table(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content")
    )
    return ranking.recent_turns(turns, 6)


@query("topk_next_job", """
    SELECT o_orderkey AS job_id, o_custkey AS session_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1""")
def topk_next_job(spark, d):
    jobs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("COMPLETED").alias("status"),
    )
    return ranking.next_job(jobs).select("job_id", "session_id")


SQL_DOC = "concat_ws(' ', nullif(label, ''), nullif(summary, ''), nullif(array_to_string(keywords, ' '), ''), nullif(array_to_string(sources, ' '), ''))"


@query("set_union_corpus", sql("asg clu", f"""
    SELECT session_id, 'cluster' AS kind, cluster_id AS item_id, {SQL_DOC} AS text FROM clu
    UNION ALL SELECT session_id, 'review', review_id, text FROM asg"""))
def set_union_corpus(spark, d):
    asg = assignments(spark, d)
    return search.corpus(clusters(spark, d, asg), asg)


@query("set_token_overlap", sql("clu qs", f"""
    WITH q AS (SELECT question_id, session_id, list_distinct(regexp_extract_all(lower(question), '{SQL_TOKEN}')) AS t FROM qs),
    c AS (SELECT session_id, cluster_id, list_distinct(regexp_extract_all(lower(label || ' ' || summary || ' ' || array_to_string(keywords, ' ')), '{SQL_TOKEN}')) AS t FROM clu)
    SELECT question_id, cluster_id, least(1.0, CAST(len(list_intersect(q.t, c.t)) AS DOUBLE) / greatest(1, least(len(q.t), 5))) AS overlap
    FROM q JOIN c USING (session_id)"""))
def set_token_overlap(spark, d):
    asked = questions(spark, d).select("question_id", "session_id", tokens(F.col("question")).alias("q"))
    found = clusters(spark, d).select("session_id", "cluster_id", search.hit_tokens().alias("c"))
    joined = asked.join(found, "session_id")
    return joined.select("question_id", "cluster_id", search.keyword_overlap(F.col("q"), F.col("c")).alias("overlap"))


@query("set_token_jaccard", sql("clu", f"""
    WITH t AS (SELECT session_id, cluster_id, {SQL_TOKENS_OF} AS t FROM clu)
    SELECT a.session_id, b.cluster_id, {SQL_JACCARD.format('a.t', 'b.t')} AS overlap FROM t a JOIN t b ON a.session_id = b.session_id AND a.cluster_id = 'theme_1'"""))
def set_token_jaccard(spark, d):
    own = decisions.cluster_tokens(F.col("label"), F.col("summary"), F.col("keywords"), F.col("sources"))
    found = clusters(spark, d).select("session_id", "cluster_id", own.alias("t"))
    first = found.where(F.col("cluster_id") == "theme_1").select("session_id", F.col("t").alias("t1"))
    return found.join(first, "session_id").select("session_id", "cluster_id", decisions.jaccard(F.col("t1"), F.col("t")).alias("overlap"))


@query("set_ordered_union", sql("clu", """
    SELECT session_id, cluster_id, array_to_string(list_distinct_ordered[1:5], ',') AS merged, array_to_string(list_sort(list_distinct(list_concat(keywords, sources))), ',') AS sorted
    FROM (SELECT *, list_filter(k, lambda x, i: list_position(k, x) = i) AS list_distinct_ordered FROM (SELECT *, list_concat(keywords, sources) AS k FROM clu))"""))
def set_ordered_union(spark, d):
    both = F.concat("keywords", "sources")
    return clusters(spark, d).select(
        *themes.KEYS, F.array_join(F.slice(F.array_distinct(both), 1, 5), ",").alias("merged"),
        F.array_join(F.array_sort(F.array_union("keywords", "sources")), ",").alias("sorted"),
    )


@query("set_best_hit_union", sql("clu qs", """
    WITH a AS (SELECT question_id, q.session_id, cluster_id, priority_score, round(priority_score / 2, 4) AS score FROM qs q JOIN clu USING (session_id)
      UNION ALL SELECT question_id, q.session_id, cluster_id, priority_score, CAST(topic AS DOUBLE) / 10 FROM qs q JOIN clu USING (session_id) WHERE weak),
    b AS (SELECT question_id, session_id, cluster_id, priority_score, max(score) AS score FROM a GROUP BY ALL)
    SELECT question_id, cluster_id, score, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, priority_score DESC, cluster_id) AS INT) AS rank FROM b QUALIFY rank <= 3"""))
def set_best_hit_union(spark, d):
    pairs = questions(spark, d).join(clusters(spark, d), "session_id")
    hit = lambda df, score: df.select("question_id", "session_id", "cluster_id", "priority_score", score.alias("score"), F.lit(0).alias("rank"))
    both = hit(pairs, F.round(F.col("priority_score") / 2, 4)).unionByName(hit(pairs.where("weak"), F.col("topic") / F.lit(10.0)))
    return search.best_hits(both, 3).select("question_id", "cluster_id", "score", "rank")
