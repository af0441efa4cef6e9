"""Retrieval, batch answers, reports and acceptance checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale import rules, schemas
from chorale.catalog.aggregates import SQL_COUNTERS, SQL_SUMMARY
from chorale.catalog.core import query
from chorale.catalog.gates import alerts
from chorale.catalog.joins import SQL_QUOTES, quoted_clusters
from chorale.catalog.text import sql_intent
from chorale.catalog.views import (
    RUN_TS, SQL_FIXED, SQL_TOKEN, assignments, clusters, job_events, parsed, questions, sql, sql_in,
)
from chorale.catalog.windows import SQL_DOC
from chorale.operators import lookups, ranking, search, themes, vectorizer
from chorale.plans import answers, evals, prepare, report
from chorale.session import settled


def sections(found):
    """A summary section per session."""
    texts = found.groupBy("session_id").agg(F.max_by("summary", F.struct("priority_score", "cluster_id")).alias("text"))
    return texts.select("session_id", F.lit("executive_summary").alias("section_name"), "text")


_built: dict[tuple[str, str], dict] = {}


def index(spark, d):
    """Search index over the themes and all their reviews: built and stored once an application, as questions come later."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _built:
        asg = settled(assignments(spark, d), "reviews")
        found = settled(clusters(spark, d, asg), "clusters")
        _built[key] = {**search.build_index(found, asg), "reviews": asg, "sections": settled(sections(found), "sections")}
    return _built[key]


def _sql_block(name: str, source: str, max_df: str) -> str:
    """Vocabulary ``v{name}`` and unit rows ``w{name}`` of a block, from its counts (session_id, doc_id, term, tf)."""
    return f"""t{name} AS ({source.replace('{0}', 'crp')}),
    v{name} AS (SELECT session_id, term, ln((min(n) + 1) / CAST(count(*) + 1 AS DOUBLE)) + 1.0 AS idf FROM t{name} JOIN cnt USING (session_id) GROUP BY session_id, term
      HAVING {max_df} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sum(tf) DESC, term) <= 4000),
    w{name} AS (SELECT session_id, doc_id, '{name}' AS b, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY session_id, doc_id)) AS w FROM t{name} JOIN v{name} USING (session_id, term))"""


_SQL_WORDS = rf"""SELECT session_id, doc_id, unnest(list_concat(w, list_transform(list_zip(w[1:len(w)-1], w[2:len(w)]), lambda p: p[1] || ' ' || p[2]))) AS term, 1 AS one
      FROM (SELECT *, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: w NOT IN {sql_in(rules.SEARCH_STOP_WORDS)}) AS w FROM {{0}})"""
_SQL_WORDS = f"SELECT session_id, doc_id, term, count(*) AS tf FROM ({_SQL_WORDS}) GROUP BY ALL"
_SQL_CHARS = r"""SELECT session_id, doc_id, substr(p, i, n) AS term, sum(c) AS tf FROM
      (SELECT session_id, doc_id, p, c, n, unnest(range(1, CAST(length(p) - n + 2 AS BIGINT))) AS i FROM
        (SELECT session_id, doc_id, p, count(*) AS c FROM (SELECT session_id, doc_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) || ' ' AS p FROM {0}) GROUP BY ALL),
        (SELECT unnest([3, 4, 5]) AS n) WHERE n <= length(p)) GROUP BY ALL"""
SQL_INDEX = f"""
    crp AS (SELECT session_id, 'c' || cluster_id AS doc_id, {SQL_DOC} AS text FROM clu UNION ALL SELECT session_id, 'r' || review_id, text FROM asg),
    cnt AS (SELECT session_id, count(*) AS n FROM crp GROUP BY ALL),
    {_sql_block('word', _SQL_WORDS, 'count(*) <= 0.88 * min(n) OR min(n) = 1')},
    {_sql_block('char', _SQL_CHARS, 'true')},
    vct AS MATERIALIZED (SELECT session_id, doc_id, b, term, w / sqrt(sum(w * w) OVER (PARTITION BY session_id, doc_id)) AS w FROM (SELECT * FROM wword UNION ALL SELECT * FROM wchar)),
    mem AS (SELECT session_id, 'r' || review_id AS doc_id, cluster_id FROM asg),
    ask AS (SELECT question_id, session_id, question, topic FROM qs)"""
SQL_SEARCH = """
    que{n} AS (SELECT session_id, question_id AS doc_id, question AS text FROM {ask}),
    qtw{n} AS ({words}), qtc{n} AS ({chars}),
    qwt{n} AS (SELECT session_id, doc_id, 'word' AS b, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY session_id, doc_id)) AS w FROM qtw{n} JOIN vword USING (session_id, term)
      UNION ALL SELECT session_id, doc_id, 'char', term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY session_id, doc_id)) FROM qtc{n} JOIN vchar USING (session_id, term)),
    qvc{n} AS (SELECT session_id, doc_id AS question_id, b, term, w / sqrt(sum(w * w) OVER (PARTITION BY session_id, doc_id)) AS w FROM qwt{n}),
    cos{n} AS MATERIALIZED (SELECT session_id, question_id, v.doc_id, sum(q.w * v.w) AS s FROM qvc{n} q JOIN vct v USING (session_id, b, term) GROUP BY ALL),
    csm{n} AS (SELECT question_id, doc_id[2:] AS cluster_id, greatest(0.0, s) AS s FROM cos{n} WHERE doc_id[1] = 'c'),
    rsm{n} AS (SELECT question_id, cluster_id, greatest(0.0, max(s)) AS s FROM cos{n} JOIN mem USING (session_id, doc_id) GROUP BY ALL),
    lex{n} AS (SELECT question_id, c.session_id, c.cluster_id, c.label, c.summary, c.priority_score, least(1.0, CAST(len(list_intersect(qt, ct)) AS DOUBLE) / greatest(1, least(len(qt), 5))) AS l
      FROM (SELECT question_id, session_id, list_distinct(regexp_extract_all(lower(question), '{t}')) AS qt FROM {ask}) q
      JOIN (SELECT *, list_distinct(regexp_extract_all(lower(label || ' ' || summary || ' ' || array_to_string(keywords, ' ')), '{t}')) AS ct FROM clu) c USING (session_id)),
    fus{n} AS (SELECT l.*, coalesce(c.s, 0.0) AS cs, coalesce(r.s, 0.0) AS rs FROM lex{n} l LEFT JOIN csm{n} c USING (question_id, cluster_id) LEFT JOIN rsm{n} r USING (question_id, cluster_id)),
    hit{n} AS (SELECT question_id, session_id, cluster_id, label, summary, priority_score, round(0.55 * cs + 0.25 * rs + 0.20 * l, 4) AS score,
      CASE WHEN (cs > 0 OR rs > 0) AND l > 0 THEN 'hybrid' WHEN cs > 0 OR rs > 0 THEN 'semantic' ELSE 'keyword' END AS match_reason,
      row_number() OVER (PARTITION BY question_id ORDER BY round(0.55 * cs + 0.25 * rs + 0.20 * l, 4) DESC, priority_score DESC, cluster_id) AS rank
      FROM fus{n} WHERE 0.55 * cs + 0.25 * rs + 0.20 * l > 0 QUALIFY rank <= {k})"""


def sql_search(n: str, ask: str, k: int) -> str:
    asked = SQL_SEARCH.replace("{words}", _SQL_WORDS.replace("{0}", "que{n}")).replace("{chars}", _SQL_CHARS.replace("{0}", "que{n}"))
    return asked.replace("{n}", n).replace("{ask}", ask).replace("{t}", SQL_TOKEN).replace("{k}", str(k))


@query("ret_cluster_docs", sql("clu", f"SELECT session_id, cluster_id, {SQL_DOC} AS document FROM clu"))
def ret_cluster_docs(spark, d):
    document = search.cluster_document(F.col("label"), F.col("summary"), F.col("keywords"), F.col("sources"))
    return clusters(spark, d).select(*themes.KEYS, document.alias("document"))


@query("ret_query_vector", sql("asg clu qs", f"""WITH {SQL_INDEX}, {sql_search('', 'ask', 5)}
    SELECT question_id, count(*) AS places, round(max(w), 6) AS top_weight, round(sum(w), 6) AS total FROM qvc GROUP BY ALL"""))
def ret_query_vector(spark, d):
    stored = index(spark, d)
    asked = questions(spark, d).select("session_id", F.col("question_id").alias("doc_id"), F.col("question").alias("text"))
    rows = vectorizer.same_space(vectorizer.Vectorizer(stored["terms"], stored["spaces"]).transform(asked), stored["cluster_rows"])
    half = (F.size("vector") / 2).cast("int")
    weights = F.slice("vector", half + 1, half)
    return rows.select(
        F.col("doc_id").alias("question_id"), half.cast("bigint").alias("places"), F.round(F.array_max(weights), 6).alias("top_weight"),
        F.round(F.aggregate(weights, F.lit(0.0), lambda s, x: s + x), 6).alias("total"),
    )


@query("ret_search_hybrid", sql("asg clu qs", f"WITH {SQL_INDEX}, {sql_search('', 'ask', 5)} SELECT question_id, cluster_id, score, match_reason, CAST(rank AS INT) AS rank FROM hit"))
def ret_search_hybrid(spark, d):
    rows = questions(spark, d).withColumnRenamed("question", "query")
    return search.search(rows, index(spark, d), 5).select("question_id", "cluster_id", "score", "match_reason", "rank")


@query("ret_trend", sql("clu", """
    SELECT session_id, cluster_id, trend_delta, size AS recent_count, CASE WHEN trend_delta > 0.5 THEN 'spiking' ELSE 'stable' END AS note FROM clu"""))
def ret_trend(spark, d):
    return search.trend_view(clusters(spark, d))


@query("ret_report_section", sql("clu qs", """
    WITH s AS (SELECT session_id, arg_max(summary, (priority_score, cluster_id)) AS t FROM clu GROUP BY ALL)
    SELECT question_id, n AS section_name, CASE WHEN n = 'executive_summary' THEN coalesce(t, '') ELSE '' END AS text
    FROM (SELECT question_id, session_id, CASE WHEN topic % 2 = 0 THEN 'executive_summary' ELSE 'alerts' END AS n FROM qs) LEFT JOIN s USING (session_id)"""))
def ret_report_section(spark, d):
    name = F.when(F.col("topic") % 2 == 0, "executive_summary").otherwise("alerts")
    wanted = questions(spark, d).select("question_id", "session_id", name.alias("section_name"))
    return search.report_section(wanted, sections(clusters(spark, d))).select("question_id", "section_name", "text")


@query("ret_evidence", sql("asg clu qs", f"""WITH {SQL_QUOTES.strip()}, {SQL_INDEX.strip()}, {sql_search('', 'ask', 3)},
    h AS (SELECT question_id, array_to_string(list(cluster_id ORDER BY rank), ',') AS hits, sum(greatest(1, length(summary) // 4)) AS ht FROM hit GROUP BY ALL),
    q AS (SELECT question_id, array_to_string(list(review_id ORDER BY hit.rank, qt.rank), ',') AS quotes, sum(greatest(1, length(text) // 4)) AS qtk
      FROM hit JOIN qt ON hit.rank <= 2 AND qt.rank <= 2 AND qt.session_id = hit.session_id AND qt.cluster_id = hit.cluster_id GROUP BY ALL),
    t AS (SELECT question_id, array_to_string(list(hit.cluster_id || ' ' || CASE WHEN trend_delta > 0.5 THEN 'spiking' ELSE 'stable' END ORDER BY rank), ',') AS trends
      FROM hit JOIN clu USING (session_id, cluster_id) WHERE rank <= 2 GROUP BY ALL)
    SELECT question_id, hits, quotes, trends, CAST(ht + coalesce(qtk, 0) AS BIGINT) AS tokens FROM h LEFT JOIN q USING (question_id) LEFT JOIN t USING (question_id)"""))
def ret_evidence(spark, d):
    ix = index(spark, d)
    hits = search.search(questions(spark, d).withColumnRenamed("question", "query"), ix, 3)
    quotes = ranking.quotes(ix["reviews"], 2).select("session_id", "cluster_id", "rank", "review_id", "text", "source", "created_at")
    found = search.evidence(hits, quotes, ix["clusters"], F.lit(True))
    names = lambda c, f: F.array_join(F.transform(c, f), ",")
    return found.select(
        "question_id", names("cluster_hits", lambda h: h["cluster_id"]).alias("hits"), names("quotes", lambda q: q["review_id"]).alias("quotes"),
        names("trends", lambda t: F.concat_ws(" ", t["cluster_id"], t["note"])).alias("trends"), F.col("context_tokens_estimate").cast("bigint").alias("tokens"),
    )


SQL_ROUTE = f"""{SQL_INDEX}, {sql_search('', 'ask', 5)},
    flg AS (SELECT *, {", ".join(f"{sql_intent(n)} AS f_{n}" for n in rules.INTENTS)} FROM ask),
    pri AS (SELECT session_id, cluster_id, label, summary, priority_score, row_number() OVER (PARTITION BY session_id ORDER BY priority_score DESC, size DESC, cluster_id) AS rank FROM clu QUALIFY rank <= 5),
    rte AS (SELECT question_id, f.session_id, cluster_id, p.label, p.rank, p.priority_score AS score, 'priority' AS match_reason FROM flg f JOIN pri p USING (session_id) WHERE f_priority
      UNION ALL SELECT question_id, h.session_id, cluster_id, label, rank, score, match_reason FROM hit h JOIN flg USING (question_id) WHERE NOT f_priority)"""


@query("qa_route", sql("asg clu qs", f"WITH {SQL_ROUTE} SELECT question_id, cluster_id, CAST(rank AS INT) AS rank, score, match_reason FROM rte"))
def qa_route(spark, d):
    return answers.routed_hits(questions(spark, d), index(spark, d)).select("question_id", "cluster_id", "rank", "score", "match_reason")


SQL_SIGNED = "(CASE WHEN {0} >= 0 THEN '+' ELSE '' END || " + SQL_FIXED.format("{0}", 2) + ")"
SQL_ANSWER = f"""{SQL_QUOTES.strip()}, {SQL_ROUTE.strip()},
    ev2 AS (SELECT f.question_id, f.session_id, CASE WHEN f_priority THEN r.label ELSE f.question END AS question
      FROM flg f JOIN rte r ON r.question_id = f.question_id AND r.rank = 1), {sql_search('2', 'ev2', 3)},
    cmp AS (SELECT f.question_id, a.cluster_id AS ca, b.cluster_id AS cb, a.priority_score AS pa, b.priority_score AS pb, a.sentiment_score AS sa, b.sentiment_score AS sb
      FROM flg f JOIN rte x ON x.question_id = f.question_id AND x.rank = 1 JOIN rte y ON y.question_id = f.question_id AND y.rank = 2
      JOIN clu a ON a.session_id = f.session_id AND a.cluster_id = x.cluster_id JOIN clu b ON b.session_id = f.session_id AND b.cluster_id = y.cluster_id WHERE f_compare),
    trn AS (SELECT question_id, list('`' || hit2.cluster_id || '` is ' || CASE WHEN trend_delta > 0.5 THEN 'spiking' ELSE 'stable' END || ' (' || {SQL_SIGNED.format('trend_delta')} || ').' ORDER BY rank) AS notes
      FROM hit2 JOIN clu USING (session_id, cluster_id) JOIN (SELECT question_id FROM flg WHERE f_trend UNION SELECT question_id FROM cmp) USING (question_id) WHERE rank <= 2 GROUP BY ALL),
    quo AS (SELECT question_id, (list('`' || qt.cluster_id || '`: “' || text || '”' ORDER BY hit2.rank, qt.rank))[1:3] AS quotes
      FROM hit2 JOIN qt ON hit2.rank <= 2 AND qt.rank <= 2 AND qt.session_id = hit2.session_id AND qt.cluster_id = hit2.cluster_id GROUP BY ALL),
    sec AS (SELECT session_id, arg_max(summary, (priority_score, cluster_id)) AS t FROM clu GROUP BY ALL),
    ids AS (SELECT question_id, array_to_string(list('`' || cluster_id || '`' ORDER BY rank), ', ') AS ids FROM hit2 GROUP BY ALL)"""


@query("qa_compose", sql("asg clu qs", f"""WITH {SQL_ANSWER}
    SELECT f.question_id, concat_ws(chr(10) || chr(10), 'The strongest grounded match for this question is `' || h.cluster_id || '` (' || h.label || '). ' || h.summary,
      'Comparison: `' || ca || '` has priority ' || {SQL_FIXED.format('pa', 2)} || ' and sentiment ' || {SQL_FIXED.format('sa', 2)} || ', while `' || cb || '` has priority '
        || {SQL_FIXED.format('pb', 2)} || ' and sentiment ' || {SQL_FIXED.format('sb', 2)} || '.',
      'Trend view: ' || array_to_string(notes, ' '), CASE WHEN f_report THEN 'Report context: ' || t END, 'Evidence: ' || array_to_string(quotes, ' | '), 'Referenced clusters: ' || ids) AS answer
    FROM flg f JOIN hit2 h ON h.question_id = f.question_id AND h.rank = 1 JOIN ids ON ids.question_id = f.question_id LEFT JOIN cmp ON cmp.question_id = f.question_id
    LEFT JOIN trn ON trn.question_id = f.question_id LEFT JOIN quo ON quo.question_id = f.question_id LEFT JOIN sec ON sec.session_id = f.session_id"""))
def qa_compose(spark, d):
    return answers.answer(questions(spark, d), index(spark, d)).select("question_id", "answer")


@query("qa_tool_trace", sql("asg clu qs", f"""WITH {SQL_ANSWER},
    n AS (SELECT question_id, count(*) AS c FROM rte GROUP BY ALL), m AS (SELECT question_id, least(2, count(*)) AS c FROM hit2 GROUP BY ALL)
    SELECT f.question_id, CASE WHEN f_priority THEN 'Priority intent detected. Selected ' || CAST(n.c AS VARCHAR) || ' clusters by priority score.' ELSE 'Found ' || CAST(n.c AS VARCHAR) || ' relevant clusters.' END AS first_summary,
      CASE WHEN f_priority THEN 'top_clusters' ELSE 'search_clusters' END || CASE WHEN ca IS NOT NULL THEN ',compare_clusters' ELSE '' END
        || repeat(',get_quotes', m.c) || repeat(',get_trend', coalesce(len(notes), 0)) || CASE WHEN f_report THEN ',get_report_section' ELSE '' END AS tools
    FROM flg f JOIN n ON n.question_id = f.question_id JOIN m ON m.question_id = f.question_id LEFT JOIN cmp ON cmp.question_id = f.question_id LEFT JOIN trn ON trn.question_id = f.question_id"""))
def qa_tool_trace(spark, d):
    found = answers.answer(questions(spark, d), index(spark, d))
    return found.select(
        "question_id", F.col("tool_trace")[0]["output_summary"].alias("first_summary"),
        F.array_join(F.transform("tool_trace", lambda t: t["tool"]), ",").alias("tools"),
    )


def tool_calls(spark, d):
    """Four calls per question: three in one step, one more in the next; some unusable."""
    topic, cluster = F.col("topic"), F.concat(F.lit("theme_"), F.col("topic").cast("string"))
    call = lambda step, n, tool, **args: F.struct(
        F.lit(step).alias("step"), F.lit(n).alias("ord"), tool.alias("tool"),
        F.to_json(F.struct(*[v.alias(k) for k, v in args.items()])).alias("arguments"),
    )
    tool = F.element_at(F.array(*[F.lit(t) for t in ("top_clusters", "get_trend", "delete_all", "get_quotes", " get_report_section ")]), topic % 5 + 1)
    calls = F.array(
        call(0, 1, tool, top_k=topic * 3, cluster_id=cluster, limit=topic),
        call(0, 2, F.lit("compare_clusters"), cluster_a=F.lit("theme_1"), cluster_b=cluster),
        call(0, 3, F.lit("get_trend"), cluster_id=F.lit("theme_0")),
        call(1, 1, F.lit("search_clusters"), query=F.col("question"), top_k=topic - 2),
    )
    rows = questions(spark, d).select("question_id", "session_id", "topic", F.explode(calls).alias("c"))
    # Topic 7 sends no usable arguments at all.
    return rows.select("question_id", "session_id", "c.step", "c.ord", "c.tool", F.when(F.col("topic") == 7, "[1]").otherwise(F.col("c.arguments")).alias("arguments"))


@query("qa_tool_batch", sql("asg clu qs", f"""WITH {SQL_INDEX}, {sql_search('', 'ask', 10)},
    cal AS (SELECT *, ['top_clusters', 'get_trend', 'delete_all', 'get_quotes', 'get_report_section'][topic % 5 + 1] AS t1, 'theme_' || CAST(topic AS VARCHAR) AS cl FROM qs),
    pic AS (SELECT question_id, session_id, topic, cl, 0 AS step, 1 AS call, t1 AS tool FROM cal WHERE topic <> 7 AND t1 <> 'delete_all'
      UNION ALL SELECT question_id, session_id, topic, cl, 0, CASE WHEN t1 = 'delete_all' THEN 1 ELSE 2 END, 'compare_clusters' FROM cal WHERE topic <> 7
      UNION ALL SELECT question_id, session_id, topic, 'theme_0', 0, 2, 'get_trend' FROM cal WHERE topic <> 7 AND t1 = 'delete_all'
      UNION ALL SELECT question_id, session_id, topic, cl, 1, 1, 'search_clusters' FROM cal WHERE topic <> 7
      UNION ALL SELECT question_id, session_id, topic, cl, 0, 1, CASE WHEN {sql_intent('priority')} THEN 'top_clusters' ELSE 'search_clusters' END FROM cal WHERE topic = 7),
    nh AS (SELECT question_id, count(*) AS n FROM hit GROUP BY ALL), nc AS (SELECT session_id, least(10, count(*)) AS n FROM clu GROUP BY ALL)
    SELECT p.question_id, CAST(p.step AS INT) AS step, CAST(p.call AS INT) AS call, p.tool, CASE p.tool
      WHEN 'top_clusters' THEN 'Selected ' || CAST(least(nc.n, CASE WHEN topic = 7 THEN 3 ELSE greatest(1, least(10, topic * 3)) END) AS VARCHAR) || ' highest-priority clusters.'
      WHEN 'search_clusters' THEN 'Found ' || CAST(least(coalesce(nh.n, 0), CASE WHEN topic = 7 THEN 3 ELSE greatest(1, topic - 2) END) AS VARCHAR) || ' cluster hits for the query.'
      WHEN 'get_quotes' THEN 'Loaded ' || CAST(least(coalesce(c.size, 0), greatest(1, least(5, topic))) AS VARCHAR) || ' supporting quotes for ' || cl || '.'
      WHEN 'get_trend' THEN coalesce('Trend for ' || cl || ': ' || CASE WHEN c.trend_delta > 0.5 THEN 'spiking' ELSE 'stable' END || ' (' || {SQL_SIGNED.format('c.trend_delta')} || ').',
        'Tool failed with NO_EVIDENCE_AVAILABLE: No trend data for cluster ' || cl || '.')
      WHEN 'compare_clusters' THEN CASE WHEN c.cluster_id IS NULL OR o.cluster_id IS NULL THEN 'Tool failed with NO_EVIDENCE_AVAILABLE: One of the clusters requested for comparison was not found.'
        ELSE 'Compared theme_1 against ' || cl || '.' END
      ELSE 'Loaded report section executive_summary.' END AS summary
    FROM pic p LEFT JOIN clu c ON c.session_id = p.session_id AND c.cluster_id = p.cl LEFT JOIN clu o ON o.session_id = p.session_id AND o.cluster_id = 'theme_1'
    LEFT JOIN nh ON nh.question_id = p.question_id LEFT JOIN nc ON nc.session_id = p.session_id"""))
def qa_tool_batch(spark, d):
    calls = answers.normalized_calls(tool_calls(spark, d), questions(spark, d))
    return answers.run_calls(calls, index(spark, d)).select("question_id", "step", "call", "tool", "summary")


@query("qa_prompt_payload", sql("asg clu", """
    WITH s AS (SELECT session_id, cluster_id, list(review_id ORDER BY raw_index)[1:5] AS ids FROM asg GROUP BY ALL)
    SELECT session_id, cluster_id, '{"cluster_id":"' || cluster_id || '","local_label":"' || label || '","keywords":["' || array_to_string(keywords, '","') || '"],"size":' || CAST(size AS VARCHAR)
      || ',"sample_reviews":["' || array_to_string(ids, '","') || '"]}' AS payload FROM clu JOIN s USING (session_id, cluster_id)"""))
def qa_prompt_payload(spark, d):
    asg = assignments(spark, d)
    kept = ranking.samples(asg, 5).groupBy(*themes.KEYS).agg(F.array_sort(F.collect_list(F.struct("rank", "review_id"))).alias("s"))
    rows = clusters(spark, d, asg).join(kept, themes.KEYS)
    fields = ["cluster_id", F.col("label").alias("local_label"), "keywords", "size", F.col("s.review_id").alias("sample_reviews")]
    return rows.select(*themes.KEYS, F.to_json(F.struct(*fields)).alias("payload"))


# ------------------------------------------------------------------------------------- reports

SQL_EXEC = """
    bst AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY priority_score DESC, size DESC, cluster_id) AS rank FROM clu QUALIFY rank <= 3),
    exe AS (SELECT session_id, 'The batch is dominated by ' || array_to_string(list(label || ' (' || CAST(size AS VARCHAR) || ' reviews, priority ' || """ + SQL_FIXED.format("priority_score", 2) + """ || ')' ORDER BY rank), '; ')
      || '. Detected anomaly spikes: ' || CAST((SELECT count(*) FROM alr a WHERE a.session_id = bst.session_id AND NOT insufficient_history) AS VARCHAR) || '.'
      || CASE WHEN session_id = 'sess_1' THEN ' The run completed in degraded mode.' ELSE '' END AS executive_summary FROM bst GROUP BY session_id)"""


def sessions_of(found):
    return found.groupBy("session_id").agg(F.lit(True).alias("_")).select(
        "session_id", (F.col("session_id") == "sess_1").alias("degraded_mode")
    )


@query("rpt_exec_summary", sql("clu alr", f"WITH {SQL_EXEC} SELECT session_id, executive_summary FROM exe"))
def rpt_exec_summary(spark, d):
    found = clusters(spark, d)
    return report.executive_summary(sessions_of(found), found, alerts(spark, d))


def sanitized_texts(rows):
    """What may be shown of the reviews: masked texts without a residual."""
    return rows.where(~F.col("residual")).select("session_id", "review_id", F.col("text_anonymized").alias("text"))


def report_parts(spark, d, rows=None):
    """Frames of the reports; ``rows`` are parsed ones, read once here. The assignments are stored without texts, as roll-ups, alerts and counts read them."""
    asg = settled(assignments(spark, d).drop("text"), "assignments")
    found = settled(clusters(spark, d, asg), "clusters")
    spikes = settled(alerts(spark, d, asg), "spikes")
    counters = settled(prepare.refreshed(prepare.summary(parsed(spark, d) if rows is None else rows)), "counters")
    mixed = asg.groupBy("session_id").agg(F.count_if(F.col("language") == "mixed").alias("mixed_language_review_count"))
    diagnostics = themes.diagnostics(found, mixed)
    base = sessions_of(found)
    sessions = settled(
        base.join(report.executive_summary(base, found, spikes), "session_id").join(counters, "session_id").join(diagnostics, "session_id")
        .withColumns({
            "quality_score": F.lit(0.4), "clustering_backend": F.lit("kmeans"), "clustering_profile": F.lit("kmeans_3"),
            "attempt_count": F.lit(6), "degraded_reason": F.when(F.col("degraded_mode"), "low_clustering_quality"),
        }), "sessions",
    )
    return asg, found, spikes, counters, diagnostics, sessions


def markdown_reports(spark, d):
    """(parsed rows, report per session); quotes and listed reviews show sanitized texts."""
    rows = settled(parsed(spark, d), "parsed")
    asg, found, spikes, _, _, sessions = report_parts(spark, d, rows)
    shown = sanitized_texts(rows)
    quotes = settled(lookups.quote_texts(quoted_clusters(assignments(spark, d)), shown), "quotes")
    listed = asg.join(shown, lookups.REVIEW)
    return rows, report.markdown(sessions, found, quotes, spikes, listed)


def _sql_texts(section, texts, source, order=""):
    """Report lines of one section from a source table, in the order of the texts; ``order`` goes before it."""
    return f"SELECT session_id, {section} AS sec, {order or 'i, 0, 0'}, text FROM (SELECT *, unnest([{', '.join(texts)}]) AS text, unnest(range({len(texts)})) AS i FROM {source})"


def _sql_line(section, text, source, order):
    return f"SELECT session_id, {section} AS sec, {order}, {text} AS text FROM {source}"


_HEAD = ["'# Feedback report for ' || session_id", "''", "'## Executive Summary'", "''", "executive_summary", "''", "'## Batch Overview'", "''"] + [
    f"'- {title}: ' || {value}" for title, value in [
        ("Total records", "total_records"), ("Reviews kept after preprocessing", "kept_records"), ("Duplicate records removed", "duplicate_records"),
        ("Reviews quarantined by privacy gate", "quarantined_records"), ("Potential injection attempts", "injection_hits"),
        ("Low-information reviews", "low_information_records"), ("Degraded mode", "CASE WHEN degraded_mode THEN 'yes' ELSE 'no' END"),
    ]
]
_LOW = [
    "''", "'## Low Data Mode'", "''", f"'Warning: fewer than {rules.LOW_DATA_ROWS} reviews were uploaded, so clustering reliability is limited.'",
    "'Reviews are listed first, and any detected themes are provisional.'", "''", "'## Simple List View'", "''",
]
_TABLE = ["''", "'## Top Themes'", "''", "'| Cluster ID | Label | Reviews | Priority | Sentiment | Trend | Confidence |'", "'|---|---|---:|---:|---:|---:|---|'"]
_ROW = "'| `' || cluster_id || '` | ' || label || ' | ' || size || ' | ' || " + " || ' | ' || ".join(
    SQL_FIXED.format(c, 2) for c in ("priority_score", "sentiment_score", "trend_delta")
) + " || ' | ' || confidence || ' |'"
_THEME = [
    "'### ' || label || ' (`' || cluster_id || '`)'", "''", "summary", "''",
    *[f"'- {title}: ' || CASE WHEN len({c}) > 0 THEN array_to_string({c}, ', ') ELSE 'n/a' END" for title, c in (("Keywords", "keywords"), ("Sources", "sources"))],
    "'- Priority score: ' || " + SQL_FIXED.format("priority_score", 2), "'- Confidence: ' || confidence", "'- Degraded reason: ' || coalesce(degraded_reason, 'n/a')", "''",
]
_RUN = ["''", "'## Run Diagnostics'", "''"] + [f"'- {title}: ' || {value}" for title, value in [
    ("Clustering quality score", SQL_FIXED.format("0.4", 3)), ("Clustering backend", "'kmeans'"), ("Selected clustering profile", "'kmeans_3'"), ("Reflection attempts", "6"),
    ("Total clusters included in report", "(SELECT count(*) FROM shw WHERE shw.session_id = ses.session_id)"), ("Weak signal clusters", "weak_signal_cluster_count"),
    ("Mixed sentiment clusters", "mixed_sentiment_cluster_count"), ("Mixed-language reviews", "mixed_language_review_count"),
    ("Low data mode", "CASE WHEN low_data_mode THEN 'yes' ELSE 'no' END"), ("Degraded reason", "CASE WHEN degraded_mode THEN 'low_clustering_quality' ELSE 'n/a' END"),
]] + ["''"]
_SPIKE = "'- `' || cluster_id || '` [' || severity || '] ' || reason || coalesce(' Spike ratio: ' || " + SQL_FIXED.format("spike_ratio", 2) + " || '.', '')"
_LINES = [
    _sql_texts(1, _HEAD, "ses"), _sql_texts(2, _LOW, "ses WHERE low_data_mode"),
    _sql_line(3, "'- `' || review_id || '` [' || source || '] ' || strftime(created_at, '%Y-%m-%d') || ' `' || language || '` :: ' || text",
              "(SELECT a.* EXCLUDE (text), s.text FROM asg a JOIN sny s USING (session_id, review_id)) WHERE session_id IN (SELECT session_id FROM ses WHERE low_data_mode)", "raw_index, 0, 0"),
    _sql_texts(4, _TABLE, "ses"), _sql_line(5, _ROW, "shw", "rank, 0, 0"), _sql_texts(6, ["''", "'## Theme Detail'", "''"], "ses"),
    _sql_texts(7, _THEME, "shw", "rank, 0, i"),
    _sql_line(7, "'Top quotes:'", "shw WHERE len(quotes) > 0", "rank, 1, 0"),
    _sql_line(7, "'- \"' || q || '\"'", "(SELECT *, unnest(quotes) AS q, generate_subscripts(quotes, 1) - 1 AS i FROM shw)", "rank, 2, i"),
    _sql_line(7, "''", "shw WHERE len(quotes) > 0", "rank, 3, 0"),
    _sql_texts(8, ["'## Weak Signals'", "''"], "ses"),
    _sql_line(9, "'- `' || cluster_id || '` ' || label || ': ' || summary", "clu WHERE weak", "-priority_score, 0, 0"),
    _sql_line(9, "'- No weak-signal clusters were detected in this batch.'", "ses WHERE session_id NOT IN (SELECT session_id FROM clu WHERE weak)", "0, 0, 0"),
    _sql_texts(10, ["'## Alerts'", "''"], "ses"), _sql_line(11, _SPIKE, "spk", "o, 0, 0"),
    _sql_line(11, "'  - \"' || q || '\"'", "(SELECT *, unnest(quotes[1:3]) AS q, generate_subscripts(quotes[1:3], 1) - 1 AS i FROM spk)", "o, 1, i"),
    _sql_line(11, "'- No critical anomaly spikes were detected in the available history.'", "ses WHERE session_id NOT IN (SELECT session_id FROM spk)", "0, 0, 0"),
    _sql_texts(12, ["''", "'## Notes'", "''", "'- Some clusters do not have enough weekly history for anomaly confirmation yet.'"], "ses WHERE session_id IN (SELECT session_id FROM alr WHERE insufficient_history)"),
    _sql_texts(13, _RUN, "ses"),
]
#: Counters, diagnostics and summaries per session, from the views nrm, asg, clu and alr.
SQL_SESSIONS = SQL_COUNTERS + ", smy AS (" + SQL_SUMMARY.format(" AND copy = 1 AND NOT residual") + f"), {SQL_EXEC.strip()}," + f"""
    dia AS (SELECT c.*, reviews < {rules.LOW_DATA_ROWS} AS low_data_mode, mixed_language_review_count FROM
      (SELECT session_id, sum(size) AS reviews, coalesce(array_to_string(list_sort(list(cluster_id) FILTER (weak)), ','), '') AS weak_signal_cluster_ids, count(*) FILTER (weak) AS weak_signal_cluster_count,
        coalesce(array_to_string(list_sort(list(cluster_id) FILTER (mixed_sentiment)), ','), '') AS mixed_sentiment_cluster_ids, count(*) FILTER (mixed_sentiment) AS mixed_sentiment_cluster_count FROM clu GROUP BY ALL) c
      LEFT JOIN (SELECT session_id, count(*) FILTER (language = 'mixed') AS mixed_language_review_count FROM asg GROUP BY ALL) USING (session_id)),
    ses AS (SELECT *, session_id = 'sess_1' AS degraded_mode FROM exe JOIN smy USING (session_id) JOIN dia USING (session_id))"""
SQL_MARKDOWN = SQL_SESSIONS + f""", {SQL_QUOTES.strip()},
    sny AS MATERIALIZED (SELECT session_id, review_id, masked AS text FROM fst WHERE NOT residual),
    quo AS (SELECT session_id, cluster_id, list(s.text ORDER BY rank) AS quotes FROM qt JOIN sny s USING (session_id, review_id) GROUP BY ALL),
    shw AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY priority_score DESC, size DESC, cluster_id) AS rank
      FROM (SELECT *, bool_or(NOT weak) OVER (PARTITION BY session_id) AS has_top FROM clu) LEFT JOIN quo USING (session_id, cluster_id) WHERE NOT weak OR NOT has_top QUALIFY rank <= {rules.REPORT_THEMES}),
    spk AS (SELECT a.*, quotes, row_number() OVER (PARTITION BY session_id ORDER BY priority_score DESC, cluster_id) AS o
      FROM alr a LEFT JOIN (SELECT session_id, cluster_id, priority_score FROM clu) USING (session_id, cluster_id) LEFT JOIN quo USING (session_id, cluster_id) WHERE NOT insufficient_history),
    lns(session_id, sec, o0, o1, o2, text) AS ({' UNION ALL '.join(_LINES)}),
    mdn AS (SELECT session_id, trim(string_agg(text, chr(10) ORDER BY sec, o0, o1, o2, text), ' ' || chr(10)) || chr(10) AS markdown FROM lns GROUP BY ALL)"""


@query("rpt_markdown", sql("nrm asg clu alr", SQL_MARKDOWN + " SELECT session_id, markdown FROM mdn"))
def rpt_markdown(spark, d):
    return markdown_reports(spark, d)[1]


_META = {
    "runtime_profile": "CASE WHEN hosted THEN 'llm-enhanced' ELSE 'deterministic' END", "presentation_mode": "CASE WHEN low_data_mode THEN 'simple_list' ELSE 'clustered' END",
    "low_data_mode": "low_data_mode", "generation_backend_effective": "CASE WHEN hosted THEN 'hosted' ELSE 'local' END", "retrieval_backend_effective": "'local'",
    "records_total": "total_records", "records_kept": "kept_records", "top_cluster_ids": "top_cluster_ids", "weak_signal_cluster_ids": "weak_signal_cluster_ids",
    "weak_signal_count": "weak_signal_cluster_count", "mixed_sentiment_cluster_ids": "mixed_sentiment_cluster_ids",
    "mixed_sentiment_cluster_count": "mixed_sentiment_cluster_count", "mixed_language_review_count": "mixed_language_review_count",
}
_KINDS = {"str": "VARCHAR", "bool": "BOOLEAN", "int": "BIGINT", "float": "DOUBLE"}
_META |= {n: f"CAST('{v}' AS {_KINDS[type(v).__name__]})" for n, v in schemas.RUNTIME_DEFAULTS.items() if n not in _META}


@query("rpt_runtime_metadata", sql("nrm asg clu alr je", SQL_SESSIONS + f""",
    met AS (SELECT session_id, {', '.join(f'{v} AS {n}' for n, v in _META.items())}
      FROM (SELECT *, session_id IN (SELECT 'sess_' || CAST(k % 4 AS VARCHAR) FROM je WHERE k % 8 = 1) AS hosted FROM ses)
      LEFT JOIN (SELECT session_id, array_to_string(list(cluster_id ORDER BY rank), ',') AS top_cluster_ids FROM
        (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY priority_score DESC, size DESC, cluster_id) AS rank FROM clu WHERE NOT weak QUALIFY rank <= 5) GROUP BY ALL) USING (session_id))
    SELECT *, array_to_string(['## Runtime Metadata', '', {', '.join(f"'- {n.replace('_', ' ').capitalize()}: `' || coalesce(CAST({n} AS VARCHAR), 'n/a') || '`'" for n in _META)}, ''], chr(10)) AS appendix FROM met"""))
def rpt_runtime_metadata(spark, d):
    _, found, _, counters, diagnostics, _ = report_parts(spark, d)
    usage = job_events(spark, d).select(
        F.concat(F.lit("sess_"), (F.col("k") % 4).cast("string")).alias("session_id"), F.col("stage").alias("agent"),
        F.when(F.col("k") % 4 == 0, "local").when(F.col("k") % 8 == 1, "hosted").otherwise("fallback").alias("mode"), F.lit(True).alias("used"),
    )
    top = ranking.top_clusters(found.where(~F.col("weak")), 5).groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "cluster_id"))).alias("t")
    ).select("session_id", F.col("t.cluster_id").alias("top_cluster_ids"))
    done = report.runtime_metadata(counters, diagnostics, usage, top, {"retrieval_backend_effective": "local"})
    filled = report.with_runtime_defaults(done)
    flat = filled.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in filled.dtypes])
    return flat.join(report.runtime_lines(flat), "session_id")


_ITEM = "struct_pack(rank := rank, cluster_id := cluster_id, label := label, size := size, priority_score := priority_score)"


@query("rpt_session_detail", sql("nrm asg clu alr", SQL_SESSIONS + f""",
    nst AS (SELECT session_id, to_json(list({_ITEM} ORDER BY rank)) AS clusters, coalesce(to_json(list({_ITEM} ORDER BY rank) FILTER (NOT weak)), '[]') AS top_clusters,
      coalesce(to_json(list({_ITEM} ORDER BY rank) FILTER (weak)), '[]') AS weak_signals, count(*) FILTER (weak) AS n_weak
      FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY priority_score DESC, size DESC, cluster_id) AS rank FROM clu) GROUP BY ALL),
    alj AS (SELECT session_id, to_json(list(struct_pack(alert_id := alert_id, severity := severity, reason := reason) ORDER BY alert_id, severity, reason)) AS alerts FROM alr GROUP BY ALL)
    SELECT session_id, degraded_mode, smy.* EXCLUDE (session_id), CAST(clusters AS VARCHAR) AS clusters, CAST(top_clusters AS VARCHAR) AS top_clusters, CAST(weak_signals AS VARCHAR) AS weak_signals,
      CAST(alerts AS VARCHAR) AS alerts, 'report_' || session_id AS report_id, executive_summary, CASE WHEN low_data_mode THEN 'simple_list' ELSE 'clustered' END AS presentation_mode, low_data_mode,
      CAST(to_json(list_filter([CASE WHEN low_data_mode THEN 'Low-data mode is active because fewer than {rules.LOW_DATA_ROWS} reviews were uploaded.' END,
        CASE WHEN n_weak > 0 THEN CAST(n_weak AS VARCHAR) || ' weak-signal clusters were excluded from the top themes.' END], lambda w: w IS NOT NULL)) AS VARCHAR) AS warnings
    FROM (SELECT session_id, degraded_mode, executive_summary, low_data_mode FROM ses) JOIN smy USING (session_id) LEFT JOIN nst USING (session_id) LEFT JOIN alj USING (session_id)"""))
def rpt_session_detail(spark, d):
    _, found, spikes, counters, diagnostics, sessions = report_parts(spark, d)
    reports = sessions.select("session_id", F.concat(F.lit("report_"), "session_id").alias("report_id"), "executive_summary")
    metadata = diagnostics.select("session_id", "low_data_mode", F.when(F.col("low_data_mode"), "simple_list").otherwise("clustered").alias("presentation_mode"))
    base = sessions.select("session_id", "degraded_mode")
    detail = report.session_detail(base, counters, found, spikes, reports, metadata)
    return detail.select(*[F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in detail.dtypes])


# --------------------------------------------------------------------------------------- evals

@query("eval_pii_leak", sql("nrm asg clu alr", SQL_MARKDOWN + r"""
    SELECT session_id, count(*) AS texts, count(*) FILTER (bad) AS leaks, count(*) FILTER (bad) = 0 AS passed
    FROM (SELECT session_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') OR regexp_matches(text, '\+?\d[\d\-\s()]{7,}\d') AS bad
      FROM (SELECT session_id, masked AS text FROM fst WHERE copy = 1 AND NOT residual UNION ALL SELECT session_id, markdown FROM mdn)) GROUP BY ALL"""))
def eval_pii_leak(spark, d):
    rows, reports = markdown_reports(spark, d)
    kept = sanitized_texts(prepare.first_per_hash(rows))
    return evals.leak_check(kept.drop("review_id").unionByName(reports.withColumnRenamed("markdown", "text")))


SQL_FIXED_QUESTIONS = "SELECT unnest([" + ", ".join(
    f"struct_pack(question_id := '{i}', question := '{q}', expected_prefix := '{p}')" for i, (q, p) in enumerate(rules.FIXED_QUESTIONS)
) + "], max_depth := 2)"


@query("eval_fixed_questions", sql("asg clu qs", f"""WITH {SQL_INDEX},
    fxq AS (SELECT DISTINCT session_id || '-' || question_id AS question_id, session_id, question, expected_prefix, 0 AS topic FROM clu, ({SQL_FIXED_QUESTIONS})), {sql_search('', 'fxq', 1)}
    SELECT a.session_id, a.question, a.expected_prefix, cluster_id, coalesce(starts_with(cluster_id, a.expected_prefix), false) AS passed
    FROM fxq a LEFT JOIN hit USING (question_id)"""))
def eval_fixed_questions(spark, d):
    built = index(spark, d)
    asked = evals.fixed_questions(sessions_of(built["cluster_rows"]).select("session_id"))
    hits = search.search(asked.withColumnRenamed("question", "query"), built, 1).select("question_id", "cluster_id")
    named = asked.select("question_id", "session_id", "question").join(hits, "question_id")
    return evals.fixed_question_check(named.drop("question_id"), asked.drop("question_id"))


@query("eval_run_completeness", sql("je", """
    WITH s AS (SELECT job_id AS session_id, ['COMPLETED', 'DEGRADED_COMPLETED', 'FAILED'][CAST(max(id) % 3 AS INT) + 1] AS status, max(id) % 5 <> 0 AS done, min(k) AS mk,
      bool_and(k <> 13) AS traced FROM je GROUP BY ALL)
    SELECT session_id, status <> 'FAILED' AND done AS completed, session_id <> 'job_3' AS metadata_present, traced AS events_traced,
      status <> 'FAILED' AND done AND session_id <> 'job_3' AND traced AS passed FROM s"""))
def eval_run_completeness(spark, d):
    events = job_events(spark, d).select(
        F.col("job_id").alias("session_id"), "id", F.when(F.col("k") != 13, F.concat(F.lit("corr_"), "job_id")).alias("correlation_id")
    )
    states = F.array(F.lit("COMPLETED"), F.lit("DEGRADED_COMPLETED"), F.lit("FAILED"))
    last = events.groupBy("session_id").agg(F.max("id").alias("last"))
    sessions = last.select(
        "session_id", F.element_at(states, (F.col("last") % 3 + 1).cast("int")).alias("status"),
        F.when(F.col("last") % 5 != 0, "COMPLETED").otherwise("RUNNING").alias("job_status"),
    )
    metadata = last.where(F.col("session_id") != "job_3").select("session_id", F.lit("local").alias("retrieval_backend_effective"))
    return evals.completeness_check(sessions, metadata, events)
