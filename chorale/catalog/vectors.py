"""Features, vector comparisons and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale import rules
from chorale.catalog.core import query
from chorale.catalog.views import assignments, clusters, feedback, sql, sql_in, table
from chorale.functions import values
from chorale.functions.vectors import dot, norm
from chorale.operators import clustering, density, features, similarity, sweep, themes
from chorale.operators.attach import attach
from chorale.plans import clusters as plan
from chorale.session import settled

SQL_UNIT = "CAST(embedding AS DOUBLE[])"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(
        F.concat(F.lit("sess_"), (F.col("label") % 2).cast("string")).alias("session_id"),
        F.col("vec_id").alias("item_id"), F.col("label").alias("cluster_id"), F.col("embedding").alias("vector"),
    )


def topic_queries(spark, d):
    """One query vector per label (the mean of its vectors), asked of both sessions."""
    means = similarity.centroids(vectors(spark, d), ["cluster_id"])
    both = F.explode(F.array(F.lit("sess_0"), F.lit("sess_1"))).alias("session_id")
    return means.select(both, F.col("cluster_id").alias("query_id"), "vector")


SQL_TOPICS = """
    vec AS (SELECT 'sess_' || CAST(label % 2 AS VARCHAR) AS session_id, vec_id AS item_id, label AS cluster_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
    dim AS (SELECT cluster_id, i, avg(x) AS m FROM (SELECT cluster_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM vec) GROUP BY ALL),
    top AS (SELECT cluster_id AS query_id, list(m ORDER BY i) AS q FROM dim GROUP BY ALL),
    sim AS (SELECT session_id, query_id, item_id, cluster_id, list_cosine_similarity(q, vector) AS s FROM top, vec)"""


@query("join_similarity_cross", f"WITH {SQL_TOPICS} SELECT session_id, query_id, cluster_id, round(greatest(0.0, max(s)), 6) AS score FROM sim GROUP BY ALL")
def join_similarity_cross(spark, d):
    best = similarity.best_per_group(topic_queries(spark, d), vectors(spark, d), ["session_id"], "cluster_id", tile_rows=300)
    return best.withColumn("score", F.round("score", 6))


@query("topk_candidates", f"""WITH {SQL_TOPICS}
    SELECT session_id, query_id, item_id, round(1 - s, 6) AS distance, CAST(row_number() OVER (PARTITION BY session_id, query_id ORDER BY 1 - s, item_id) AS INT) AS rank
    FROM sim QUALIFY rank <= 20""")
def topk_candidates(spark, d):
    near = similarity.nearest(topic_queries(spark, d), vectors(spark, d), ["session_id"], 20, tile_rows=300)
    return near.withColumn("distance", F.round("distance", 6))


@query("agg_max_score_by_cluster", f"""WITH {SQL_TOPICS}
    SELECT session_id, query_id, cluster_id, round(max(greatest(0.0, least(1.0, s))), 6) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id, query_id ORDER BY 1 - s, item_id) AS rank FROM sim QUALIFY rank <= 24) GROUP BY ALL""")
def agg_max_score_by_cluster(spark, d):
    near = similarity.nearest(topic_queries(spark, d), vectors(spark, d), ["session_id"], 24)
    named = near.join(vectors(spark, d).select("item_id", "cluster_id"), "item_id")
    scored = named.groupBy("session_id", "query_id", "cluster_id").agg(F.max(values.similarity(F.col("distance"))).alias("score"))
    return scored.withColumn("score", F.round("score", 6))


SQL_PAIRS = """
    vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label <> 9),
    dst AS (SELECT a.vec_id, a.label AS own, b.label, sum({0}) AS total, count(*) AS n FROM vec a, vec b WHERE a.vec_id <> b.vec_id GROUP BY ALL),
    sil AS (SELECT vec_id, max(total / n) FILTER (own = label) AS a, min(total / n) FILTER (own <> label) AS b FROM dst GROUP BY ALL)"""


@query("join_pairwise_silhouette", f"""WITH {SQL_PAIRS.format('list_distance(a.v, b.v)')}
    SELECT vec_id AS item_id, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM sil""")
def join_pairwise_silhouette(spark, d):
    points = vectors(spark, d).select("item_id", "vector", noisy_label().alias("label"))
    found = similarity.silhouette_exact(points, [], "label", tile_rows=200)
    return found.select("item_id", F.round("silhouette", 6).alias("silhouette"))


def noisy_label():
    """Label 9 as noise."""
    return F.when(F.col("cluster_id") == 9, -1).otherwise(F.col("cluster_id"))


@query("ml_quality_score", f"""WITH {SQL_PAIRS.format('pow(list_distance(a.v, b.v), 2)')}
    SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS quality_score, count(*) AS points,
      (SELECT count(DISTINCT label) FROM vec) AS clusters FROM sil""")
def ml_quality_score(spark, d):
    points = vectors(spark, d).select("item_id", "vector", noisy_label().alias("label"))
    return similarity.silhouette_linear(points, [], "label").withColumn("quality_score", F.round("quality_score", 6))


@query("agg_cluster_counts", """
    SELECT 'sess_' || CAST(label % 2 AS VARCHAR) AS session_id, count(DISTINCT CASE WHEN label <> 9 THEN label END) AS cluster_count,
      count(*) FILTER (label = 9) / CAST(count(*) AS DOUBLE) AS noise_fraction FROM embeddings GROUP BY ALL""")
def agg_cluster_counts(spark, d):
    return clustering.cluster_counts(vectors(spark, d).withColumn("label", noisy_label()), ["session_id"], "label")


@query("ml_label_key", "SELECT vec_id AS item_id, CASE WHEN label = 9 THEN 'weak_signals' ELSE 'cluster_' || CAST(label + 1 AS VARCHAR) END AS cluster_key FROM embeddings")
def ml_label_key(spark, d):
    return vectors(spark, d).select("item_id", clustering.label_key(noisy_label()).alias("cluster_key"))


@query("ml_weak_signal", sql("clu", "SELECT session_id, cluster_id, cluster_id = 'weak_signals' OR size <= 37 AS weak FROM clu"))
def ml_weak_signal(spark, d):
    return clusters(spark, d).select(*themes.KEYS, themes.is_weak(F.col("cluster_id"), F.col("size"), 37).alias("weak"))


@query("ml_degraded_mode", """
    SELECT *, reviews < 5 OR quality_score < 0.03 OR reviews < 30 AS degraded_mode FROM (
      SELECT session_id, reviews, CASE WHEN reviews < 5 THEN 0.0 ELSE q END AS quality_score, reviews < 5 AS one_cluster, reviews < 30 AS low_data_mode
      FROM (SELECT conv_id AS session_id, count(*) * (1 + conv_id % 9) AS reviews, (conv_id % 10) / 100.0::DOUBLE AS q FROM conversations GROUP BY conv_id))""")
def ml_degraded_mode(spark, d):
    sessions = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("n")).select(
        "session_id", (F.col("n") * (1 + F.col("session_id") % 9)).alias("reviews"), (F.col("session_id") % 10 / F.lit(100.0)).alias("quality_score")
    )
    return clustering.run_mode(sessions)


EPS, MAX_K = 1.13, 8

#: Density labels of every profile (session_id, ord, samples, size) of ``prof``.
SQL_DENSITY = f"""
    near AS MATERIALIZED (SELECT session_id, a.item_id AS a, b.item_id AS b, list_distance(a.v, b.v) AS d FROM vec a JOIN vec b USING (session_id)
      WHERE a.item_id <> b.item_id AND list_distance(a.v, b.v) <= {EPS}),
    core AS (SELECT ord, a FROM near JOIN prof USING (session_id) GROUP BY ord, a, samples HAVING count(*) >= samples),
    reach AS (SELECT ord, a, a AS r FROM core UNION SELECT reach.ord, n.b, reach.r FROM reach JOIN near n ON n.a = reach.a JOIN core ON core.ord = reach.ord AND core.a = n.b),
    comp AS (SELECT ord, a, min(r) AS c FROM reach GROUP BY ALL),
    edge AS (SELECT comp.ord, n.a, arg_min(comp.c, (n.d, n.b)) AS c FROM near n JOIN comp ON n.b = comp.a ANTI JOIN core ON core.ord = comp.ord AND core.a = n.a GROUP BY ALL),
    mem AS (SELECT session_id, m.* FROM (SELECT * FROM comp UNION ALL SELECT * FROM edge) m JOIN vec ON vec.item_id = m.a),
    big AS (SELECT session_id, ord, c, row_number() OVER (PARTITION BY session_id, ord ORDER BY count(*) DESC, min(a)) - 1 AS label
      FROM mem JOIN prof USING (session_id, ord) GROUP BY session_id, ord, c, size HAVING count(*) >= size),
    lab AS MATERIALIZED (SELECT session_id, prof.ord, item_id, CAST(coalesce(big.label, -1) AS INT) AS label FROM vec JOIN prof USING (session_id)
      LEFT JOIN mem ON mem.ord = prof.ord AND mem.a = item_id LEFT JOIN big ON big.session_id = vec.session_id AND big.ord = mem.ord AND big.c = mem.c)"""
SQL_VEC = f"vec AS MATERIALIZED (SELECT 'sess_' || CAST(label % 2 AS VARCHAR) AS session_id, vec_id AS item_id, {SQL_UNIT} AS v FROM embeddings)"


def points(spark, d):
    return vectors(spark, d).select("session_id", "item_id", "vector")


@query("ml_density_clusters", f"""WITH RECURSIVE {SQL_VEC}, prof AS (SELECT DISTINCT session_id, 1 AS ord, {rules.MIN_SAMPLES} AS samples, {rules.MIN_CLUSTER_SIZE} AS size FROM vec),
    {SQL_DENSITY} SELECT session_id, item_id, label FROM lab""")
def ml_density_clusters(spark, d):
    rows = points(spark, d)
    return density.density_clusters(rows, density.settings(rows, EPS))


def sql_sweep(rounds: int = sweep.ROUNDS) -> str:
    """k-means from a farthest-first start: ``att`` has the attempts, ``swp`` the clusters."""
    square = "round(pow(list_distance(v, centre), 2), 9)"

    def means(rows, by):
        return f"""SELECT {by}, list(m ORDER BY i) AS centre FROM (SELECT {by}, i, avg(x) AS m FROM
      (SELECT {by}, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {rows}) GROUP BY ALL) GROUP BY ALL"""

    out = [
        f"mid AS ({means('vec', 'session_id')})",
        f"s0 AS MATERIALIZED (SELECT session_id, 0 AS c, arg_min(v, ({square}, item_id)) AS centre FROM vec JOIN mid USING (session_id) GROUP BY ALL)",
    ]
    for n in range(1, MAX_K):
        out.append(f"""s{n} AS MATERIALIZED (SELECT * FROM s{n - 1} UNION ALL SELECT session_id, {n}, arg_min(v, (-far, item_id)) FROM
      (SELECT session_id, item_id, v, min({square}) AS far FROM vec JOIN s{n - 1} USING (session_id) GROUP BY ALL) GROUP BY ALL)""")
    out.append(f"""c0 AS MATERIALIZED (SELECT session_id, k, c, centre FROM s{MAX_K - 1}
      JOIN (SELECT session_id, unnest(generate_series(3, most)) AS k FROM (SELECT session_id, least({MAX_K}, greatest(2, count(*) // 3)) AS most FROM vec GROUP BY ALL))
      USING (session_id) WHERE c < k)""")
    near = "SELECT session_id, k, item_id, v, arg_min(c, (list_distance(v, centre), c)) AS c FROM vec JOIN c{} USING (session_id) GROUP BY ALL"
    for r in range(1, rounds + 1):
        out.append(f"m{r} AS ({means('(' + near.format(r - 1) + ')', 'session_id, k, c')})")
        out.append(f"c{r} AS MATERIALIZED (SELECT session_id, k, c, coalesce(m.centre, p.centre) AS centre FROM c{r - 1} p LEFT JOIN m{r} m USING (session_id, k, c))")
    out.append(f"""asn AS MATERIALIZED ({near.format(rounds)}),
    pth AS MATERIALIZED (SELECT session_id, a.item_id AS a, b.item_id AS b, pow(list_distance(a.v, b.v), 2) AS d FROM vec a JOIN vec b USING (session_id) WHERE a.item_id <> b.item_id),
    gap AS (SELECT session_id, x.k, x.item_id, x.c AS own, y.c, avg(d) AS d FROM pth JOIN asn x USING (session_id) JOIN asn y USING (session_id, k) WHERE x.item_id = a AND y.item_id = b GROUP BY ALL),
    shd AS (SELECT session_id, k, item_id, max(d) FILTER (c = own) AS a, min(d) FILTER (c <> own) AS b FROM gap GROUP BY ALL),
    swp AS MATERIALIZED (SELECT session_id, k, c, count(*) AS size, sum(pow(list_distance(v, centre), 2)) AS inertia FROM asn JOIN c{rounds} USING (session_id, k, c) GROUP BY ALL),
    qlt AS (SELECT session_id, k, avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS q FROM shd GROUP BY ALL),
    att AS MATERIALIZED (SELECT *, q > 0 AND row_number() OVER (PARTITION BY session_id ORDER BY q DESC, k) = 1 AS chosen FROM qlt JOIN (SELECT session_id, k, count(*) AS n FROM swp GROUP BY ALL) USING (session_id, k))""")
    return ",\n    ".join(out)


@query("ml_cluster_sweep", f"""WITH {SQL_VEC}, {sql_sweep()}
    SELECT session_id, CAST(k AS INT) AS k, CAST(c AS INT) AS label, size, round(inertia, 6) AS inertia, round(q, 6) AS quality_score, chosen, k = {MAX_K} AS at_limit
    FROM swp JOIN att USING (session_id, k)""")
def ml_cluster_sweep(spark, d):
    _, attempts, found = sweep.sweep(points(spark, d), MAX_K)
    return found.join(attempts.select("session_id", "k", "quality_score", "chosen", "at_limit"), ["session_id", "k"]).select(
        "session_id", "k", F.col("c").alias("label"), "size", F.round("inertia", 6).alias("inertia"), F.round("quality_score", 6).alias("quality_score"), "chosen", "at_limit",
    )


SQL_PROFILES = f"""
    cnt AS (SELECT session_id, count(*) AS n, least({rules.MIN_CLUSTER_SIZE}, greatest(2, count(*) // 4)) AS size, least({rules.MIN_SAMPLES}, greatest(1, count(*) // 6)) AS samples FROM vec GROUP BY ALL),
    prof AS (SELECT session_id, 1 AS ord, 'density_default' AS name, size, samples FROM cnt UNION ALL SELECT session_id, 2, 'density_smaller_clusters', greatest(2, size - 1), samples FROM cnt
      UNION ALL SELECT session_id, 3, 'density_more_stable', least(greatest(2, n - 1), size + 1), least(greatest(1, n - 2), samples + 1) FROM cnt),
    {SQL_DENSITY},
    {sql_sweep()},
    dgp AS (SELECT session_id, x.ord, x.item_id, x.label AS own, y.label, avg(d) AS d FROM pth JOIN lab x USING (session_id) JOIN lab y USING (session_id, ord)
      WHERE x.item_id = a AND y.item_id = b AND x.label >= 0 AND y.label >= 0 GROUP BY ALL),
    dsh AS (SELECT session_id, ord, item_id, max(d) FILTER (label = own) AS a, min(d) FILTER (label <> own) AS b FROM dgp GROUP BY ALL),
    dql AS (SELECT session_id, ord, CASE WHEN count(*) < 3 OR bool_or(b IS NULL) THEN 0 ELSE avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) END AS q FROM dsh GROUP BY ALL),
    den AS (SELECT session_id, ord, name, coalesce(q, 0) AS q, (SELECT count(DISTINCT label) FROM lab WHERE lab.session_id = prof.session_id AND lab.ord = prof.ord AND label >= 0) AS n,
      (SELECT avg(CASE WHEN label = -1 THEN 1 ELSE 0 END) FROM lab WHERE lab.session_id = prof.session_id AND lab.ord = prof.ord) AS noise FROM prof LEFT JOIN dql USING (session_id, ord)),
    stp AS (SELECT session_id, min(ord) AS s FROM den WHERE q >= {rules.QUALITY_GATE} AND n <= {rules.MAX_CLUSTERS} GROUP BY ALL),
    tri AS (SELECT session_id, ord, 'density' AS backend, name, q, n, noise FROM den LEFT JOIN stp USING (session_id) WHERE s IS NULL OR ord <= s
      UNION ALL SELECT session_id, 100 + k, 'kmeans', 'kmeans_' || CAST(k AS VARCHAR), q, n, 0 FROM att)"""


@query("ml_profile_select", f"""WITH RECURSIVE {SQL_VEC}, {SQL_PROFILES}
    SELECT session_id, count(*) OVER w AS attempt_count, CASE WHEN q > 0 THEN backend ELSE 'single' END AS backend, CASE WHEN q > 0 THEN name ELSE 'one_cluster' END AS profile_name,
      round(CASE WHEN q > 0 THEN q ELSE 0.0 END, 6) AS quality_score, CASE WHEN q > 0 THEN n ELSE 1 END AS cluster_count, q >= {rules.QUALITY_GATE} AS quality_gate_passed
    FROM tri WINDOW w AS (PARTITION BY session_id)
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY q DESC, backend = 'density' DESC, n, name DESC) = 1""")
def ml_profile_select(spark, d):
    _, _, selection = plan.clustered(points(spark, d), EPS, MAX_K)
    return selection.drop("n").withColumn("quality_score", F.round("quality_score", 6))


@query("ml_profile_attempts", f"""WITH RECURSIVE {SQL_VEC}, {SQL_PROFILES}
    SELECT session_id, CAST(ord AS INT) AS ord, backend, name AS profile_name, round(q, 6) AS quality_score, n AS cluster_count, round(CAST(noise AS DOUBLE), 6) AS noise_fraction FROM tri""")
def ml_profile_attempts(spark, d):
    _, attempts, _ = plan.clustered(points(spark, d), EPS, MAX_K)
    return attempts.withColumn("quality_score", F.round("quality_score", 6)).withColumn("noise_fraction", F.round("noise_fraction", 6))


# ------------------------------------------------------------------------------------- TF-IDF

STOP = ["the", "and", "of", "to", "et", "und", "de", "la"]
SQL_GRAMS = rf"""
    tok AS (SELECT *, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: w NOT IN {sql_in(STOP)}) AS w FROM {{0}}),
    grm AS (SELECT * EXCLUDE (w, text), unnest(list_concat(w, list_transform(list_zip(w[1:len(w)-1], w[2:len(w)]), lambda p: p[1] || ' ' || p[2]))) AS term FROM tok)"""
SQL_WEIGHTS = """
    ter AS (SELECT doc_id, term, count(*) AS tf FROM grm GROUP BY ALL),
    ndc AS (SELECT count(*) AS n FROM fb),
    voc AS (SELECT term, sum(tf) AS total, count(*) AS df, ln((min(n) + 1) / CAST(count(*) + 1 AS DOUBLE)) + 1.0 AS idf FROM ter, ndc GROUP BY term
      HAVING {0} QUALIFY row_number() OVER (ORDER BY total DESC, term) <= {1}),
    raw AS (SELECT doc_id, term, tf * idf AS w FROM ter JOIN voc USING (term)),
    nrm2 AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM raw GROUP BY ALL),
    wgt AS (SELECT doc_id, term, w / l AS weight FROM raw JOIN nrm2 USING (doc_id))"""
SQL_PER_TERM = """SELECT voc.term, CAST(total AS BIGINT) AS total, df, round(idf, 6) AS idf, round(sum(weight), 5) AS weight
    FROM voc JOIN wgt USING (term) GROUP BY ALL"""


def documents(spark, d):
    return feedback(spark, d).select(F.col("raw_index").alias("doc_id"), "text")


def per_term(rows, vocab):
    summed = features.term_weights(rows, vocab, []).groupBy("term_rank").agg(F.round(F.sum("weight"), 5).alias("weight"))
    return vocab.select("term_rank", "term", "total", "df", F.round("idf", 6).alias("idf")).join(summed, "term_rank").drop("term_rank")


@query("agg_tfidf_word", sql("fb", f"""WITH {SQL_GRAMS.replace('{0}', '(SELECT raw_index AS doc_id, text FROM fb)')}, {SQL_WEIGHTS.format('count(*) <= 0.88 * min(n)', 2500)} {SQL_PER_TERM}"""))
def agg_tfidf_word(spark, d):
    vocab, rows = features.word_block(documents(spark, d), [], STOP, 2500, 0.88)
    return per_term(rows, vocab)


SQL_CHAR = r"""
    wrd AS (SELECT raw_index AS doc_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) || ' ' AS p FROM fb),
    wct AS (SELECT doc_id, p, count(*) AS c FROM wrd GROUP BY ALL),
    num AS (SELECT unnest([3, 4, 5]) AS n),
    cut AS (SELECT doc_id, c, n, p, unnest(range(1, CAST(length(p) - n + 2 AS BIGINT))) AS i FROM wct, num WHERE n <= length(p)),
    grm AS (SELECT doc_id, c, substr(p, i, n) AS term FROM cut)"""


@query("agg_tfidf_char", sql("fb", f"WITH {SQL_CHAR}, {SQL_WEIGHTS.format('true', 2500).replace('count(*) AS tf FROM grm', 'sum(c) AS tf FROM grm')} {SQL_PER_TERM}"))
def agg_tfidf_char(spark, d):
    vocab, rows = features.char_block(documents(spark, d), [], 2500)
    return per_term(rows, vocab)


@query("agg_keywords_tfidf", sql("asg", f"""WITH {SQL_GRAMS.replace('{0}', '(SELECT session_id, cluster_id, raw_index AS doc_id, text FROM asg)')},
    ter AS (SELECT session_id, cluster_id, doc_id, term, count(*) AS tf FROM grm GROUP BY ALL),
    ndc AS (SELECT session_id, cluster_id, count(*) AS n FROM asg GROUP BY ALL),
    voc AS (SELECT session_id, cluster_id, term, sum(tf) AS total, min(n) AS n, ln((min(n) + 1) / CAST(count(*) + 1 AS DOUBLE)) + 1.0 AS idf FROM ter JOIN ndc USING (session_id, cluster_id)
      GROUP BY session_id, cluster_id, term HAVING count(*) <= 0.9 * min(n) OR min(n) = 1
      QUALIFY row_number() OVER (PARTITION BY session_id, cluster_id ORDER BY total DESC, term) <= 25),
    raw AS (SELECT session_id, cluster_id, doc_id, term, n, tf * idf AS w FROM ter JOIN voc USING (session_id, cluster_id, term)),
    len AS (SELECT session_id, cluster_id, doc_id, sqrt(sum(w * w)) AS l FROM raw GROUP BY ALL),
    mea AS (SELECT session_id, cluster_id, term, round(sum(w / l) / min(n), 9) AS score FROM raw JOIN len USING (session_id, cluster_id, doc_id) GROUP BY ALL),
    rnk AS (SELECT *, row_number() OVER (PARTITION BY session_id, cluster_id ORDER BY score DESC, term DESC) AS r FROM mea QUALIFY r <= 5)
    SELECT session_id, cluster_id, term, round(score, 5) AS score, CAST(r AS INT) AS rank FROM rnk WHERE length(term) > 2"""))
def agg_keywords_tfidf(spark, d):
    docs = assignments(spark, d).select(*themes.KEYS, F.col("raw_index").alias("doc_id"), "text")
    return features.keywords(docs, themes.KEYS, STOP).withColumn("score", F.round("score", 5))


@query("agg_svd_projection")
def agg_svd_projection(spark, d):
    dense = features.text_vectors(documents(spark, d), [], rules.CLUSTER_STOP_WORDS, 2500, 0.88, 64)
    return dense.select("doc_id", F.size("vector").alias("dimensions"), F.round(norm(F.col("vector")), 6).alias("length"))


@query("ml_vectors_in", sql("fb", """
    SELECT session_id, count(*) AS items, CASE WHEN session_id = 'sess_1' THEN 'projection' ELSE 'external' END AS embedding_backend_effective,
      CASE WHEN session_id = 'sess_1' THEN 'tfidf-svd-projection' ELSE 'given-64' END AS embedding_model_effective,
      CASE WHEN session_id = 'sess_1' THEN 'vectors_missing' END AS embedding_degraded_reason, count(*) AS vectors FROM fb GROUP BY ALL"""))
def ml_vectors_in(spark, d):
    docs = feedback(spark, d).select("session_id", F.col("raw_index").alias("item_id"), "text")
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    # Every document gets a vector in turn, but those of sess_1, which come without.
    asked = attach(docs.where("session_id <> 'sess_1'"), vectors.agg(F.count("*").alias("n")), [])
    given = asked.withColumn("vec_id", F.col("item_id") % F.col("n")).join(vectors, "vec_id").select("item_id", "vector")
    fallback = features.text_vectors(docs.withColumnRenamed("item_id", "doc_id"), [], rules.CLUSTER_STOP_WORDS, 2500, 0.88, 64)
    chosen, sources = clustering.chosen_vectors(
        docs.select("session_id", "item_id"), given, fallback.withColumnRenamed("doc_id", "item_id"), "external", "given-64"
    )
    sizes = chosen.groupBy("session_id").agg(F.count("vector").alias("vectors"))
    return sources.join(sizes, "session_id").drop("complete")
