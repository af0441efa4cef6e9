"""Sources and sinks: each query writes through the sink and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorale import schemas
from chorale.catalog.core import query
from chorale.catalog.gates import SQL_STATES, STATES
from chorale.catalog.text import SQL_FINAL_MASK
from chorale.catalog.views import RUN_TS, SQL_SQUEEZE, assignments, clusters, feedback, job_events, sql, table
from chorale.operators import ranking
from chorale.plans import prepare, report
from chorale.session import work_path
from chorale.sources import readers, writers

FIELDS = schemas.RAW_FIELDS
SQL_FIELDS = ", ".join(FIELDS)


def write_csv(rows, path, fields=FIELDS):
    rows.select(*fields).write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="",
    ).csv(path)


def write_uploads(rows, path):
    """JSON uploads of at most 500 records: lists, and objects with a ``reviews`` list."""
    upload = F.concat_ws("_", "session_id", F.floor(F.col("raw_index") / 500).cast("string"))
    packed = rows.withColumn("upload", upload).groupBy("upload").agg(
        F.to_json(F.collect_list(F.struct(*FIELDS))).alias("records"), F.min("raw_index").alias("first")
    )
    body = F.when(F.col("first") % 2 == 0, F.col("records")).otherwise(F.concat(F.lit('{"reviews": '), "records", F.lit("}")))
    packed.select("upload", body.alias("value")).write.partitionBy("upload").text(path)


@query("src_csv_feedback", sql("fb", f"SELECT {SQL_FIELDS} FROM fb"))
def src_csv_feedback(spark, d):
    path = work_path(spark, "csv")
    rows, even = feedback(spark, d), F.col("raw_index") % 2 == 0
    write_csv(rows.where(even), f"{path}/a")
    # Other uploads name their columns in another order.
    write_csv(rows.where(~even), f"{path}/b", FIELDS[::-1])
    return readers.read_csv(spark, path, recursiveFileLookup="true")[0].select(*FIELDS)


@query("src_json_feedback", sql("fb", f"SELECT {SQL_FIELDS} FROM fb"))
def src_json_feedback(spark, d):
    path = work_path(spark, "json")
    write_uploads(feedback(spark, d), path)
    return readers.read_json(spark, path)[0].select(*FIELDS)


def set_suffix(spark, folder, suffix):
    """Give the part files that Spark wrote below ``folder`` another suffix."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listFiles(root, True)
    while found.hasNext():
        path = found.next().getPath()
        if path.getName().startswith("part-"):
            stem = path.getName().rsplit(".", 1)[0]
            fs.rename(path, jvm.org.apache.hadoop.fs.Path(path.getParent(), f"{stem}.{suffix}"))


@query("src_by_suffix", sql("fb", """
    SELECT CASE CAST(raw_index % 4 AS INT) WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'jsonl' ELSE 'parquet' END AS suffix, review_id, text FROM fb
    UNION ALL SELECT 'tsv', '', 'INPUT_SCHEMA_INVALID'"""))
def src_by_suffix(spark, d):
    path, rows, n = work_path(spark, "mixed"), feedback(spark, d), F.col("raw_index") % 4
    write_csv(rows.where(n == 0), f"{path}/a")
    rows.where(n == 1).select(*FIELDS).groupBy(F.floor(F.col("review_id").cast("int") / 500).alias("part")).agg(
        F.to_json(F.collect_list(F.struct(*FIELDS))).alias("value")
    ).write.partitionBy("part").text(f"{path}/b")
    set_suffix(spark, f"{path}/b", "json")
    rows.where(n == 2).select(*FIELDS).write.json(f"{path}/c")
    set_suffix(spark, f"{path}/c", "jsonl")
    rows.where(n == 3).select(*FIELDS).write.parquet(f"{path}/d")
    rows.agg(F.max("review_id").alias("value")).coalesce(1).write.text(f"{path}/e")
    set_suffix(spark, f"{path}/e", "tsv")
    records, refused = readers.read_feedback(spark, path)
    suffix = lambda: F.regexp_extract("ingested_from", r"\.([^./]+)$", 1).alias("suffix")
    return records.select(suffix(), "review_id", "text").unionByName(
        refused.select(suffix(), F.lit("").alias("review_id"), F.col("code").alias("text"))
    )


@query("src_input_limits", sql("fb", """
    WITH s AS (SELECT DISTINCT 'sess_' || CAST(doc_id % 6 AS VARCHAR) AS session_id FROM documents),
    c AS (SELECT session_id, count(*) AS total_records, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes FROM fb GROUP BY ALL)
    SELECT session_id, coalesce(total_records, 0) AS total_records, coalesce(total_bytes, 0) AS total_bytes,
      CASE WHEN total_records IS NULL THEN 'INPUT_SCHEMA_INVALID' WHEN total_records > 240 OR total_bytes > 560000 THEN 'INPUT_LIMIT_EXCEEDED' ELSE 'ACCEPTED' END AS code
    FROM s LEFT JOIN c USING (session_id)"""))
def src_input_limits(spark, d):
    uploads = table(spark, d, "documents").select(F.concat(F.lit("sess_"), (F.col("doc_id") % 6).cast("string")).alias("session_id")).distinct()
    return readers.input_limits(feedback(spark, d), uploads, F.octet_length("text").cast("bigint"), 240, 560000)


@query("src_session_scan", sql("asg", "SELECT session_id, review_id, source, sentiment FROM asg WHERE session_id = 'sess_2'"))
def src_session_scan(spark, d):
    path = work_path(spark, "scan")
    writers.replace_sessions(assignments(spark, d), path)
    stored = writers.read_sessions(spark, path, "sess_2")
    return readers.session_scan(stored, "sess_2", "reviews").select("session_id", "review_id", "source", "sentiment")


@query("snk_sanitized_jsonl", sql("nrm", f"""
    WITH {SQL_FINAL_MASK.strip()},
    h AS (SELECT session_id, raw_index, review_id, language, masked, sha256({SQL_SQUEEZE.format('lower(masked)')}) AS copy FROM fin)
    SELECT session_id, review_id, language, sha256(masked) AS text_sha256 FROM h
    QUALIFY row_number() OVER (PARTITION BY session_id, copy ORDER BY raw_index) = 1"""))
def snk_sanitized_jsonl(spark, d):
    path = work_path(spark, "jsonl")
    kept, _, _ = prepare.prepare(feedback(spark, d), F.lit(RUN_TS).cast("timestamp"), store=work_path(spark, "parsed"))
    writers.write_sanitized(kept.select("session_id", "review_id", "language", F.col("text_anonymized").alias("text")), path)
    return writers.read_sessions(spark, path).select("session_id", "review_id", "language", F.sha2("text", 256).alias("text_sha256"))


@query("snk_replace_session", sql("asg", """
    SELECT session_id, count(*) AS n, count(*) FILTER (cluster_id = 'moved') AS moved FROM (SELECT session_id,
      CASE WHEN session_id IN ('sess_1', 'sess_3') THEN 'moved' ELSE cluster_id END AS cluster_id FROM asg) GROUP BY ALL"""))
def snk_replace_session(spark, d):
    path, asg = work_path(spark, "replace"), assignments(spark, d)
    writers.replace_sessions(asg, path)
    changed = asg.where(F.col("session_id").isin("sess_1", "sess_3")).withColumn("cluster_id", F.lit("moved"))
    writers.replace_sessions(changed, path)
    writers.replace_sessions(changed, path)
    return writers.read_sessions(spark, path).groupBy("session_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("cluster_id") == "moved").alias("moved")
    )


@query("snk_upsert_latest", sql("je", """
    SELECT job_id, stage, arg_max(status, id) AS status, max(id) AS id FROM je GROUP BY ALL"""))
def snk_upsert_latest(spark, d):
    rows = job_events(spark, d).select("job_id", "stage", "status", "id")
    early, late = rows.where(F.col("status") == "success"), rows.where(F.col("status") != "success")
    current = ranking.latest(early, ["job_id", "stage"], "id")
    return writers.upserted(current, late, ["job_id", "stage"], "id")


@query("snk_event_append", sql("je", "SELECT stage, count(*) * 2 AS n, count(DISTINCT job_id) AS jobs FROM je GROUP BY ALL"))
def snk_event_append(spark, d):
    path, rows = work_path(spark, "events"), job_events(spark, d)
    for batch in ("first", "second", "second"):  # the last one is a retry
        writers.append_log(rows, path, "stage", batch)
        writers.append_trace(rows.select("id", "job_id", "stage"), f"{path}-trace", batch)
    log = writers.read_table(spark, path).groupBy("stage").agg(F.count("*").alias("n"), F.count_distinct("job_id").alias("jobs"))
    traced = spark.read.schema("id bigint, job_id string, stage string").json(f"{path}-trace").select("stage").distinct()
    return log.join(traced, "stage")


@query("snk_state_update", sql("je", f"""
    WITH c AS (SELECT id, job_id, CASE WHEN k % 3 = 0 THEN {SQL_STATES}[k % 7 + 1] END AS status, CASE WHEN k % 4 <> 0 THEN k END AS attempt,
      CASE WHEN k % 5 = 0 THEN 'CODE_' || CAST(k AS VARCHAR) END AS failure_code FROM je)
    SELECT job_id, arg_max(status, id) FILTER (status IS NOT NULL) AS status, arg_max(attempt, id) FILTER (attempt IS NOT NULL) AS attempt,
      (list(failure_code ORDER BY id DESC))[1] AS failure_code, max(id) AS id FROM c GROUP BY ALL"""))
def snk_state_update(spark, d):
    k = F.col("k")
    changes = job_events(spark, d).select(
        "id", "job_id", F.when(k % 3 == 0, F.element_at(F.array(*[F.lit(s) for s in STATES]), k % 7 + 1)).alias("status"),
        F.when(k % 4 != 0, k).alias("attempt"), F.when(k % 5 == 0, F.concat(F.lit("CODE_"), k.cast("string"))).alias("failure_code"),
    )
    return writers.current_state(changes, "job_id", ["status", "attempt"], ["failure_code"])


@query("src_key_lookup", """
    SELECT o.o_orderkey, o_custkey, o_orderstatus, k.found FROM orders o JOIN (SELECT l_orderkey, bool_or(l_quantity >= 49) AS found FROM lineitem GROUP BY ALL) k
      ON o.o_orderkey = k.l_orderkey WHERE k.found""")
def src_key_lookup(spark, d):
    keys = table(spark, d, "lineitem").where(F.col("l_quantity") >= 49).select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    found = readers.lookup(orders, keys, "o_orderkey")
    return found.join(readers.exists(keys, orders, "o_orderkey"), "o_orderkey")


@query("src_json_columns", """
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS k,
      '{"k":' || CASE WHEN event_id % 4 = 0 THEN '-1' ELSE json_extract_string(props, '$.k') END || '}' AS dumped,
      strftime(date_trunc('second', ts) - CASE WHEN event_id % 2 = 0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M:%S') AS moment FROM events""")
def src_json_columns(spark, d):
    n = F.col("event_id")
    iso = F.concat(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(n % 2 == 0, "+02:00").otherwise("Z"))
    stored = F.when(n % 8 == 0, "").when(n % 4 != 0, F.col("props"))
    rows = table(spark, d, "events").select("event_id", readers.json_column(stored, "k int", '{"k": -1}').alias("j"), iso.alias("iso"))
    return rows.select(
        "event_id", "j.k", F.to_json("j").alias("dumped"), F.date_format(readers.iso_moment(F.col("iso")), "yyyy-MM-dd HH:mm:ss").alias("moment")
    )


@query("snk_vector_upsert", """
    SELECT vec_id AS item_id, CASE WHEN label >= 5 THEN 2 ELSE 1 END AS version,
      round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) * CASE WHEN label >= 5 THEN -1 ELSE 1 END, 5) AS total FROM embeddings""")
def snk_vector_upsert(spark, d):
    path = work_path(spark, "vectors")
    base = table(spark, d, "embeddings").select(
        F.concat(F.lit("sess_"), (F.col("label") % 4).cast("string")).alias("session_id"), F.lit("review").alias("kind"),
        F.col("vec_id").alias("item_id"), F.concat(F.lit("document "), F.col("vec_id").cast("string")).alias("document"),
        F.col("embedding").alias("vector"), F.create_map(F.lit("cluster_id"), F.col("label").cast("string")).alias("metadata"), F.lit(1).alias("version"),
    )
    writers.upsert_vectors(base, path)
    changed = base.where(F.col("metadata")["cluster_id"].cast("int") >= 5).withColumns({
        "vector": F.transform("vector", lambda x: -x), "version": F.lit(2)
    })
    writers.upsert_vectors(changed, path)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return writers.read_vectors(spark, path).select("item_id", "version", F.round(total, 5).alias("total"))


@query("snk_index_save_load", sql("asg clu", """
    SELECT session_id, count(*) AS clusters, min(r.reviews) AS reviews, 'projection' AS embedding_backend_effective, 'local' AS backend_effective
    FROM clu JOIN (SELECT session_id, count(*) AS reviews FROM asg GROUP BY ALL) r USING (session_id) GROUP BY session_id"""))
def snk_index_save_load(spark, d):
    path, asg = work_path(spark, "index"), assignments(spark, d)
    old = clusters(spark, d, asg).drop("mixed_sentiment")
    writers.save_index({"clusters": old, "reviews": asg.withColumn("backend_effective", F.lit("local"))}, path)
    index = writers.load_index(spark, path, ["clusters", "reviews"])
    counted = index["clusters"].groupBy("session_id", "embedding_backend_effective", "backend_effective").agg(F.count("*").alias("clusters"))
    return counted.join(index["reviews"].groupBy("session_id").agg(F.count("*").alias("reviews")), "session_id")


@query("snk_report", sql("clu", """
    SELECT session_id, 'report_' || session_id AS report_id, count(*) AS lines, bool_or(anomaly_flag) AS degraded_mode FROM clu GROUP BY ALL"""))
def snk_report(spark, d):
    path, found = work_path(spark, "reports"), clusters(spark, d)
    sessions = found.groupBy("session_id").agg(F.bool_or("anomaly_flag").alias("degraded_mode"))
    texts = found.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("summary")), "\n").alias("markdown"))
    summaries = sessions.select("session_id", F.lit("done").alias("executive_summary"))
    writers.write_reports(report.artifacts(sessions, summaries, texts, F.lit("2024-06-01 00:00:00").cast("timestamp")), path)
    lines = F.size(F.split("markdown", "\n")).cast("bigint")
    return writers.read_sessions(spark, path).select("session_id", "report_id", lines.alias("lines"), "degraded_mode")
