"""Cases that once lost data or failed: wide files, large k, text-like ids, large counts, copies of points."""

import math

from pyspark.sql import functions as F

from chorale.functions import privacy
from chorale.operators import clustering, ranking, similarity, trends
from chorale.session import work_path
from chorale.sources import readers, writers


def test_wide_csv_keeps_every_named_column(spark, tmp_path):
    names = ["review_id", "source", "text", "created_at"] + [f"extra{i}" for i in range(70)] + ["rating"]
    cells = ["r1", "web", "\"a, b\"", "2024-01-01"] + ["x"] * 70 + ["4"]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join(cells) + "\n")
    late = names[4:] + names[:4]
    (tmp_path / "late.csv").write_text(",".join(late) + "\n" + ",".join(cells[4:] + cells[:4]) + "\n")
    records, rejected = readers.read_csv(spark, str(tmp_path))
    assert [(r["text"], r["rating"]) for r in records.collect()] == [("a, b", "4")] * 2 and rejected.count() == 0


def test_no_quota_unless_asked(spark):
    rows = spark.range(5000).select(F.lit("s").alias("session_id"), F.lit(10_000).alias("size"))
    uploads = spark.createDataFrame([("s",), ("none",)], "session_id string")
    code = lambda **k: {r["session_id"]: r["code"] for r in readers.input_limits(rows, uploads, F.col("size"), **k).collect()}
    assert code() == {"s": "ACCEPTED", "none": "INPUT_SCHEMA_INVALID"}
    assert code(max_rows=2000)["s"] == code(max_bytes=10)["s"] == "INPUT_LIMIT_EXCEEDED"


def test_top_k_honours_k(spark):
    rows = spark.range(40).select(F.lit("s").alias("session_id"), F.col("id").cast("string").alias("cluster_id"), F.col("id").alias("size"), (F.col("id") / 7).alias("priority_score"))
    assert ranking.top_clusters(rows, 25).count() == 25


def test_sessions_that_look_like_numbers_stay_apart(spark):
    rows = spark.createDataFrame([("001", 1), ("1", 2), ("2024-01-01", 3)], "session_id string, n int")
    path = work_path(spark, "ids")
    writers.replace_sessions(rows, path)
    assert {(r["session_id"], r["n"]) for r in writers.read_sessions(spark, path).collect()} == {("001", 1), ("1", 2), ("2024-01-01", 3)}


def test_a_retried_append_adds_nothing(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "stage string, n int")
    path = work_path(spark, "log")
    for batch in ("0", "1", "1"):
        writers.append_log(rows, path, "stage", batch)
        writers.append_trace(rows, path + "-trace", batch)
    assert writers.read_table(spark, path).count() == 4 and spark.read.json(path + "-trace").count() == 4


def test_large_counts_keep_their_spike(spark):
    n = 167_760_436
    weeks = [("big", f"2024-W{w:02d}", n) for w in range(1, 10)] + [("big", "2024-W10", n * 3 // 2)]
    weeks += [("huge", f"2024-W{w:02d}", 4_000_000_000 + w % 2) for w in range(1, 10)]
    weekly = spark.createDataFrame(weeks, "cluster_id string, week_key string, n long")
    past = trends.history(weekly, ["cluster_id"])
    rows = {r["cluster_id"]: r for r in past.collect()}
    assert rows["big"]["baseline_std"] == 0.0 and math.isclose(rows["huge"]["baseline_std"], 0.5, rel_tol=1e-9)
    assert [a["type"] for a in trends.spike_alerts(past).where("cluster_id = 'big'").collect()] == ["ANOMALY_SPIKE"]
    prior = trends.prior_week_stats(weekly, ["cluster_id"]).where("week_key = '2024-W05'").collect()
    assert all(not math.isnan(r["prior_std"]) for r in prior)


def test_copies_of_a_point_under_two_labels(spark):
    rows = spark.createDataFrame([(i, i % 2, [1.0, 0.0]) for i in range(4)] + [(4, 2, [0.0, 1.0])], "item_id int, label int, vector array<double>")
    exact = similarity.silhouette_exact(rows.withColumn("g", F.lit(0)), ["g"], "label")
    assert {r["silhouette"] for r in exact.where("item_id < 4").collect()} == {0.0}
    assert similarity.silhouette_linear(rows.withColumn("g", F.lit(0)), ["g"], "label").first()["quality_score"] == 0.0


def test_masks_of_one_session_leave_another_alone(spark):
    reviews = spark.createDataFrame([("a", "r1", "en", "Ann is slow", 0), ("b", "r1", "en", "Payment is slow", 0)], "session_id string, review_id string, language string, masked string, pii_hits int")
    spans = spark.createDataFrame([("a", "r1", "en", 0, 3, "PERSON", "Ann")], "session_id string, review_id string, model string, start int, end int, label string, text string")
    got = {r["session_id"]: (r["masked"], r["pii_hits"]) for r in privacy.with_person_pipeline(reviews, spans).collect()}
    assert got == {"a": ("[PERSON] is slow", 1), "b": ("Payment is slow", 0)}


def test_mode_thresholds_are_arguments(spark):
    rows = spark.createDataFrame([("s", 40, 0.5)], "session_id string, reviews int, quality_score double")
    assert clustering.run_mode(rows).first()["degraded_mode"] is False
    assert clustering.run_mode(rows, low_data_rows=50).first()["low_data_mode"] is True


def test_reports_read_the_assigned_reviews_once_and_store_no_parsed_texts(spark, tmp_path, monkeypatch):
    from chorale.catalog import retrieval, views

    rows = [(i, f"the payment of {i % 9} crashes and fails", "en", "web", 12 * (i % 4)) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    frames, settled, again = {}, retrieval.settled, []

    def record(df, label):
        frames[label] = settled(df, label)
        return frames[label]

    monkeypatch.setattr(retrieval, "settled", record)
    monkeypatch.setattr(views, "assignments", lambda *a, f=views.assignments: again.append(1) or f(*a))
    found = retrieval.rpt_session_detail(spark, str(tmp_path)).collect()
    assert sum(r.total_records for r in found) == 60
    assert "parsed" not in frames and "text" not in frames["assignments"].columns
    assert not again  # alerts and themes take the stored ones
