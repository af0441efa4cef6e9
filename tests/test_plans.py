"""Workflows on small frames: preparation, themes, decisions, answers, report, streaming."""

import pytest
from pyspark.sql import functions as F

from chorale.operators import clustering, decisions, gates, ranking, search, themes, trends
from chorale.plans import answers, evals, prepare, report
from chorale.session import work_path
from chorale.sources import readers, writers

RAW = "session_id string, raw_index bigint, review_id string, source string, text string, created_at string, rating string, language string, app_version string, ingested_from string"


def raw(spark, texts, session="s1"):
    rows = [(session, i, f"r{i}", "App Store", t, f"2024-01-{1 + i % 28:02d}", "4", "", "1.0", "f.csv") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, RAW)


def run_ts():
    return F.lit("2024-06-01").cast("timestamp")


def test_copies_are_found_after_masking_and_counted(spark):
    batch = raw(spark, ["Write to a@b.example today please", "write to c@d.example  today PLEASE", "Another review about crashes", "hi"])
    kept, counters, failed = prepare.prepare(batch, run_ts())
    assert [r["review_id"] for r in kept.orderBy("raw_index").collect()] == ["r0", "r2", "r3"]
    row = counters.first()
    assert (row["total_records"], row["kept_records"], row["duplicate_records"], row["pii_hits"]) == (4, 3, 1, 2)
    assert row["low_information_records"] == 1 and failed.count() == 0
    first = kept.where("review_id = 'r0'").first()
    assert first["source"] == "app_store" and first["rating"] == 4 and first["text_anonymized"] == "Write to [EMAIL] today please"
    assert "pii_found" in first["flags"] and first["metadata"]["raw_index"] == 0


def test_preparing_twice_and_other_partitionings_change_nothing(spark):
    batch = raw(spark, [f"Review number {i % 7} with some words" for i in range(40)])
    results = []
    for df in (batch.coalesce(1), batch.repartition(8)):
        kept, counters, _ = prepare.prepare(df, run_ts())
        results.append((sorted(map(str, kept.collect())), counters.collect()))
    assert results[0] == results[1]
    kept = prepare.prepare(batch, run_ts())[0]
    again = kept.select("session_id", "raw_index", "review_id", "source", F.col("text_anonymized").alias("text"), F.lit("2024-01-01").alias("created_at"),
                        F.lit("").alias("rating"), F.lit("").alias("language"), F.lit("").alias("app_version"), F.lit("f").alias("ingested_from"))
    assert prepare.prepare(again, run_ts())[0].count() == kept.count() == 7


def test_stored_table_gives_the_same_rows(spark):
    batch = raw(spark, ["first long enough review", "second long enough review", "first long enough review"])
    plain = prepare.prepare(batch, run_ts())[0].select("review_id", "dedupe_hash")
    stored = prepare.prepare(batch, run_ts(), store=work_path(spark, "parsed"))[0].select("review_id", "dedupe_hash")
    assert sorted(plain.collect()) == sorted(stored.collect())


def test_missing_fields_fail_the_session_only(spark):
    batch = raw(spark, ["good review text here", "  "], "bad").unionByName(raw(spark, ["another good review text"], "ok"))
    kept, _, failed = prepare.prepare(batch, run_ts())
    assert [r["session_id"] for r in kept.collect()] == ["ok"]
    assert [(r["session_id"], r["code"]) for r in failed.collect()] == [("bad", "INPUT_SCHEMA_INVALID")]
    with pytest.raises(Exception, match="INPUT_SCHEMA_INVALID"):
        gates.required_strict(batch).collect()


def test_privacy_gate_is_strict(spark):
    rows = spark.createDataFrame([("a", f"r{i}", i == 0) for i in range(20)] + [("b", f"r{i}", i < 2) for i in range(20)], "session_id string, review_id string, residual boolean")
    totals = rows.groupBy("session_id").agg(F.count("*").alias("total_records"))
    kept, failed = gates.privacy_gate(rows, totals)
    assert kept.groupBy("session_id").count().collect() == [("a", 19)]
    assert [r["session_id"] for r in failed.collect()] == ["b"]


def weekly(spark, counts):
    rows = [(k, f"2024-W{w:02d}", n) for k, series in counts.items() for w, n in enumerate(series)]
    return spark.createDataFrame(rows, "cluster_id string, week_key string, n bigint")


def test_spike_rule(spark):
    found = trends.spike_alerts(trends.history(weekly(spark, {
        "spike": [4, 5, 4, 5, 12], "flat": [4, 4, 4, 4, 4], "short": [1, 9, 30], "drop": [9, 8, 9, 1], "mild": [10, 10, 10, 12],
    }), ["cluster_id"]))
    got = {r["cluster_id"]: r for r in found.collect()}
    assert set(got) == {"spike", "short", "mild"}
    assert got["spike"]["severity"] == "high" and got["spike"]["spike_ratio"] == pytest.approx(2.667)
    assert got["spike"]["reason"] == "Latest week count 12 exceeded baseline threshold 5.50."
    assert got["short"]["insufficient_history"] and got["mild"]["severity"] == "medium"


def test_trend_and_zero_fill(spark):
    base = weekly(spark, {"up": [1, 1, 4], "one": [5]})
    got = {r["cluster_id"]: r["trend_delta"] for r in trends.trends(base, ["cluster_id"]).collect()}
    assert got == {"up": 3.0, "one": 0.0}
    gap = base.where("NOT (cluster_id = 'up' AND week_key = '2024-W01')").unionByName(weekly(spark, {"all": [1, 1, 1]}))
    filled = {(r["cluster_id"], r["week_key"]): r["n"] for r in trends.zero_filled(gap, ["cluster_id"]).collect()}
    assert filled[("up", "2024-W01")] == 0 and ("one", "2024-W01") not in filled


CLUSTER = "session_id string, cluster_id string, label string, summary string, size bigint, sentiment_score double, trend_delta double, priority_score double, confidence string, degraded_reason string, keywords array<string>, sources array<string>, top_quote_ids array<string>, anomaly_flag boolean, weak boolean"


def cluster_rows(spark):
    rows = [
        ("s", "pay_1", "Payment crash", "checkout payment crash", 6, -0.5, 1.0, 0.9, "high", None, ["payment", "crash"], ["web"], ["r1", "r2"], False, False),
        ("s", "pay_2", "Payment errors", "payment errors at checkout", 2, -0.2, 0.0, 0.3, "low", "weak_signals_mode", ["payment", "error"], ["nps"], ["r2", "r3"], True, True),
        ("s", "dark_3", "Dark theme", "asks for dark theme", 3, 0.6, 0.2, 0.4, "medium", None, ["dark"], ["web"], ["r4"], False, False),
    ]
    return spark.createDataFrame(rows, CLUSTER)


def test_merges_respect_guard_and_order(spark):
    clusters = cluster_rows(spark)
    pairs = spark.createDataFrame(
        [("s", 1, "pay_1", "dark_3"), ("s", 2, "pay_2", "pay_1"), ("s", 3, "pay_2", "dark_3"), ("s", 4, "pay_1", "gone"), ("s", 5, "pay_1", "pay_1")],
        "session_id string, ord int, left_id string, right_id string",
    )
    merges = decisions.accepted_merges(decisions.guarded_pairs(pairs, clusters))
    assert [(m["primary_id"], m["secondary_id"]) for m in merges.collect()] == [("pay_1", "pay_2")]
    merged = {r["cluster_id"]: r for r in decisions.merge_clusters(clusters, merges).collect()}
    assert set(merged) == {"pay_1", "dark_3"} and merged["pay_1"]["size"] == 8
    assert merged["pay_1"]["sentiment_score"] == pytest.approx(-0.425) and merged["pay_1"]["confidence"] == "low"
    assert merged["pay_1"]["top_quote_ids"] == ["r1", "r2", "r3"] and merged["pay_1"]["keywords"] == ["payment", "crash", "error"]
    assert merged["pay_1"]["degraded_reason"] == "weak_signals_mode; llm_merge_review" and merged["pay_1"]["anomaly_flag"]
    moved = decisions.remapped(spark.createDataFrame([("s", "pay_2", "r3")], "session_id string, cluster_id string, review_id string"), merges)
    assert moved.first()["cluster_id"] == "pay_1"


def test_flag_decisions(spark):
    reviews = spark.createDataFrame([("s", "a", ["spam", "pii_found"]), ("s", "b", ["low_information"]), ("s", "c", ["spam"])], "session_id string, review_id string, flags array<string>")
    table = spark.createDataFrame([("s", "a", "false", "true", "true", " ok "), ("s", "b", "true", "true", "maybe", "")], "session_id string, review_id string, keep_spam string, keep_injection string, keep_low_information string, note string")
    done = decisions.flag_decisions(reviews, table)
    got = {r["review_id"]: (r["flags"], r["note"]) for r in done.collect()}
    assert got == {"a": (["pii_found"], "ok"), "b": (["low_information"], None), "c": (["spam"], None)}
    assert decisions.flag_decision_counts(done).first()[1:] == (2, 1)


def test_roll_up_counts_every_review_once(spark):
    rows = [("s", f"c{i % 3}", i, f"r{i}", "web" if i % 2 else "nps", f"2024-01-{1 + i:02d}", "mixed" if i == 4 else "en", (i - 5) / 10) for i in range(20)]
    df = spark.createDataFrame(rows, "session_id string, cluster_id string, raw_index int, review_id string, source string, created_at string, language string, sentiment double").withColumn("created_at", F.to_timestamp("created_at"))
    rolled = themes.rollup(themes.weekly_stats(df)).collect()
    assert sum(r["size"] for r in rolled) == 20 and {r["total"] for r in rolled} == {20}
    for r in rolled:
        own = [x for x in rows if x[1] == r["cluster_id"]]
        assert r["sentiment_score"] == pytest.approx(sum(x[7] for x in own) / len(own), abs=1e-4)
        assert r["mixed_language"] == any(x[6] == "mixed" for x in own)


def index(spark):
    reviews = spark.createDataFrame(
        [("s", i, f"r{i}", c, f"text {i} of {c}", "web", "2024-01-01", s) for i, (c, s) in enumerate([("pay_1", -0.5), ("pay_1", 0.9), ("pay_2", 0.1), ("dark_3", 0.3)])],
        "session_id string, raw_index int, review_id string, cluster_id string, text string, source string, created_at string, sentiment double",
    )
    sections = spark.createDataFrame([("s", "executive_summary", "All is well.")], "session_id string, section_name string, text string")
    return {**search.build_index(cluster_rows(spark), reviews), "reviews": reviews, "sections": sections}


def test_answers_cover_every_intent(spark):
    asked = spark.createDataFrame([
        ("q1", "s", "What about the payment crash?"), ("q2", "s", "Compare dark theme vs payment trend"),
        ("q3", "s", "top priority in the report"), ("q4", "s", "   "),
    ], "question_id string, session_id string, question string")
    got = {r["question_id"]: r for r in answers.answer(asked, index(spark)).collect()}
    assert set(got) == {"q1", "q2", "q3"}
    assert got["q1"]["cluster_hits"][0]["cluster_id"] == "pay_1" and "Trend view" not in got["q1"]["answer"]
    tools = lambda q: [t["tool"] for t in got[q]["tool_trace"]]
    assert tools("q2") == ["search_clusters", "compare_clusters", "get_quotes", "get_quotes", "get_trend", "get_trend"]
    assert "Comparison: " in got["q2"]["answer"] and "Trend view: " in got["q2"]["answer"]
    assert tools("q3")[0] == "top_clusters" and tools("q3")[-1] == "get_report_section"
    assert "Report context: All is well." in got["q3"]["answer"]
    assert got["q3"]["cluster_hits"][0]["cluster_id"] == "pay_1"


def test_tool_batch_reports_failures(spark):
    asked = spark.createDataFrame([("q1", "s", "top priority?"), ("q2", "s", "dark theme")], "question_id string, session_id string, question string")
    calls = spark.createDataFrame([("q2", "s", 0, 1, "get_trend", '{"cluster_id": "none"}'), ("q2", "s", 0, 2, "get_quotes", '{"cluster_id": "pay_1", "limit": 99}'), ("q2", "s", 0, 3, "top_clusters", "{}")], "question_id string, session_id string, step int, ord int, tool string, arguments string")
    done = answers.run_calls(answers.normalized_calls(calls, asked), index(spark))
    got = {(r["question_id"], r["tool"]): r["summary"] for r in done.collect()}
    assert got == {
        ("q1", "top_clusters"): "Selected 3 highest-priority clusters.",
        ("q2", "get_trend"): "Tool failed with NO_EVIDENCE_AVAILABLE: No trend data for cluster none.",
        ("q2", "get_quotes"): "Loaded 2 supporting quotes for pay_1.",
    }


def test_report_lists_themes_quotes_and_alerts(spark):
    ix = index(spark)
    sessions = spark.createDataFrame([("s", "Short summary.", False, True, 4, 4, 0, 0, 0, 0, 0.4, "kmeans", "kmeans_3", 6, 1, 0, 0, None)], """
        session_id string, executive_summary string, degraded_mode boolean, low_data_mode boolean, total_records int, kept_records int, duplicate_records int,
        quarantined_records int, injection_hits int, low_information_records int, quality_score double, clustering_backend string, clustering_profile string,
        attempt_count int, weak_signal_cluster_count int, mixed_sentiment_cluster_count int, mixed_language_review_count int, degraded_reason string""")
    quotes = spark.createDataFrame([("s", "pay_1", ["it crashed"])], "session_id string, cluster_id string, quotes array<string>")
    alerts = spark.createDataFrame([("s", "pay_1", "a1", "high", "Grew.", 2.5, False), ("s", "dark_3", "a2", "info", "insufficient_history", None, True)],
                                   "session_id string, cluster_id string, alert_id string, severity string, reason string, spike_ratio double, insufficient_history boolean")
    listed = ix["reviews"].withColumn("language", F.lit("en")).withColumn("created_at", F.to_date("created_at"))
    lines = report.markdown(sessions, ix["clusters"], quotes, alerts, listed).first()["markdown"].split("\n")
    assert lines[0] == "# Feedback report for s" and lines[4] == "Short summary." and "- `r0` [web] 2024-01-01 `en` :: text 0 of pay_1" in lines
    assert "| `pay_1` | Payment crash | 6 | 0.90 | -0.50 | 1.00 | high |" in lines
    assert lines.index("## Top Themes") < lines.index("## Theme Detail") < lines.index("## Weak Signals") < lines.index("## Alerts") < lines.index("## Notes") < lines.index("## Run Diagnostics")
    assert "- `pay_1` [high] Grew. Spike ratio: 2.50." in lines and '  - "it crashed"' in lines
    assert "- `pay_2` Payment errors: payment errors at checkout" in lines


def test_profile_choice(spark):
    rows = [("s", 1, "density", "d1", 0.2, 5), ("s", 2, "density", "d2", 0.5, 4), ("s", 3, "density", "d3", 0.9, 4), ("s", 4, "sweep", "k3", 0.5, 3),
            ("t", 1, "density", "d1", 0.1, 5), ("t", 4, "sweep", "k3", 0.2, 3), ("u", 1, "density", "d1", -0.1, 1)]
    got = {r["session_id"]: r for r in clustering.selected_profile(spark.createDataFrame(rows, "session_id string, ord int, backend string, profile_name string, quality_score double, cluster_count bigint")).collect()}
    assert got["s"]["profile_name"] == "d2" and got["s"]["quality_gate_passed"]
    assert got["t"]["profile_name"] == "k3" and got["u"]["profile_name"] == "one_cluster"


def test_upload_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿review_id,source,text,created_at\n1,web,"two\nlines, ""quoted""",2024-01-01\n'.encode())
    (tmp_path / "b.json").write_text('[{"review_id": 2, "source": "web", "text": "x", "created_at": "2024-01-01", "rating": 5}]')
    (tmp_path / "c.json").write_text('{"reviews": [{"review_id": "3", "source": "web", "text": "y", "created_at": "2024-01-01"}]}')
    (tmp_path / "d.json").write_text('{"other": 1}')
    (tmp_path / "e.txt").write_text("no")
    records, refused = readers.read_feedback(spark, str(tmp_path))
    got = {r["review_id"]: r for r in records.collect()}
    assert set(got) == {"1", "2", "3"} and got["1"]["text"] == 'two\nlines, "quoted"' and got["2"]["rating"] == "5"
    assert sorted(r["ingested_from"].rsplit("/", 1)[1] for r in refused.collect()) == ["d.json", "e.txt"]


def test_scan_orders_and_missing_index(spark):
    alerts = spark.createDataFrame([("s", 1, "high"), ("s", 1, "medium"), ("s", 2, "info")], "session_id string, created_at int, severity string")
    assert [r["severity"] for r in readers.session_scan(alerts, "s", "alerts").collect()] == ["info", "medium", "high"]
    with pytest.raises(FileNotFoundError, match="INDEX_NOT_FOUND"):
        writers.load_index(spark, work_path(spark, "none"), ["clusters"])


def test_hot_group_sends_k_rows_per_task(spark):
    """The top-k plan limits groups before the shuffle."""
    df = spark.range(1000).select((F.col("id") % 3).alias("session_id"), F.col("id").alias("v"))
    plan = ranking.top_k(df, ["session_id"], [F.col("v").desc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_evals(spark):
    texts = spark.createDataFrame([("s", "ok [EMAIL]"), ("t", "mail a@b.example"), ("t", "fine")], "session_id string, text string")
    got = {r["session_id"]: r["passed"] for r in evals.leak_check(texts).collect()}
    assert got == {"s": True, "t": False}
    assert evals.verdict(evals.leak_check(texts)).first()[:] == (2, 1, False)
