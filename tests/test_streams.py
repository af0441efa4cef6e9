"""Streams: bounded batches, crashes after a write, gates over uploads, late rows, alerts of changed keys."""

import datetime as dt
import os
import time

from pyspark.sql import functions as F

from chorale.catalog import streams
from chorale.catalog.views import RUN_TS
from chorale.operators import trends
from chorale.plans import prepare
from chorale.session import work_path
from chorale.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def test_a_crash_after_a_write_changes_nothing(spark):
    run_ts = F.lit(RUN_TS).cast("timestamp")
    whole = work_path(spark, "whole")
    jobs.ingest(streams.uploads(spark, SMALL), run_ts, whole, work_path(spark, "state")).awaitTermination()
    want = {tuple(r) for r in jobs.ingested(spark, whole)[0].select(*streams.INGESTED).collect()}
    folders = lambda path: [x for x in os.listdir(path.removeprefix("file:")) if "=" in x]
    assert folders(whole) == ["batch=0"]  # a batch is bounded by its size: folders follow batches, not sessions
    out, state, seen = work_path(spark, "crashed"), work_path(spark, "state"), []

    def crash(number):
        seen.append(number)
        if number == 1:
            raise RuntimeError("stopped")

    stream = streams.uploads(spark, SMALL, per_batch=6)
    try:
        jobs.ingest(stream, run_ts, out, state, after=crash).awaitTermination()
    except Exception as error:
        assert "stopped" in str(error)
    assert seen == [0, 1]
    jobs.ingest(stream, run_ts, out, state, after=seen.append).awaitTermination()
    assert seen[2] == 1 and len(folders(out)) == len(set(seen)) > 2  # the second batch ran again, in place
    assert {tuple(r) for r in jobs.ingested(spark, out)[0].select(*streams.INGESTED).collect()} == want


def files(spark, batches, schema):
    """One file a batch, read oldest first."""
    path = work_path(spark, "arrivals")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return jobs.file_stream(spark, path, spark.createDataFrame([], schema).schema, per_batch=1)


RAW = ["session_id", "raw_index", "review_id", "source", "text", "created_at", "rating", "language", "app_version", "ingested_from"]


def test_batch_and_stream_fail_the_same_sessions(spark):
    def row(session, number, text):
        return (session, number, f"r{number}", "app_store", text, "2024-05-01", "4", "en", "5.1", f"{session}.csv")

    first = [
        row("good", 0, "the export works well now"), row("good", 1, "login code arrives late"),
        row("broken", 0, "fine so far today"), row("empty", 0, "reach 4111 1111 1111 1111 22"),
    ]
    second = [row("good", 2, "the export works well now"), row("broken", 1, "  "), row("late", 0, "dark theme please")]
    schema = ", ".join(f"{c} {'int' if c == 'raw_index' else 'string'}" for c in RAW)
    run_ts = F.lit(RUN_TS).cast("timestamp")
    out = work_path(spark, "gated")
    jobs.ingest(files(spark, [first, second], schema), run_ts, out, work_path(spark, "state")).awaitTermination()
    as_sets = lambda frames: [{tuple(r[c] for c in sorted(f.columns) if c != "metadata") for r in f.select(*[
        F.array_join(c, ",").alias(c) if c == "flags" else F.col(c) for c in f.columns]).collect()} for f in frames]
    got = as_sets(jobs.ingested(spark, out))
    assert got == as_sets(prepare.prepare(spark.createDataFrame(first + second, schema), run_ts))
    failed = {r["session_id"]: r["code"] for r in jobs.ingested(spark, out)[2].collect()}
    assert failed["broken"] == "INPUT_SCHEMA_INVALID" and "good" not in failed and "late" not in failed


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)  # a Monday


def test_late_rows_count_within_the_delay(spark):
    schema = "key string, moment timestamp"
    stream = files(spark, [
        [("a", day(1)), ("a", day(8)), ("b", day(1))], [("a", day(30))],
        [("a", day(25))],  # in an open week; this batch closes the first two weeks
        [("a", day(2)), ("a", day(31)), (None, day(31))],  # the first is in a closed week
    ], schema)
    out = work_path(spark, "weekly")
    query = jobs.keep_current(jobs.weekly_counts(stream, ["key"], "moment", "7 days"), ["key", "week_start"], out, work_path(spark, "state"))
    query.awaitTermination()
    got = {(r["key"], (r["week_start"] - day(0)).days): r["n"] for r in jobs.current(spark, out).collect()}
    assert got == {("a", 0): 1, ("a", 7): 1, ("b", 0): 1, ("a", 21): 1, ("a", 28): 2, (None, 28): 1}
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) <= 4 and states[-1] <= 3  # closed weeks leave the state
    kept = os.listdir(f"{out.removeprefix('file:')}/manifest")
    assert len([f for f in kept if "=" in f]) == 2  # superseded ones are removed


def test_alerts_follow_the_keys_that_change(spark):
    schema = "cluster_id string, moment timestamp"
    steady = [("x", day(7 * w)) for w in range(5)] + [("y", day(7 * w)) for w in range(5)]
    batches = [steady, [("x", day(36))] * 6, [("y", day(37))], [("z", day(38))] * 2, [("x", day(43))]]
    out, rule = work_path(spark, "alerts"), {"min_weeks": 2}
    weekly = jobs.weekly_counts(files(spark, batches, schema), ["cluster_id"], "moment", "60 days")
    jobs.spike_alerts(weekly, ["cluster_id"], out, work_path(spark, "state"), **rule).awaitTermination()
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    weeks = whole.groupBy("cluster_id", F.window("moment", jobs.WEEK, jobs.WEEK, jobs.MONDAY)["start"].alias("week_start")).agg(F.count("*").alias("n"))
    want = trends.spike_alerts(trends.history(weeks, ["cluster_id"], "week_start"), name="cluster_id", **rule)
    rows = jobs.current(spark, f"{out}/alerts")
    assert {tuple(r) for r in rows.select(*want.columns).collect()} == {tuple(r) for r in want.collect()}
    assert {r["cluster_id"] for r in rows.collect()} == {"z"}  # x had a spike, and lost it with its next quiet week
    from chorale.sources import store
    judged = {r["cluster_id"]: r["batch"] for r in store.read(spark, f"{out}/alerts").collect()}
    assert judged == {"z": 3}  # not judged again by the batch that changed x
