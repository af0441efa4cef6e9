"""Tables replaced by key: versions, crashes, schemas, folders."""

import os
import re

import pytest
from pyspark.sql import functions as F

from chorale.session import work_path
from chorale.sources import store, writers


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_folders_follow_buckets_not_sessions(spark):
    path = work_path(spark, "store")
    rows = spark.range(3000).select(F.concat(F.lit("s"), F.col("id") % 1000).alias("session_id"), "id")
    assert store.commit(path, {"rows": rows}, ["session_id"], buckets=8) == 1
    folders = os.listdir(f"{path.removeprefix('file:')}/data/part=rows/store_version=1")
    assert sorted(f for f in folders if "=" in f) == [f"store_bucket={b}" for b in range(8)]
    one = store.read(spark, path, session_id="s7")
    assert rows_of(one) == [("s7", 7), ("s7", 1007), ("s7", 2007)]
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = store.read(spark, path, session_id="s7")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "store_version" in filters and re.search(r"store_bucket#\d+ = \d", filters)  # the other buckets are pruned
    store.commit(path, {"rows": rows.where("session_id = 's7'").withColumn("id", -F.col("id"))}, ["session_id"])
    assert len([f for f in os.listdir(f"{path.removeprefix('file:')}/data/part=rows/store_version=2") if "=" in f]) == 1
    assert rows_of(store.read(spark, path, session_id="s7")) == [("s7", -2007), ("s7", -1007), ("s7", -7)]
    assert store.read(spark, path).count() == 3000
    with pytest.raises(ValueError, match="is stored by"):
        store.read(spark, path, id="7")


def test_a_crash_between_parts_leaves_the_old_version(spark):
    path = work_path(spark, "store")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, n int")
    store.commit(path, {"x": first, "y": first}, ["session_id"])
    second = first.withColumn("n", F.col("n") * 10)
    broken = second.withColumn("n", F.when(F.col("n") < 100, F.raise_error(F.lit("stopped")).cast("int")))
    with pytest.raises(Exception, match="stopped"):
        store.commit(path, {"x": second, "y": broken}, ["session_id"])
    assert store.manifest(spark, path)[0] == 1
    assert os.path.exists(f"{path.removeprefix('file:')}/data/part=x/store_version=2")  # x was written, yet
    assert rows_of(store.read(spark, path, "x")) == rows_of(store.read(spark, path, "y")) == [("a", 1), ("b", 2)]
    changed = second.where("session_id = 'b'")
    assert store.commit(path, {"x": changed, "y": changed}, ["session_id"]) == 2  # writes over what was left
    assert rows_of(store.read(spark, path, "x")) == rows_of(store.read(spark, path, "y")) == [("a", 1), ("b", 20)]


def test_null_empty_and_cleared_keys(spark):
    path = work_path(spark, "store")
    rows = spark.createDataFrame([(None, 1), ("", 2), ("a", 3), ("a", 3)], "session_id string, n int")
    for _ in range(2):  # a repeated commit leaves the same rows, repeated ones included
        writers.replace_sessions(rows, path)
        assert store.read(spark, path).count() == 4
    writers.replace_sessions(rows.where("session_id IS NULL").withColumn("n", F.lit(9)), path)
    assert {tuple(r) for r in store.read(spark, path).collect()} == {(None, 9), ("", 2), ("a", 3)}
    writers.replace_sessions(rows.limit(0), path, cleared=rows.where("session_id = 'a'"))
    assert {tuple(r) for r in store.read(spark, path).collect()} == {(None, 9), ("", 2)}
    empty = work_path(spark, "store")
    writers.replace_sessions(rows.limit(0), empty)
    assert writers.read_sessions(spark, empty).columns == ["session_id", "n"] and writers.read_sessions(spark, empty).count() == 0
    with pytest.raises(FileNotFoundError, match="PART_NOT_FOUND"):
        store.read(spark, path, "other")


def test_columns_may_come_but_not_change(spark):
    path = work_path(spark, "store")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, n int")
    writers.replace_sessions(rows, path)
    writers.replace_sessions(rows.where("session_id = 'b'").withColumn("more", F.lit("m")), path)
    assert {tuple(r) for r in writers.read_sessions(spark, path).collect()} == {("a", 1, None), ("b", 2, "m")}
    with pytest.raises(ValueError, match="STORE_TYPE_CHANGED: rows.n"):
        writers.replace_sessions(rows.withColumn("n", F.lit("text")), path)
    with pytest.raises(ValueError, match="own columns"):
        writers.replace_sessions(rows.withColumn("store_bucket", F.lit(1)), path)


def test_items_keep_their_newest_version(spark):
    path = work_path(spark, "vectors")
    make = lambda *rows: spark.createDataFrame(rows, "session_id string, kind string, item_id long, version int, vector array<float>")
    writers.upsert_vectors(make(("s", "review", 1, 1, [1.0]), ("s", "review", 2, 1, [2.0]), ("t", "review", 1, 1, [3.0])), path)
    for _ in range(2):
        writers.upsert_vectors(make(("s", "review", 1, 2, [-1.0]), ("s", "cluster", 1, 1, [5.0]), ("t", "review", 1, 0, [7.0])), path)
    got = {(r.session_id, r.kind, r.item_id): (r.version, r.vector) for r in writers.read_vectors(spark, path).collect()}
    assert got == {
        ("s", "review", 1): (2, [-1.0]), ("s", "review", 2): (1, [2.0]), ("s", "cluster", 1): (1, [5.0]), ("t", "review", 1): (1, [3.0]),
    }


def test_superseded_versions_go(spark):
    path = work_path(spark, "store")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, n int")
    assert store.drop_superseded(spark, path) == []
    for n in range(4):
        writers.replace_sessions(rows.withColumn("n", F.lit(n)), path)
    before = store.read(spark, path)
    writers.replace_sessions(rows.where("session_id = 'a'"), path)
    removed = store.drop_superseded(spark, path)
    assert len(removed) == 6  # data and manifests of the first three
    assert rows_of(before) == [("a", 3), ("b", 3)] and rows_of(store.read(spark, path)) == [("a", 1), ("b", 3)]
