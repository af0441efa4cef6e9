"""k-means for many numbers of clusters and all sessions at once.

A session's points are packed into blocks of bounded size, written once. A Lloyd round is one pass over the
blocks: each meets the centroids of its session for every k, a small table, and returns a sum a cluster;
rounds depend neither on the number of sessions nor on that of ks. Centroids start at the points of a farthest-first
traversal (the first one nearest to the session's mean; ties by the smallest item), so the first k of them
serve every k and a run depends on the points alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorale.operators.attach import fresh
from chorale.session import settled

BLOCK_ROWS, ROUNDS, FEWEST = 4096, 10, 3


def blocks(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """session_id, n (points of the session), items, cells: the points of a session in blocks of about ``block_rows``.

    Points without a vector, or with an entry that is no number, take no part.
    """
    item = dict(points.dtypes)["item_id"]
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = points.select("session_id", "item_id", F.col("vector").cast("array<double>").alias("vector")).where(whole)
    sizes = usable.groupBy("session_id").agg(F.count("*").alias("n"))
    sized = usable.join(sizes, "session_id").withColumn("tile", F.pmod(F.xxhash64("item_id"), F.ceil(F.col("n") / block_rows).cast("long")))
    session = dict(points.dtypes)["session_id"]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item_id")
        cells = np.stack(frame["vector"].to_list()).astype(np.float64)
        return pd.DataFrame({
            "session_id": [frame["session_id"].iloc[0]], "n": [frame["n"].iloc[0]], "items": [frame["item_id"].to_numpy()], "cells": [cells.tobytes()],
        })

    packed = sized.groupBy("session_id", "tile").applyInPandas(pack, f"session_id {session}, n long, items array<{item}>, cells binary")
    return settled(packed, "sweep-blocks")


def _matrix(cells: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(cells, np.float64).reshape(rows, -1)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * (x @ centres.T), 0.0)


def _over(met: DataFrame, columns: str, emit) -> DataFrame:
    """The rows of ``columns`` that ``emit(session, items, matrix, centres, ks)`` gives for every block.

    ``met``: blocks with the ``ks`` and ``centres`` of their session, see :func:`_packed`.
    """
    kinds = _arrow(columns)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                items, ks = batch.column("items")[at].values, np.array(batch.column("ks")[at].as_py())
                x = _matrix(batch.column("cells")[at].as_py(), len(items))
                centres = _matrix(batch.column("centres")[at].as_py(), len(ks))
                out = list(emit(batch.column("session_id")[at].as_py(), items, x, centres, ks))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds.types)], schema=kinds)

    return met.select("session_id", "items", "cells", "ks", "centres").mapInArrow(run, columns)


def _arrow(columns: str) -> pa.Schema:
    plain = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(c.split(" ")[0], plain[c.split(" ")[1]]) for c in columns.split(", ")])


def _packed(centres: DataFrame) -> DataFrame:
    """session_id, ks, centres: the centroids (session_id, k, c, centre) of a session in one row; at most a few dozen."""

    def pack(batches):
        for batch in batches:
            centres = [np.array(c, np.float64).tobytes() for c in batch.column("centre").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(centres, pa.binary())], names=["session_id", "k", "c", "centre"])

    session = dict(centres.dtypes)["session_id"]
    flat = centres.select("session_id", "k", "c", "centre").mapInArrow(pack, f"session_id {session}, k int, c int, centre binary")
    rows = flat.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("k", "c", "centre"))).alias("all"))
    whole = F.aggregate("all", F.lit(b""), lambda s, r: F.concat(s, r["centre"]))
    return rows.select("session_id", F.col("all.k").alias("ks"), whole.alias("centres"))


def starts(points: DataFrame, max_k: int) -> DataFrame:
    """(session_id, c, centre): the first ``max_k`` points of the farthest-first traversal; ``points`` are ``blocks``."""
    session, item = dict(points.dtypes)["session_id"], dict(points.dtypes)["items"][6:-1]

    def total(batches):
        for batch in batches:
            sums = [_matrix(c.as_py(), len(i.values)).sum(0) for c, i in zip(batch.column("cells"), batch.column("items"))]
            yield pa.RecordBatch.from_arrays([batch.column("session_id"), batch.column("n"), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], names=["session_id", "n", "sums"])

    sums = points.select("session_id", "n", "items", "cells").mapInArrow(total, f"session_id {session}, n long, sums array<double>")
    mean = sums.groupBy("session_id").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"), F.max("n").alias("n"))
    chosen = mean.select("session_id", F.lit(0).alias("c"), F.transform("sums", lambda s: s / F.col("n")).alias("centre"))
    out = None
    for number in range(max_k):
        far = number > 0

        def pick(session_id, items, x, centres, ks):
            squares = _squares(x, centres).min(1)
            squares = np.round(squares, 9)  # so that ties do not hang on the order of a sum
            at = int(np.argmax(squares) if far else np.argmin(squares))
            yield session_id, float(squares[at]), items[at].as_py(), x[at]

        met = points.join(_packed(chosen.withColumn("k", F.lit(0))), "session_id")
        best = _over(met, f"session_id {session}, square double, item_id {item}, centre array<double>", pick)
        order = F.struct(F.col("square") * (-1 if far else 1), "item_id")
        one = best.groupBy("session_id").agg(F.min_by("centre", order).alias("centre")).withColumn("c", F.lit(number))
        one = settled(one.select("session_id", "c", "centre"), "sweep-start")
        out = one if out is None else out.unionByName(one)
        chosen = out
    return out


def lloyd(points: DataFrame, centres: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(session_id, k, c, centre) after ``rounds`` rounds, or once no centroid moves; one without points stays where it is."""
    session = dict(points.dtypes)["session_id"]
    schema = f"session_id {session}, k int, c int, n long, sums array<double>"

    def part(session_id, items, x, centres, ks):
        squares = _squares(x, centres)
        for k in np.unique(ks):
            near = squares[:, ks == k].argmin(1)
            for c in np.unique(near):
                mine = x[near == c]
                yield session_id, int(k), int(c), len(mine), mine.sum(0)

    for _ in range(rounds):
        sums = _over(points.join(_packed(centres), "session_id"), schema, part)
        means = sums.groupBy("session_id", "k", "c").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
        means = means.select("session_id", "k", "c", F.transform("sums", lambda s: s / F.col("n")).alias("mean"))
        moved = centres.select(*fresh(centres, centres.columns)).join(means, ["session_id", "k", "c"], "left")
        same = F.coalesce("mean", "centre")
        centres = settled(moved.select("session_id", "k", "c", same.alias("centre"), (same != F.col("centre")).alias("moves")), "sweep-centres")
        if centres.where("moves").isEmpty():
            break
        centres = centres.drop("moves")
    return centres.drop("moves")


def measured(points: DataFrame, centres: DataFrame) -> DataFrame:
    """session_id, k, c, size, inertia, silhouettes: of every cluster with points, from the final centroids.

    ``silhouettes`` is the sum of its points' squared-Euclidean silhouettes; it follows from sizes, means and square sums.
    """
    session = dict(points.dtypes)["session_id"]

    def part(session_id, items, x, centres, ks):
        squares, own = _squares(x, centres), (x * x).sum(1)
        for k in np.unique(ks):
            near = squares[:, ks == k].argmin(1)
            best = squares[:, ks == k].min(1)
            for c in np.unique(near):
                mine = near == c
                yield session_id, int(k), int(c), int(mine.sum()), x[mine].sum(0), float(own[mine].sum()), float(best[mine].sum())

    packed = _packed(centres)
    sums = _over(points.join(packed, "session_id"), f"session_id {session}, k int, c int, n long, sums array<double>, sq double, inertia double", part)
    stats = settled(sums.groupBy("session_id", "k", "c").agg(
        F.sum("n").alias("size"), vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"), F.sum("sq").alias("sq"), F.sum("inertia").alias("inertia"),
    ), "sweep-stats")

    def score(session_id, items, x, centres, ks):
        width = x.shape[1]
        centre, n, mean, sq = centres[:, :width], centres[:, width], centres[:, width + 1 : 2 * width + 1], centres[:, 2 * width + 1]
        squares, own = _squares(x, centre), (x * x).sum(1)
        gaps = np.maximum(own[:, None] - 2.0 * (x @ mean.T) + sq[None, :], 0.0)  # the mean square to each cluster's points
        for k in np.unique(ks):
            cols = np.flatnonzero(ks == k)
            near = squares[:, cols].argmin(1)
            d, size = gaps[:, cols], n[cols]
            mine = np.arange(len(x)), near
            a = d[mine] * size[near] / np.maximum(size[near] - 1, 1)
            d = np.where(size > 0, d, np.inf)
            d[mine] = np.inf
            b = d.min(1)
            most = np.maximum(a, b)
            with np.errstate(invalid="ignore"):
                value = np.where((size[near] > 1) & np.isfinite(b) & (most > 0), (b - a) / np.where(most > 0, most, 1.0), 0.0)
            for c in np.unique(near):
                yield session_id, int(k), int(c), float(value[near == c].sum())

    zeros = F.transform("centre", lambda x: F.lit(0.0))
    full = centres.join(stats, ["session_id", "k", "c"], "left").select(
        "session_id", "k", "c", F.concat(
            "centre", F.array(F.coalesce("size", F.lit(0)).cast("double")),
            F.coalesce(F.transform("sums", lambda s: s / F.col("size")), zeros), F.array(F.coalesce(F.col("sq") / F.col("size"), F.lit(0.0))),
        ).alias("centre"),
    )

    values = _over(points.join(_packed(full), "session_id"), f"session_id {session}, k int, c int, silhouettes double", score)
    total = values.groupBy("session_id", "k", "c").agg(F.sum("silhouettes").alias("silhouettes"))
    return stats.join(total, ["session_id", "k", "c"]).select("session_id", "k", "c", "size", "inertia", "silhouettes")


def labelled(points: DataFrame, centres: DataFrame, chosen: DataFrame) -> DataFrame:
    """(session_id, item_id, label) by the centroids of the session's chosen ``k``."""
    session, item = dict(points.dtypes)["session_id"], dict(points.dtypes)["items"][6:-1]

    def label(session_id, items, x, centres, ks):
        near = _squares(x, centres).argmin(1)
        yield from ((session_id, i, int(c)) for i, c in zip(items.to_pylist(), near))

    mine = centres.join(chosen.select("session_id", "k"), ["session_id", "k"], "left_semi")
    return _over(points.join(_packed(mine), "session_id"), f"session_id {session}, item_id {item}, label int", label)


def sweep(points: DataFrame, max_k: int, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels, attempts, clusters) for k = 3 .. min(max_k, max(2, n // 3)) of every session, n being its usable points.

    ``points``: session_id, item_id, vector. ``attempts``: session_id, k, profile_name, backend, quality_score (mean
    squared-Euclidean silhouette), cluster_count, noise_fraction, inertia, chosen, at_limit (k is ``max_k``: more clusters
    might be better). The first k of the highest quality above zero is chosen and gives the labels. A session without one, as
    any below nine points, has one cluster, labelled 0, and no attempt chosen. Points without a usable vector are
    labelled -1. ``clusters``: session_id, k, c, size, inertia, silhouettes of every attempt.
    """
    parts = blocks(points, block_rows)
    limit = F.least(F.lit(max_k), F.greatest(F.lit(2), F.floor(F.col("n") / 3).cast("int")))
    ks = F.when(limit >= FEWEST, F.sequence(F.lit(FEWEST), limit)).otherwise(F.array().cast("array<int>"))
    sessions = parts.groupBy("session_id").agg(F.max("n").alias("n")).select("session_id", F.explode(ks).alias("k"))
    centres = starts(parts, max_k).join(sessions, "session_id").where("c < k").select("session_id", "k", "c", "centre")
    centres = lloyd(parts, centres, rounds)
    clusters = settled(measured(parts, centres), "sweep-clusters")
    tried = clusters.groupBy("session_id", "k").agg(
        (F.sum("silhouettes") / F.sum("size")).alias("quality_score"), F.count("*").alias("cluster_count"), F.sum("inertia").alias("inertia"),
    )
    best = tried.where("quality_score > 0").groupBy("session_id").agg(F.max_by("k", F.struct("quality_score", -F.col("k"))).alias("k"))
    attempts = tried.join(best.withColumn("chosen", F.lit(True)), ["session_id", "k"], "left").select(
        "session_id", "k", F.concat(F.lit("kmeans_"), F.col("k").cast("string")).alias("profile_name"), F.lit("kmeans").alias("backend"),
        "quality_score", "cluster_count", F.lit(0.0).alias("noise_fraction"), "inertia", F.coalesce("chosen", F.lit(False)).alias("chosen"),
        (F.col("k") == max_k).alias("at_limit"),
    )
    found = labelled(parts, centres, best)
    single = parts.select("session_id", F.explode("items").alias("item_id")).join(best, "session_id", "left_anti").withColumn("label", F.lit(0))
    labels = points.select("session_id", "item_id").join(found.unionByName(single), ["session_id", "item_id"], "left")
    return labels.withColumn("label", F.coalesce("label", F.lit(-1))), attempts, clusters
