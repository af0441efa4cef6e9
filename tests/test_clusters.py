"""Clustering of many sessions at once, against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chorale.operators import clustering, density, sweep
from chorale.plans import clusters as plan

SCHEMA = "session_id string, item_id string, vector array<double>"


def points(spark, sessions):
    """``sessions``: name to matrix; items are strings, in the order of the rows."""
    return spark.createDataFrame([(s, f"{s}-{i:05d}", [float(a) for a in v]) for s, m in sessions.items() for i, v in enumerate(m)], SCHEMA)


def planted(seed=1, each=30, groups=3, dims=8, spread=0.2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dims)) * 6
    return np.concatenate([c + rng.normal(scale=spread, size=(each, dims)) for c in centers])


def labels_of(frame, session, n):
    got = {r.item_id: r.label for r in frame.where(F.col("session_id") == session).collect()}
    return np.array([got[f"{session}-{i:05d}"] for i in range(n)])


def plain_density(x, eps, samples, size):
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps
    np.fill_diagonal(near, False)
    core, group = near.sum(1) >= samples, np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if group[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if group[j] < 0:
                    group[j] = i
                    stack += np.flatnonzero(near[j] & core & (group < 0)).tolist()
    distance = np.where(near & core[None], np.linalg.norm(x[:, None] - x[None], axis=2), np.inf)
    for i in np.flatnonzero(~core & (near & core[None]).any(1)):
        group[i] = group[distance[i].argmin()]
    out, kept = np.full(len(x), -1), [g for g in set(group) - {-1} if (group == g).sum() >= size]
    for number, g in enumerate(sorted(kept, key=lambda g: (-(group == g).sum(), np.flatnonzero(group == g)[0]))):
        out[group == g] = number
    return out


@pytest.mark.parametrize("tile_rows", [9, 2048])
def test_density_against_a_plain_version(spark, tile_rows):
    rng = np.random.default_rng(3)
    sessions = {
        "a": rng.normal(size=(90, 2)) * 2, "b": np.concatenate([planted(), rng.normal(size=(2, 8)) * 40]),
        "c": np.repeat(rng.normal(size=(12, 3)) * 5, 4, axis=0), "d": rng.normal(size=(1, 4)), "e": np.zeros((7, 3)),
    }
    df = points(spark, sessions)
    got = density.density_clusters(df, density.settings(df, 0.8), tile_rows=tile_rows)
    assert got.count() == df.count()
    for name, x in sessions.items():
        assert labels_of(got, name, len(x)).tolist() == plain_density(x, 0.8, 2, 5).tolist(), name


def test_null_vectors_are_noise_and_ids_may_be_numbers(spark):
    rows = [("s", i, [1.0, float(i % 2) / 10]) for i in range(-3, 8)] + [("s", 100, None)]
    df = spark.createDataFrame(rows, "session_id string, item_id bigint, vector array<double>")
    got = {r.item_id: r.label for r in density.density_clusters(df, density.settings(df, 0.5)).collect()}
    assert got[100] == -1 and all(got[i] == 0 for i in range(-3, 8))
    assert density.density_clusters(df.limit(0), density.settings(df.limit(0), 0.5)).collect() == []


def test_hash_tables_find_the_neighbours():
    """Pairs at the radius meet in at least nine of ten cases, far ones hardly ever."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(4000, 24)) * 5
    step = rng.normal(size=a.shape)
    step /= np.linalg.norm(step, axis=1)[:, None]
    eps = np.full(len(a), 1.0)
    meet = lambda b: (density.bucket_codes(a, eps) == density.bucket_codes(b, eps)).any(1).mean()
    assert meet(a + step) > 0.95 and meet(a + 0.5 * step) > 0.995 and meet(a + 20 * step) < 0.02


def test_large_sessions_by_hash_tables(spark):
    """Recall of neighbours, and pairs that grow with the points: planted groups, each of a dozen points."""
    counts = {}
    for groups in (60, 240):
        x = planted(5, each=12, groups=groups, dims=12, spread=0.1)
        df = points(spark, {"s": x})
        nodes = density.distinct_points(df)[1].join(density.settings(df, 1.0, samples=11), "session_id")
        rows = density.placed(nodes, exact_rows=10, tile_rows=64)
        sizes = rows.groupBy("session_id", "bucket").count().toPandas()["count"]
        counts[groups] = (sizes**2).sum()
        assert density.bucket_codes(x, np.ones(len(x))).shape == (len(x), density.TABLES)
    assert counts[240] < 8 * counts[60]  # four times the points: pairs in buckets far from sixteenfold
    near = density.neighbours(rows, 64).select("node", "other")
    true = (np.linalg.norm(x[:, None] - x[None], axis=2) <= 1.0).sum() - len(x)
    assert near.count() >= 0.9 * true
    got = labels_of(density.density_clusters(df, density.settings(df, 1.0), exact_rows=10), "s", len(x))
    assert (got >= 0).all() and len(set(got)) == 240 and all(len(set(got[i * 12 : i * 12 + 12])) == 1 for i in range(240))


def test_a_hot_dense_group_costs_its_size(spark):
    """A third of a session in one ball: returned rows grow with points, and only stragglers meet other tiles."""
    rng = np.random.default_rng(8)
    ball = rng.normal(size=(400, 3)) * 0.05
    x = np.concatenate([ball, rng.normal(size=(800, 3)) * 100])
    df = points(spark, {"s": x})
    nodes = density.distinct_points(df)[1].join(density.settings(df, 1.0), "session_id")
    rows = density.placed(nodes, exact_rows=10**6, tile_rows=50)
    assert density.neighbours(rows, 50).count() < 40 * len(x)
    got = labels_of(density.density_clusters(df, density.settings(df, 1.0), tile_rows=50), "s", len(x))
    assert (got[:400] == 0).all() and got.tolist() == plain_density(x, 1.0, 2, 5).tolist()


def plain_sweep(x, k, rounds=10):
    square = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(2)
    centres = x[[np.round(square(x, x.mean(0)[None])[:, 0], 9).argmin()]]
    while len(centres) < k:
        centres = np.concatenate([centres, x[[np.round(square(x, centres).min(1), 9).argmax()]]])
    for _ in range(rounds):
        near = square(x, centres).argmin(1)
        centres = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(k)])
    near = square(x, centres).argmin(1)
    return near, square(x, centres).min(1).sum()


def silhouette(x, labels):
    square = ((x[:, None] - x[None]) ** 2).sum(2)
    out = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(labels)) != i)
        others = [square[i, labels == o].mean() for o in set(labels) - {own}]
        out.append((min(others) - square[i, same].mean()) / max(min(others), square[i, same].mean()) if same.any() and others else 0.0)
    return np.mean(out)


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_sweep_against_a_plain_version(spark, block_rows):
    rng = np.random.default_rng(5)
    sessions = {"a": planted(2, each=20), "b": rng.normal(size=(13, 4)), "c": rng.normal(size=(9, 2)), "d": rng.normal(size=(8, 2)), "e": np.ones((1, 2))}
    labels, attempts, _ = sweep.sweep(points(spark, sessions), 5, block_rows=block_rows)
    rows = attempts.collect()
    assert {(r.session_id, r.k) for r in rows} == {("a", 3), ("a", 4), ("a", 5), ("b", 3), ("b", 4), ("c", 3)}
    for r in rows:
        near, inertia = plain_sweep(sessions[r.session_id], r.k)
        assert r.inertia == pytest.approx(inertia) and r.cluster_count == len(set(near)) and r.at_limit == (r.k == 5)
        assert r.quality_score == pytest.approx(silhouette(sessions[r.session_id], near))
        if r.chosen:
            assert labels_of(labels, r.session_id, len(near)).tolist() == near.tolist()
    assert sum(r.chosen for r in rows) == len({r.session_id for r in rows if r.quality_score > 0})
    assert set(labels_of(labels, "d", 8)) == {0} and labels.count() == sum(map(len, sessions.values()))


def test_sweep_of_unusable_and_equal_points(spark):
    rows = [("s", f"{i:02d}", [2.0, 2.0]) for i in range(12)] + [("s", "x", None), ("s", "y", [1.0, float("nan")])]
    labels, attempts, _ = sweep.sweep(spark.createDataFrame(rows, SCHEMA), 4)
    assert {r.item_id: r.label for r in labels.collect()} == {**{f"{i:02d}": 0 for i in range(12)}, "x": -1, "y": -1}
    assert [(r.cluster_count, r.quality_score, r.chosen) for r in attempts.collect()] == [(1, 0.0, False)] * 2


def test_profiles_follow_the_number_of_points(spark):
    def of(n):
        return [tuple(spark.range(1).select(size, samples).first()) for _, size, samples in clustering.profiles(F.lit(n))]

    assert of(100) == [(5, 2), (4, 2), (6, 3)] and of(6) == [(2, 1), (2, 1), (3, 2)]


def test_next_profile_runs_for_unsatisfied_sessions_only(spark):
    rng = np.random.default_rng(6)
    sessions = {"good": planted(7), "noise": rng.normal(size=(40, 8)) * 30, "tiny": rng.normal(size=(3, 8))}
    labels, attempts, selection = plan.clustered(points(spark, sessions), 1.5, 4)
    tried = {s: [r.profile_name for r in attempts.where(F.col("session_id") == s).orderBy("ord").collect()] for s in sessions}
    assert tried["good"] == ["density_default", "kmeans_3", "kmeans_4"]
    assert tried["noise"] == ["density_default", "density_smaller_clusters", "density_more_stable", "kmeans_3", "kmeans_4"]
    assert tried["tiny"] == ["density_default", "density_smaller_clusters", "density_more_stable"]
    picked = {r.session_id: r for r in selection.collect()}
    assert (picked["good"].backend, picked["good"].cluster_count, picked["good"].quality_gate_passed) == ("density", 3, True)
    assert picked["tiny"].backend == "single" and set(labels_of(labels, "tiny", 3)) == {0}
    shown = labels.join(selection, "session_id").groupBy("session_id", "cluster_count").agg(F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n"))
    assert all(r.cluster_count == r.n for r in shown.collect()) and labels.count() == 133
    assert pd.unique(labels_of(labels, "good", 90)).tolist() == [0, 1, 2]


def test_a_wide_radius_makes_a_large_session_one_exact_bucket(spark):
    """Tables that separate nothing hold every pair several times; then all rows meet once, in tiles, and no neighbour is missed."""
    x = np.random.default_rng(9).normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = points(spark, {"s": x})
    nodes = density.distinct_points(df)[1].join(density.settings(df, 0.8), "session_id")
    assert density.placed(nodes, exact_rows=100, tile_rows=64).count() == 300
    got = density.density_clusters(df, density.settings(df, 0.8), exact_rows=100, tile_rows=64)
    assert labels_of(got, "s", 300).tolist() == plain_density(x, 0.8, 2, 5).tolist()


def test_profiles_with_the_same_neighbours_share_groups(spark, monkeypatch):
    sessions, made, grouped = {"noise": np.random.default_rng(6).normal(size=(40, 8)) * 30}, [], density.grouped
    monkeypatch.setattr(density, "grouped", lambda *args: made.append(grouped(*args)) or made[-1])
    labels, attempts = plan.density_attempts(points(spark, sessions), 1.5, 0.35, 20)
    assert attempts.count() == 3 and labels.count() == 120 and len(made) == 2


def test_a_large_session_is_exact_whatever_its_size(spark):
    """900 chains of five points at the radius, more points than were once compared exactly: no link of a chain is missed."""
    rng = np.random.default_rng(12)
    steps = rng.normal(size=(900, 4, 24))
    steps *= 0.99 / np.linalg.norm(steps, axis=2)[:, :, None]
    x = np.concatenate([rng.normal(size=(900, 1, 24)) * 40, steps], axis=1).cumsum(1).reshape(-1, 24)
    df = points(spark, {"s": x})
    got = labels_of(density.density_clusters(df, density.settings(df, 1.0)), "s", len(x)).reshape(900, 5)
    assert (got >= 0).all() and (got == got[:, :1]).all() and len(set(got[:, 0])) == 900
