import numpy as np
import pytest
from helpers import SMALL

from chorale.llm import whitening
from chorale.llm.queries import QUERIES


def plain(vectors, components=8):
    """By an eigendecomposition of the covariance of the integers: n, deviations, eigenvalues, eigenvectors, trace."""
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    deviation = ((n * x.astype(object) - s.astype(object)) ** 2).sum(1)
    centred = (n * x - s) / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e)[:components]
    return n, deviation, e[order], v[:, order], np.trace(cov), centred


def check(rows, vectors, components=8):
    n, deviation, e, v, trace, centred = plain(list(vectors.values()), components)
    want = centred @ v / np.sqrt(e)
    got = np.full(want.shape, np.nan)
    place = {k: i for i, k in enumerate(vectors)}
    for r in rows:
        i, k = place[r.vec_id], r.component - 1
        got[i, k] = r.whitened
        assert r.n == n and r.deviation == deviation[i] and int(r.deviation_exact) == deviation[i]
        assert r.explained == pytest.approx(e[k] / trace, rel=1e-10) and r.identity_error < 1e-10
    assert len(rows) == want.size
    signs = np.sign((got * want).sum(0))
    gap = np.abs(np.diff(np.append(e, 0))) / e[0]
    assert np.abs(got * signs - want).max() < 1e-11 / gap.min()


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vector array<float>, label int, dims int, ids string, component long, n string, cells int")


def pad(rows):
    return [(*r, None, 1, "x", 5, "y", 2) for r in rows]


def test_components_against_eigh(spark):
    rng = np.random.default_rng(4)
    scale = np.linspace(0.2, 2, 20)
    vectors = {i: (rng.standard_normal(20) * scale).astype(np.float32).tolist() for i in range(300)}
    check(whitening.whitened(frame(spark, pad(vectors.items()))).collect(), vectors)


def test_query_on_the_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    check(QUERIES["op13_whitening"](spark, SMALL).collect(), {r.vec_id: r.embedding for r in rows})


def test_rows_that_drop_out(spark):
    rng = np.random.default_rng(5)
    good = {i: rng.standard_normal(6).astype(np.float32).tolist() for i in range(40)}
    good[40] = good[3]
    inf, nan = float("inf"), float("nan")
    bad = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (93, [nan] * 6), (94, [inf] + [0.0] * 5), (95, [1.0] * 5), (96, [1e30] * 6)]
    rows = whitening.whitened(frame(spark, pad([*good.items(), *bad]))).collect()
    check(rows, good, 6)


def test_null_and_repeated_ids_count_as_rows(spark):
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((9, 3)).astype(np.float32).tolist()
    rows = whitening.whitened(frame(spark, pad([(None, v) for v in vectors[:5]] + [(1, v) for v in vectors[5:]]))).collect()
    assert len(rows) == 27 and sum(r.vec_id is None for r in rows) == 15 and {r.n for r in rows} == {9}


def test_ties_and_missing_variance(spark):
    """Equal variances are all found; components without variance have no rows."""
    corners = [(i, [float(s) if k == i // 2 else 0.0 for k in range(12)]) for i, s in zip(range(24), [1, -1] * 12)]
    rows = whitening.whitened(frame(spark, pad(corners))).collect()
    assert {r.component for r in rows} == set(range(1, 9)) and all(abs(r.explained - 1 / 12) < 1e-12 and r.identity_error < 1e-10 for r in rows)
    flat = [(i, [float(i % 3), float(i % 2), 7.0, 7.0]) for i in range(12)]
    rows = whitening.whitened(frame(spark, pad(flat))).collect()
    assert {r.component for r in rows} == {1, 2}
    assert whitening.whitened(frame(spark, pad([(1, [1.0, 2.0])] * 4))).count() == 0
    assert whitening.whitened(frame(spark, pad([(1, [1.0, 2.0])])).limit(0)).count() == 0
    assert whitening.whitened(frame(spark, pad([(1, []), (2, None)]))).count() == 0


def test_large_values_stay_exact():
    cells = np.array([[1 << 60, 5], [-(1 << 60), 9], [0, 1]], np.int64)
    centre = whitening.Centre(3, (0, 15))
    assert centre.deviations(cells) == [(3 << 60) ** 2, (3 << 60) ** 2 + 144, 144]
    assert whitening.Centre(2, (5, 3)).deviations(np.array([[2, 2], [3, 1]])) == [2, 2]


def test_bidiagonal_form_of_plain_matrices():
    rng = np.random.default_rng(8)
    for x in (rng.standard_normal((50, 12)), rng.standard_normal((40, 3)) @ rng.standard_normal((3, 12)), np.diag([3.0, 3, 3, 1, 0, 0, 0, 0, 0, 0, 0, 0])):
        sigma, right, _ = whitening.bidiagonalised(lambda t: (x.T @ (x @ t), float((x @ t) @ (x @ t))), 12, float((x * x).sum()), 8)
        want = np.linalg.svd(x, compute_uv=False)
        assert np.allclose(sigma[:8], want[: len(sigma)][:8], atol=1e-10 * want[0])
        keep = sigma[:8] > 1e-6
        v = right[:8][keep]
        assert np.allclose(v @ v.T, np.eye(len(v)), atol=1e-12) and np.allclose(x.T @ (x @ v.T), v.T * sigma[:8][keep] ** 2, atol=1e-9)


def test_leading_values_need_few_steps():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((400, 60)) * 0.5 ** np.arange(60)
    sigma, _, steps = whitening.bidiagonalised(lambda t: (x.T @ (x @ t), float((x @ t) @ (x @ t))), 60, float((x * x).sum()), 8)
    assert steps < 40 and np.allclose(sigma[:8], np.linalg.svd(x, compute_uv=False)[:8], rtol=1e-12)
