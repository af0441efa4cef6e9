"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

1. **Blocks.** One scan turns vectors to the integers of their rows, packed by the thousand into binary cells and
   written once, and sums them exactly: n and the sum S of every dimension.
2. **Bidiagonalisation.** With X the centred rows, u = Xv and Xᵀu alternate until X = U B Vᵀ. All left
   vectors lie in the range of X, u = Xw, so a vector of n entries is never stored: the driver holds the
   columns v, w and Xᵀu of one number a dimension each. One distributed pass a step gives, for one vector t,
   Xᵀ(Xt) and the square of Xt; sums over the tasks are combined by Spark. Both v and u are
   orthogonalised in full and twice: u's products with earlier ones are products of w and Xᵀu.
3. **Components.** The singular values of the small bidiagonal matrix are sqrt(n e), its right vectors give
   the components. It ends when the residuals of the leading values are at rounding level and what the
   matrix has not caught of the trace is less than the last of them, so that no value, repeated ones included,
   can be missing; at the latest with one step a dimension.
4. **Rows.** A pass over the blocks gives the covariance of the whitened rows, another one the result.

Every pass reads the written blocks, so a lost executor repeats its tasks only. The driver's memory is
the square of the number of dimensions at most.

Defined results: a vector with a null, NaN or infinite entry, or with one whose integer has over 61 bits, drops
out. Dimensions are those of the longest vector; a shorter or empty one lacks entries and drops out too. Rows
without vec_id and repeated rows count as any other. Components whose variance is zero to double
precision (at most d * 1e-15 of the largest) have no whitened value and are left out; with one row, equal rows
or none the result is empty. ``deviation`` is null where it does not fit a long; ``deviation_exact``
holds up to 38 digits. Of equal variances any orthogonal components may come.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorale.llm.registry import packed, query, table

COMPONENTS = 8
SCALE, SHIFT = 1024.0, 100_000  # of the integers
BLOCK_ROWS = 4096
LONG = (1 << 63) - 1
LARGEST = float(1 << 61)
SETTLED = 1e-14  # residuals in parts of the largest singular value
_BLOCK = "dims int, wide boolean, ids array<long>, cells binary"


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lengths of all rows, cells): the rows without a missing entry, and the integers of all entries of ``column``."""
    ends = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.slice(ends[0], ends[-1] - ends[0])
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    value = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        cell = np.floor(value * SCALE)
        bad |= ~(np.abs(cell) < LARGEST)
    cell = np.where(bad, 0.0, cell).astype(np.int64) + SHIFT
    length = np.diff(ends)
    wrong = np.concatenate(([0], np.cumsum(bad)))
    holes = wrong[ends[1:] - ends[0]] - wrong[ends[:-1] - ends[0]]
    rows = np.flatnonzero((holes == 0) & column.is_valid().to_numpy(zero_copy_only=False))
    return rows, length, cell


def _packs(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(start, BLOCK_ROWS)
            column = part.column("vector")
            rows, length, cell = integers(column)
            at = column.offsets.to_numpy().astype(np.int64)
            at = at[:-1] - at[0]
            for dims in np.unique(length[rows]).tolist():
                mine = rows[length[rows] == dims]
                cells = cell[at[mine][:, None] + np.arange(dims)] if dims else np.zeros((len(mine), 0), np.int64)
                wide = bool(cells.size and np.abs(cells).max() >= 1 << 31)
                yield pa.RecordBatch.from_arrays([
                    pa.array([dims], pa.int32()), pa.array([wide]), pa.array([part.column("vec_id").take(pa.array(mine)).to_pylist()], pa.list_(pa.int64())),
                    pa.array([cells.astype(np.int64 if wide else np.int32).tobytes()], pa.binary()),
                ], names=["dims", "wide", "ids", "cells"])


def _cells(batch, at: int) -> np.ndarray:
    dims = batch.column("dims")[at].as_py()
    kind = np.int64 if batch.column("wide")[at].as_py() else np.int32
    return np.frombuffer(batch.column("cells")[at].as_py(), kind).astype(np.int64).reshape(-1, dims)


def _summed(blocks: DataFrame, exact: Callable[[np.ndarray], np.ndarray] | None, inexact, size: int) -> list:
    """Sums over all blocks of ``exact`` (long) or ``inexact`` (double), ``size`` numbers; a task sends one row a number."""
    one, kind = (exact, np.int64) if exact else (inexact, np.float64)

    def add(batches):
        total = np.zeros(size, kind)
        for batch in batches:
            for at in range(batch.num_rows):
                total += one(_cells(batch, at))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["i", "s"])

    sums = blocks.mapInArrow(add, "i int, s " + ("long" if exact else "double"))
    total = F.sum(F.col("s").cast("decimal(38,0)")) if exact else F.sum("s")
    got = dict(sums.groupBy("i").agg(total.alias("s")).collect())
    return [(int(got[i] or 0) if exact else got[i] or 0.0) if i in got else 0 for i in range(size)]


@dataclass(frozen=True)
class Centre:
    """The mean S / n as an integer and a fraction, so that centring loses nothing."""

    n: int
    sums: tuple[int, ...]

    def rows(self, cells: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (cells - whole).astype(np.float64) - rest

    def deviations(self, cells: np.ndarray) -> list[int]:
        """The exact sum of (n x - S)² of every row."""
        low = [s // self.n for s in self.sums]
        most = max((max(abs(int(c.max()) - m), abs(int(c.min()) - m)) + 1 for c, m in zip(cells.T, low)), default=0) * self.n
        if most * most * max(len(low), 1) <= LONG:
            d = self.n * (cells - np.array(low, np.int64)) - np.array([s % self.n for s in self.sums], np.int64)
            return (d * d).sum(1).tolist()
        d = self.n * cells.astype(object) - np.array(self.sums, object)
        return (d * d).sum(1).tolist()


@dataclass(frozen=True)
class Whitener:
    """The fitted model: rows of ``components`` are unit vectors, ``variances`` their eigenvalues, falling."""

    centre: Centre
    components: np.ndarray
    variances: np.ndarray
    trace: float
    steps: int

    def whitened(self, cells: np.ndarray) -> np.ndarray:
        return self.centre.rows(cells) @ (self.components / np.sqrt(self.variances)[:, None]).T


def orthogonal(v: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along the orthonormal vectors ``to``; twice, as one pass leaves rounding errors."""
    for _ in range(2 if to else 0):
        basis = np.array(to)
        v = v - basis.T @ (basis @ v)
    return v


def bidiagonalised(product: Callable[[np.ndarray], tuple[np.ndarray, float]], dims: int, squares: float, wanted: int):
    """(singular values, right vectors, steps) of X from ``product``: t -> (Xᵀ(Xt), |Xt|²); ``squares``: the sum of X's squares."""
    rng = np.random.default_rng(13)
    vs, ws, back = [], [], []  # v, w with u = Xw, and Xᵀu
    b = np.zeros((dims, dims))
    v = rng.standard_normal(dims)
    v /= np.linalg.norm(v)
    beta, tiny = 0.0, np.sqrt(squares) * 1e-15
    for k in range(dims):
        vs.append(v)
        t = v - beta * ws[-1] if k else v
        xxt, square = product(t)
        for _ in range(2 if k else 0):  # Xt without its parts along earlier u, as changes of t
            c = np.array([w @ xxt for w in ws])
            t = t - np.array(ws).T @ c
            xxt = xxt - np.array(back).T @ c
            square -= c @ c
        alpha = float(np.sqrt(max(square, 0.0)))
        if alpha <= tiny:  # X maps v to nothing new
            alpha, w, xu = 0.0, np.zeros(dims), np.zeros(dims)
        else:
            w, xu = t / alpha, xxt / alpha
        ws.append(w)
        back.append(xu)
        b[k, k] = alpha
        if k:
            b[k - 1, k] = beta
        left, sigma, right = np.linalg.svd(b[: k + 1, : k + 1])
        v = orthogonal(xu - alpha * vs[-1], vs)
        beta = float(np.linalg.norm(v))
        many = min(wanted, k + 1)
        residual = beta * np.abs(left[-1, :many]).max()
        missed = squares - (sigma**2).sum()
        enough = k + 1 >= wanted and residual <= SETTLED * sigma[0] and missed < sigma[many - 1] ** 2
        if enough or k + 1 == dims or missed <= squares * dims * 1e-16:
            break
        if beta <= tiny:  # an invariant subspace: go on with a new direction
            beta = 0.0
            v = orthogonal(rng.standard_normal(dims), vs)
        v /= np.linalg.norm(v)
    return sigma, right @ np.array(vs), len(vs)


def blocks_of(vectors: DataFrame) -> DataFrame:
    """dims, wide, ids, cells: the rows of (vec_id, vector) that take part, in blocks, written once."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    blocks = packed(rows.mapInArrow(_packs, _BLOCK), "whitening-blocks")
    dims = blocks.agg(F.max("dims")).first()[0] or 0
    return blocks.where((F.col("dims") == dims) & (F.col("dims") > 0))


def fitted(blocks: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitener of all rows of ``blocks``; None where no component has a variance."""
    dims = blocks.agg(F.max("dims")).first()[0] or 0


    def halves(cells):  # sums of 32 bits each, which can't overflow in a task
        return np.concatenate([[len(cells)], (cells >> 32).sum(0), (cells & 0xFFFFFFFF).sum(0)])

    n, *sums = _summed(blocks, halves, None, 2 * dims + 1)
    if not n or not dims:
        return None
    centre = Centre(n, tuple((high << 32) + low for high, low in zip(sums[:dims], sums[dims:])))
    squares = _summed(blocks, None, lambda cells: np.array([np.square(centre.rows(cells)).sum()]), 1)[0]
    if not squares:
        return None

    def product(t: np.ndarray) -> tuple[np.ndarray, float]:
        def both(cells):
            x = centre.rows(cells)
            image = x @ t
            return np.append(x.T @ image, image @ image)

        *xxt, square = _summed(blocks, None, both, dims + 1)
        return np.array(xxt), square

    sigma, right, steps = bidiagonalised(product, dims, squares, min(components, dims))
    variances = sigma**2 / n
    keep = np.flatnonzero(variances > variances[0] * dims * 1e-15)[:components]
    return Whitener(centre, right[keep], variances[keep], squares / n, steps)


def identity_error(blocks: DataFrame, model: Whitener) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity."""
    k = len(model.variances)

    def moments(cells):
        z = model.whitened(cells)
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    got = np.array(_summed(blocks, None, moments, k + k * k))
    mean = got[:k] / model.centre.n
    return float(np.abs(got[k:].reshape(k, k) / model.centre.n - np.outer(mean, mean) - np.eye(k)).max())


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact of every row of (vec_id, vector)."""
    blocks = blocks_of(vectors)
    model = fitted(blocks, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], _OUT)
    error = identity_error(blocks, model)
    explained = model.variances / model.trace

    def rows(batches):
        import decimal

        k = len(model.variances)
        for batch in batches:
            for at in range(batch.num_rows):
                cells = _cells(batch, at)
                m = len(cells)
                ids = batch.column("ids")[at].values.take(pa.array(np.repeat(np.arange(m), k)))
                deviation = np.repeat(np.array(model.centre.deviations(cells), object), k).tolist()
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1), m).astype(np.int32)), pa.array(np.full(m * k, model.centre.n, np.int64)),
                    pa.array([d if d <= LONG else None for d in deviation], pa.int64()), pa.array(model.whitened(cells).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    pa.array([decimal.Decimal(d) if d < 10**38 else None for d in deviation], pa.decimal128(38, 0)),
                ], names=[c.split(" ")[0] for c in _OUT.replace("decimal(38,0)", "decimal").split(", ")])

    return blocks.mapInArrow(rows, _OUT)


@query("op13_whitening")
def op13_whitening(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector")))
