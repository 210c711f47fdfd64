"""Whitening of embeddings by their leading principal components.

Entries become integers, ``floor(scale * c)``; the covariance is that of the distinct integer
vectors (the fit list), centred before anything is multiplied. Tasks sum their outer products,
and one row per matrix entry leaves each of them; only the matrix of the dimensions reaches the
driver. There it is made tridiagonal by Householder reflections, its largest eigenvalues are
bisected by Sturm counts, and inverse iteration gives the vectors, made orthogonal again within
clusters of close eigenvalues. The components go to all tasks, which project their rows.

The fit list is written once to the shared checkpoint folder, so a lost executor costs a task.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are left
out; so are vectors of another length than the commonest (of equally common ones, the
longest). Null and repeated ids are rows of their own. A component whose eigenvalue is zero to
double precision has no whitened values and is not returned; one distinct vector, or none, thus
gives no rows. Entries beyond the range of a long become its ends; a deviation beyond it is null.
Other columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import shared_folder

SCALE, COMPONENTS = 256, 4
#: Relative distance below which eigenvalues count as a cluster.
CLUSTER = 1e-3
_LONG = (1 << 63) - 1
_EPS = np.finfo(np.float64).eps


def usable(vector: str) -> Column:
    """Vectors with finite entries only, one at least."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), F.lit(False)))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & finite


def quantised(vector: str, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and sums per dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            # halves, so that no sum of a batch leaves 64 bits
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            n += len(x)
            sums = [s + (h << 32) + w for s, h, w in zip(sums, high, low)]
        yield pa.RecordBatch.from_arrays([
            pa.array(range(-1, d), pa.int32()), pa.array([n, *sums], pa.decimal128(38, 0))
        ], ["i", "s"])

    rows = fit.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    found = {r["i"]: int(r["s"]) for r in rows}
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def _products(fit: DataFrame, d: int, mean: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """Sum of the outer products of the centred vectors, or of their projections."""
    size = d if project is None else project.shape[1]
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            centred = _matrix(batch.column("x"), d) - mean
            if project is not None:
                centred = centred @ project
            total += centred.T @ centred
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], ["i", "j", "v"]
        )

    rows = fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((size, size))
    for r in rows:  # one per matrix entry
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``diagonal, off, q`` with ``matrix = q @ T @ q.T``, by Householder reflections."""
    a, d = np.array(matrix, np.float64), len(matrix)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        length = np.linalg.norm(x)
        if length == 0 or not np.any(x[1:]):
            continue
        x[0] += math.copysign(length, x[0])
        v = x / np.linalg.norm(x)
        # a <- h a h with h = 1 - 2 v v', on the trailing block
        block = a[k + 1:, k + 1:]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
        a[k, k + 1:] = a[k + 1:, k]
        q[:, k + 1:] -= 2 * np.outer(q[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def count_below(diagonal: np.ndarray, off: np.ndarray, at: float) -> int:
    """Eigenvalues of the tridiagonal matrix below ``at`` (Sturm count)."""
    tiny = np.finfo(np.float64).tiny
    count, pivot = 0, 1.0
    with np.errstate(over="ignore"):  # a tiny pivot makes the next one infinite, as it should
        squares = [0.0, *(off ** 2)]
        for a, square in zip(diagonal, squares):
            pivot = a - at - square / pivot
            if pivot == 0:
                pivot = -tiny
            count += bool(pivot < 0)
    return count


def largest(diagonal: np.ndarray, off: np.ndarray, k: int) -> list[float]:
    """The ``k`` largest eigenvalues, falling, by bisection."""
    d = len(diagonal)
    edge = np.zeros(d)
    edge[:-1] += np.abs(off)
    edge[1:] += np.abs(off)
    low, high = float((diagonal - edge).min()), float((diagonal + edge).max())
    pad = max(abs(low), abs(high)) * _EPS * 4 + np.finfo(np.float64).tiny
    low, high = low - pad, high + pad
    found = []
    for n in range(min(k, d)):
        a, b = low, high
        while True:
            mid = (a + b) / 2
            if not a < mid < b or b - a <= _EPS * max(abs(a), abs(b)):
                break
            if count_below(diagonal, off, mid) <= d - 1 - n:
                a = mid
            else:
                b = mid
        found.append((a + b) / 2)
    return found


def _solve(diagonal: np.ndarray, off: np.ndarray, at: float, right: np.ndarray) -> np.ndarray:
    """``(T - at) x = right`` by elimination with row exchanges; zero pivots become tiny."""
    d = len(diagonal)
    least = _EPS * (float(np.abs(diagonal).max(initial=0)) + float(np.abs(off).max(initial=0)) or 1.0)
    main, up, two, b = (diagonal - at).tolist(), [*off.tolist(), 0.0], [0.0] * d, right.tolist()
    for i in range(d - 1):
        low, then_main, then_up = off[i], main[i + 1], up[i + 1]
        if abs(low) > abs(main[i]):
            factor = main[i] / low
            main[i], main[i + 1] = low, up[i] - factor * then_main
            up[i], two[i], up[i + 1] = then_main, then_up, -factor * then_up
            b[i], b[i + 1] = b[i + 1], b[i] - factor * b[i + 1]
        else:
            if main[i] == 0:
                main[i] = least
            factor = low / main[i]
            main[i + 1] = then_main - factor * up[i]
            b[i + 1] -= factor * b[i]
    x = [0.0] * (d + 2)
    for i in range(d - 1, -1, -1):
        pivot = main[i] if abs(main[i]) > least else math.copysign(least, main[i])
        x[i] = (b[i] - up[i] * x[i + 1] - two[i] * x[i + 2]) / pivot
    return np.array(x[:d])


def vectors(diagonal: np.ndarray, off: np.ndarray, values: list[float]) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as columns, by inverse iteration.

    A vector is made orthogonal to those before it whose eigenvalues are close to its own.
    """
    d, norm = len(diagonal), max(max(map(abs, values), default=0.0), np.finfo(np.float64).tiny)
    done: list[np.ndarray] = []
    start = np.random.default_rng(0)
    for n, value in enumerate(values):
        # equal values are moved apart a little, so that their solutions differ
        at = min([value, *[values[n - 1] - 2 * _EPS * norm for _ in range(n > 0)]])
        near = [v for v, other in zip(done, values) if abs(other - value) <= CLUSTER * norm]
        x = start.standard_normal(d)
        for _ in range(6):
            for _ in range(2):
                for v in near:
                    x = x - (v @ x) * v
            x = x / np.linalg.norm(x)
            x = _solve(diagonal, off, at, x)
            x = x / np.abs(x).max()
        for _ in range(2):
            for v in near:
                x = x - (v @ x) * v
            x = x / np.linalg.norm(x)
        done.append(x)
    return np.array(done).T.reshape(d, len(done))


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest ``k`` eigenvalues above zero, falling, and their unit vectors as columns."""
    diagonal, off, q = tridiagonal(matrix)
    floor = len(matrix) * _EPS * float(np.trace(matrix))
    values = [v for v in largest(diagonal, off, k) if v > floor]
    found = q @ vectors(diagonal, off, values)
    return np.array(values), found


@dataclass(frozen=True)
class Whitening:
    """What :func:`fit` learned: ``n`` vectors with sums ``sums``, components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / max(self.n, 1) for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def fit(x: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Fit on the distinct vectors of ``x`` (column ``x``, ``d`` long entries each)."""
    folder = f"{shared_folder(x, 'whitening')}/fit"
    x.distinct().write.parquet(folder)
    rows = x.sparkSession.read.schema(x.schema).parquet(folder)
    n, sums = _sums(rows, d)
    mean = np.array([s / max(n, 1) for s in sums])
    covariance = _products(rows, d, mean) / max(n, 1)
    values, found = leading(covariance, components)
    error = 0.0
    if len(values):
        white = _products(rows, d, mean, found / np.sqrt(values)) / n
        error = float(np.abs(white - np.eye(len(values))).max())
    return Whitening(n, sums, values, found, float(np.trace(covariance)), error)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    largest_step = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0)
    if largest_step ** 2 * len(sums) <= _LONG:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
    return [v if v <= _LONG else None for v in exact]


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for ``id, x``."""
    d, k = len(model.sums), len(model.values)
    mean, projection, shares = model.mean, model.projection, (model.values / (model.trace or 1.0)).tolist()
    schema = T.StructType([rows.schema["id"], T.StructField("component", T.IntegerType())])
    for name, kind in (("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()),
                       ("explained", T.DoubleType()), ("identity_error", T.DoubleType())):
        schema = schema.add(name, kind)
    n, sums, error = model.n, model.sums, model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            m = len(x)
            ids = batch.column("id").take(pa.array(np.repeat(np.arange(m), k)))
            far = pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), far,
                pa.array(((x - mean) @ projection).ravel()), pa.array(np.tile(shares, m), pa.float64()),
                pa.array(np.full(m * k, error)),
            ], schema.names)

    return rows.mapInArrow(run, schema)


def whiten(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS,
    scale: int = SCALE,
) -> DataFrame:
    """Rows of :func:`transform` for every usable vector, fitted on all of them."""
    good = embeddings.filter(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    common = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    d = common["d"] if common else 1
    rows = good.filter(F.size("v") == d).select("id", quantised("v", scale).alias("x"))
    return transform(rows, fit(rows.select("x"), d, components)).withColumnRenamed("id", id_col)
