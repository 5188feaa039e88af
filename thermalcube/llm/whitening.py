"""Whitening of vectors by their leading principal components, found by contour integration."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalcube.llm.common import stored

#: Quadrature points on the upper half of a contour.
POINTS = 8
#: Eigenvalues closer than this part of the largest are sought in one interval.
CLOSE = 1e-6
#: Residual of an accepted pair, as a part of the largest eigenvalue.
RESIDUAL = 1e-12
ROUNDS = 40
#: Eigenvalues below this part of the largest can't be told from zero.
NOTHING = 1e-12
LIMIT = 2**63 - 1


class Tridiagonal:
    """A symmetric matrix reduced once to three diagonals, for counts of eigenvalues above a bound."""

    def __init__(self, matrix: np.ndarray):
        a = np.array(matrix, dtype=np.float64)
        n = len(a)
        for i in range(n - 2):
            v = a[i + 1 :, i].copy()
            length = np.linalg.norm(v)
            if length == 0:
                continue
            v[0] += np.copysign(length, v[0])
            v /= np.linalg.norm(v)
            block = a[i + 1 :, i + 1 :]
            p = block @ v
            w = p - (v @ p) * v
            block -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[i + 1 :, i] -= 2 * v * (v @ a[i + 1 :, i])
        self.diagonal, self.squares = np.diag(a).copy(), np.diag(a, -1) ** 2
        self.scale = max(float(np.abs(matrix).sum(axis=1).max(initial=0.0)), np.finfo(float).tiny)

    def above(self, bound: float) -> int:
        """Eigenvalues above ``bound``: the positive pivots of the shifted matrix (its inertia)."""
        count, pivot, least = 0, 1.0, self.scale * np.finfo(float).eps ** 2
        for i, entry in enumerate((self.diagonal - bound).tolist()):
            pivot = entry - (self.squares[i - 1] / pivot if i else 0.0)
            if abs(pivot) < least:
                pivot = -least
            count += pivot > 0
        return count

    def value(self, k: int) -> float:
        """The k-th largest eigenvalue (from 1), by halving an interval with counts."""
        low, high = -self.scale, self.scale
        while high - low > self.scale * 1e-13:
            middle = (low + high) / 2
            if middle in (low, high):
                break
            low, high = (middle, high) if self.above(middle) >= k else (low, middle)
        return (low + high) / 2


def project_interval(matrix: np.ndarray, low: float, high: float, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs in an interval: a rational filter along a circle around it, then Rayleigh-Ritz.

    The filter is the Gauss-Legendre sum of solves with the matrix shifted to points of the circle. It
    is applied until as many Ritz values as counted lie in the interval with small residuals.
    """
    n = len(matrix)
    size = min(n, max(2 * count, count + 6))
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi / 2 * (1 - nodes)
    center, radius = (low + high) / 2, (high - low) / 2
    scale = max(abs(matrix).sum(axis=1).max(), np.finfo(float).tiny)
    basis = np.random.default_rng(seed).standard_normal((n, size))
    for _ in range(ROUNDS):
        filtered = np.zeros_like(basis)
        for angle, weight in zip(angles, weights):
            turn = radius * np.exp(1j * angle)
            solved = np.linalg.solve((center + turn) * np.eye(n) - matrix, basis.astype(complex))
            filtered += weight / 2 * (turn * solved).real
        basis, _ = np.linalg.qr(filtered)
        values, turns = np.linalg.eigh(basis.T @ matrix @ basis)
        basis = basis @ turns
        inside = (values > low) & (values < high)
        off = np.linalg.norm(matrix @ basis[:, inside] - basis[:, inside] * values[inside], axis=0)
        if inside.sum() == count and off.max(initial=0.0) <= RESIDUAL * scale:
            return values[inside], basis[:, inside]
    raise ArithmeticError(f"the interval holds {count} eigenvalues, but not all of them converged")


def leading_components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit vectors as columns.

    Counts of eigenvalues above a bound place the intervals in the gaps between clusters and tell how
    many pairs each has to give, so none is missed. Values within rounding of zero are left out. Of
    either sign, the vector whose largest entry is positive is given.
    """
    n = len(covariance)
    if not covariance.any():
        return np.zeros(0), np.zeros((n, 0))
    counts = Tridiagonal(covariance)
    near = [counts.value(i + 1) for i in range(min(k + 1, n))]
    floor = max(NOTHING, 4 * n * np.finfo(float).eps) * near[0]
    k = sum(value > floor for value in near[:k])
    while len(near) < n and near[-2 if len(near) > k else -1] - near[-1] < CLOSE * near[0]:
        near.append(counts.value(len(near) + 1))
    last = max(k, len(near) - 1) if len(near) < n or len(near) > k else len(near)
    values, vectors, start = [], [], 0
    while start < last:
        end = start + 1
        while end < len(near) and near[end - 1] - near[end] < CLOSE * near[0]:
            end += 1
        above = near[start - 1] - near[start] if start else near[0]
        below = near[end - 1] - near[end] if end < len(near) else max(near[end - 1], CLOSE * near[0])
        margin = min(above, below) / 2
        low, high = near[end - 1] - margin, near[start] + margin
        count = counts.above(low) - counts.above(high)
        found = project_interval(covariance, low, high, count, seed=start)
        values.append(found[0])
        vectors.append(found[1])
        start = end
    basis, _ = np.linalg.qr(np.concatenate(vectors, axis=1))
    ritz, turns = np.linalg.eigh(basis.T @ covariance @ basis)
    order = np.argsort(-ritz)[:k]
    basis = (basis @ turns)[:, order]
    heads = basis[np.abs(basis).argmax(axis=0), np.arange(k)]
    return ritz[order], basis * np.where(heads < 0, -1.0, 1.0)


class Center(NamedTuple):
    """Count and per-dimension sums of the vectors fitted: the mean is ``whole + rest``, exact to rounding."""

    n: int
    sums: list[int]

    @property
    def whole(self) -> list[int]:
        return [s // self.n for s in self.sums]

    @property
    def rest(self) -> list[int]:
        """What the sums have beyond n times the whole part; from 0 to n - 1."""
        return [s % self.n for s in self.sums]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, subtracting integers before anything is rounded."""
        if x.size and np.abs(x.astype(np.float64)).max() + max(map(abs, self.whole)) < 2**62:
            whole = x - np.array(self.whole, dtype=np.int64)
        else:
            whole = (x.astype(object) - np.array(self.whole, dtype=object)).astype(np.float64)
        return whole.astype(np.float64) - np.array(self.rest, dtype=np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - sum) squared, exact; null beyond 64 bits."""
        widest = np.abs(x.astype(np.float64)).max(initial=0.0) + max(map(abs, self.whole)) + 1
        if (self.n * widest) ** 2 * x.shape[1] < 2**62:
            off = self.n * (x - np.array(self.whole, dtype=np.int64)) - np.array(self.rest, dtype=np.int64)
            return (off * off).sum(axis=1).tolist()
        off = self.n * (x.astype(object) - np.array(self.whole, dtype=object)) - np.array(self.rest, dtype=object)
        return [int(d) if d <= LIMIT else None for d in (off * off).sum(axis=1)]


def _by_dimension(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of each dimension met in a column of lists of longs."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield rows, values[starts[rows][:, None] + np.arange(d)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, list] = {}
    for batch in batches:
        for rows, x in _by_dimension(batch.column(0)):
            wide = np.abs(x.astype(np.float64)).max(initial=0.0) * len(rows) >= 2**62
            part = (x.astype(object) if wide else x).sum(axis=0)
            held = totals.setdefault(x.shape[1], [0, [0] * x.shape[1]])
            held[0] += len(rows)
            held[1] = [a + int(b) for a, b in zip(held[1], part)]
    for d, (n, sums) in totals.items():
        column = pa.array([list(map(Decimal, sums))], pa.list_(pa.decimal128(38, 0)))
        yield pa.record_batch([pa.array([d], pa.int32()), pa.array([n], pa.int64()), column], names=["d", "n", "sums"])


def _centers(fit: DataFrame) -> dict[int, Center]:
    parts = fit.mapInArrow(_sums, "d int, n long, sums array<decimal(38,0)>")
    each = parts.select("d", "n", F.posexplode("sums").alias("i", "s")).groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    centers: dict[int, Center] = {}
    for row in each.orderBy("d", "i").toLocalIterator():
        centers.setdefault(row["d"], Center(row["n"], [])).sums.append(int(row["s"]))
    return centers


def _second_moments(fit: DataFrame, centers: dict[int, Center], onto: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """Covariance (divisor n) per dimension of the centred vectors, or of what they are projected onto.

    Each task multiplies its own rows; of every entry of the upper half the tasks' sums are added by Spark.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_dimension(batch.column(0)):
                d = x.shape[1]
                if onto is not None and d not in onto:
                    continue
                y = centers[d].centred(x)
                y = y if onto is None else y @ onto[d]
                held[d] = held.get(d, 0.0) + y.T @ y
        for d, total in held.items():
            for i, row in enumerate(total):
                yield pa.record_batch(
                    [pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([row[i:].tolist()], pa.list_(pa.float64()))],
                    names=["d", "i", "entries"],
                )

    parts = fit.mapInArrow(products, "d int, i int, entries array<double>")
    summed = parts.select("d", "i", F.posexplode("entries").alias("j", "v")).groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for d, i, j, v in summed.toLocalIterator():
        size = d if onto is None else onto[d].shape[1]
        matrix = out.setdefault(d, np.zeros((size, size)))
        matrix[i, i + j] = matrix[i + j, i] = v / centers[d].n
    return out


class Whitening(NamedTuple):
    """What a row of one dimension needs: the centre, components over the roots of their eigenvalues, shares."""

    center: Center
    weights: np.ndarray
    explained: np.ndarray
    identity_error: float


def integers(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the usable rows: x is floor(scale * c) of each component, held at the ends of a long."""
    c = F.col(vector)
    usable = c.isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    x = F.transform(c, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long"))
    return vectors.filter(usable).select(F.col(key).cast("long").alias("vec_id"), x.alias("x"))


def fit_whitening(rows: DataFrame, components: int = 4) -> dict[int, Whitening]:
    """One fit per dimension over the distinct vectors of ``rows``.

    Distinct vectors are stored once and read three times (sums, centred products, products of the
    whitened vectors). The driver holds d * d numbers per dimension, however many rows there are.
    """
    fit = stored(rows.filter(F.size("x") > 0).select("x").distinct(), "fit")
    centers = _centers(fit)
    covariances = _second_moments(fit, centers)
    found = {d: leading_components(v, components) for d, v in covariances.items()}
    weights = {d: u / np.sqrt(e) for d, (e, u) in found.items() if len(e)}
    white = _second_moments(fit, centers, weights)
    return {
        d: Whitening(centers[d], w, found[d][0] / np.trace(covariances[d]), float(np.abs(white[d] - np.eye(w.shape[1])).max()))
        for d, w in weights.items()
    }


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(
    vectors: DataFrame, components: int = 4, scale: int = 256, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """Every usable row on each leading component of the distinct integer vectors, with unit variance.

    Returns vec_id, component (from 1), n (vectors fitted), deviation (sum over dimensions of
    (n * x - sum) squared, null beyond 64 bits), whitened, explained (share of the total variance) and
    identity_error (largest entry of the whitened covariance less the identity, over the vectors fitted).
    Rows with a null vector or a null or non-finite entry take no part; empty vectors have no component.
    Vectors of different dimension are fitted apart. Repeated vectors are fitted once and returned each;
    null keys are kept. Components without variance (fewer distinct vectors than components, or only
    one) can't be scaled to unit variance and are left out. An empty table gives no rows. Further
    columns are left aside, whatever their names.
    """
    rows = integers(vectors, scale, key, vector)
    models = fit_whitening(rows, components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in _by_dimension(batch.column(1)):
                model = models.get(x.shape[1])
                if model is None:
                    continue
                k = model.weights.shape[1]
                scores = model.center.centred(x) @ model.weights
                off = pa.array(model.center.deviations(x), pa.int64())
                each = pa.array(np.repeat(np.arange(len(x)), k))
                size = len(x) * k
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(places)).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(size, model.center.n, dtype=np.int64)), off.take(each),
                        pa.array(scores.reshape(-1)), pa.array(np.tile(model.explained, len(x))),
                        pa.array(np.full(size, model.identity_error)),
                    ],
                    names=[c.split()[0] for c in OUT.split(", ")],
                )

    return rows.mapInArrow(project, OUT)
