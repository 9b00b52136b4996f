"""Embedding whitening with components found by contour integration (FEAST).

Spark counts, sums and multiplies over the vectors; what reaches the driver is one covariance
matrix, of the dimensions squared. There, inertia counts (signs of a symmetric factorisation of
shifted covariances) give intervals with known numbers of eigenvalues; a quadrature of complex
shifted solves along a circle through each interval projects random vectors onto its
eigenvectors, Rayleigh-Ritz extracts them, and the count must be the one of the inertia.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer.llm.common import cut, share, shared

#: nodes of the quadrature on half of the circle; the other half is their mirror image
NODES = 12
_EPS = float(np.finfo(np.float64).eps)


def positive_eigenvalues(a: np.ndarray) -> int:
    """Inertia: how many eigenvalues of a symmetric matrix are above zero, by the signs of a
    factorisation with complete pivoting (blocks of one or two rows)."""
    a, at, count = a.copy(), 0, 0
    share_of_diagonal = (1 + math.sqrt(17)) / 8
    while at < len(a):
        rest = a[at:, at:]
        single = int(np.argmax(np.abs(np.diag(rest))))
        off = np.abs(np.tril(rest, -1))
        row, column = np.unravel_index(int(np.argmax(off)), off.shape)
        one, two = abs(rest[single, single]), off[row, column]
        if max(one, two) == 0:
            break
        wide = one < share_of_diagonal * two
        for place, wanted in ((0, column), (1, row)) if wide else ((0, single),):  # column < row
            order = np.arange(len(rest))
            order[[place, wanted]] = order[[wanted, place]]
            rest[:] = rest[np.ix_(order, order)]
        size = 2 if wide else 1
        pivot, below = rest[:size, :size], rest[size:, :size]
        count += 1 if wide else int(pivot[0, 0] > 0)  # a block of two has one sign of each
        rest[size:, size:] -= below @ np.linalg.solve(pivot, below.T)
        at += size
    return count


def above(a: np.ndarray, shift: float) -> int:
    return positive_eigenvalues(a - shift * np.eye(len(a)))


def intervals(a: np.ndarray, wanted: int, per_interval: int = 8) -> list[tuple[float, float, int]]:
    """(low, high, count) from the top down, without gaps, that hold the ``wanted`` greatest
    eigenvalues, each end in a gap of the spectrum and about ``per_interval`` in each. Equal ones
    are never separated, so the last may hold more than asked for. Found by inertia alone."""
    top = float(np.abs(a).sum(axis=1).max()) * (1 + 1e-9)  # no eigenvalue is above that
    low_end = len(a) * _EPS * top

    def edge(rank: int, high: float) -> tuple[float, int]:
        """A shift in the first gap with ``rank`` eigenvalues or more above it."""
        low, n_low = low_end, above(a, low_end)
        while n_low > rank and high - low > 64 * _EPS * top:
            middle = (low + high) / 2
            n = above(a, middle)
            if n >= rank:
                low, n_low = middle, n
            else:
                high = middle
        if n_low > rank and high - low <= 64 * _EPS * top:  # equal eigenvalues: go below all of them
            return edge(n_low, high)
        if low == low_end:
            return low, n_low
        # into the middle of the gap: down to the next eigenvalue, up to the one just found
        down, up = (low_end, low), (low, high)
        for _ in range(12):
            middle = sum(down) / 2
            down = (middle, down[1]) if above(a, middle) > n_low else (down[0], middle)
            middle = sum(up) / 2
            up = (middle, up[1]) if above(a, middle) == n_low else (up[0], middle)
        return (down[1] + up[0]) / 2, n_low

    wanted = min(wanted, above(a, low_end))
    found, high, done = [], top, 0
    while done < wanted:
        low, n = edge(min(wanted, done + per_interval), high)
        found.append((low, high, n - done))
        high, done = low, n
    return found


def _projected(a: np.ndarray, low: float, high: float, y: np.ndarray) -> np.ndarray:
    """The contour integral of the resolvent over the circle through low and high, applied to y."""
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(y)
    for node, weight in zip(*np.polynomial.legendre.leggauss(NODES)):
        turn = radius * np.exp(0.5j * np.pi * (node + 1))
        out += 0.5 * weight * np.real(turn * np.linalg.solve((centre + turn) * np.eye(len(a)) - a, y))
    return out


def feast(a: np.ndarray, low: float, high: float, count: int, rounds: int = 60, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues (falling) between low and high, and their unit vectors as columns.

    The subspace is wider than ``count``, so that eigenvalues near the ends of the interval don't
    slow it down. Rounds end when the residuals are those of double precision.
    """
    size, width = len(a), min(len(a), 2 * count + 4)
    scale = float(np.abs(a).sum(axis=1).max())
    y, last = np.random.default_rng(seed).normal(size=(size, width)), math.inf
    for _ in range(rounds):
        q = np.linalg.qr(_projected(a, low, high, y))[0]
        e, u = np.linalg.eigh(q.T @ a @ q)
        y = q @ u
        inside = np.flatnonzero((e > low) & (e < high))
        off = np.linalg.norm(a @ y[:, inside] - y[:, inside] * e[inside], axis=0)
        worst = float(off.max()) / scale if len(inside) == count else math.inf
        if worst <= 2 * _EPS or worst <= 64 * _EPS and worst > last / 2:
            return e[inside][::-1], y[:, inside][:, ::-1]
        last = worst
    if len(inside) == count and worst <= 1e-12:
        return e[inside][::-1], y[:, inside][:, ::-1]
    raise ArithmeticError(f"contour integration found {len(inside)} of {count} eigenvalues in ({low}, {high}), residual {worst}")


def principal(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues of a covariance matrix and their unit vectors as
    columns; fewer if no more are above zero in double precision."""
    found = [feast(a, *part) for part in intervals(a, wanted)] if a.any() else []
    if not found:
        return np.zeros(0), np.zeros((len(a), 0))
    e, u = np.concatenate([e for e, _ in found])[:wanted], np.concatenate([u for _, u in found], axis=1)[:, :wanted]
    return e, u * np.where(u[np.abs(u).argmax(axis=0), np.arange(len(e))] < 0, -1, 1)  # one sign on every run


def _matrices(column: pa.Array):
    """(rows, matrix) for each length of vectors in a column of lists."""
    lengths = np.array([len(v) for v in column], np.int64)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), length)


def _exact_sums(fit: DataFrame) -> DataFrame:
    """(length, i, s): sums per dimension as decimals, added up as integers in two halves."""

    def run(batches):
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
                for i, (h, l) in enumerate(zip(high.tolist(), low.tolist())):
                    sums[x.shape[1], i] = sums.get((x.shape[1], i), 0) + (h << 32) + l
        keys = list(sums)
        arrays = [pa.array([k[j] for k in keys], pa.int32()) for j in (0, 1)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array([Decimal(sums[k]) for k in keys], pa.decimal128(38, 0))], ["length", "i", "s"])

    return fit.select("x").mapInArrow(run, "length int, i int, s decimal(38,0)").groupBy("length", "i").agg(F.sum("s").alias("s"))


def _products(fit: DataFrame, models, rows_of) -> DataFrame:
    """(length, i, j, s): sums of products of the columns that ``rows_of(model, x)`` gives, for
    i <= j; (length, i, -1, s): sums of the columns."""

    def run(batches):
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                rows = rows_of(shared(models)[x.shape[1]], x)
                own = sums.setdefault(x.shape[1], [0.0, 0.0])
                own[0] = own[0] + rows.sum(axis=0)
                own[1] = own[1] + rows.T @ rows
        for length, (single, both) in sums.items():
            i, j = np.triu_indices(len(single))
            arrays = [
                np.full(len(i) + len(single), length), np.concatenate([i, np.arange(len(single))]),
                np.concatenate([j, np.full(len(single), -1)]), np.concatenate([both[i, j], single]),
            ]
            types = (pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(arrays, types)], ["length", "i", "j", "s"])

    parts = fit.select("x").mapInArrow(run, "length int, i int, j int, s double")
    return parts.groupBy("length", "i", "j").agg(F.sum("s").alias("s"))


class Fit:
    """What whitening needs of the vectors of one length."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.mean = np.array([s / n for s in sums])  # rounded once
        self.values, self.directions, self.trace, self.error = np.zeros(0), np.zeros((len(sums), 0)), 0.0, 0.0
        self.shift = np.zeros(0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - self.mean

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.directions / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n x - S)^2, in integers."""
        most = max(int(np.abs(x).astype(np.float64).max()) * self.n + max(map(abs, self.sums)), 1)
        if most * most * x.shape[1] < 1 << 62:
            d = x * self.n - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        return [sum((v * self.n - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]


def _matrix(rows: dict[tuple[int, int], float], size: int, n: int) -> np.ndarray:
    out = np.zeros((size, size))
    for (i, j), s in rows.items():
        if j >= 0:
            out[i, j] = out[j, i] = s / n
    return out


def _by_length(summed: DataFrame) -> dict[int, dict]:
    out: dict[int, dict] = {}
    for length, *key, s in summed.collect():
        out.setdefault(length, {})[tuple(key)] = s
    return out


def whiten(vectors: DataFrame, components: int = 4, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """One row per usable vector and component: ``vec_id``, ``component`` (int, from 1), ``n``
    (bigint), ``deviation`` (decimal(38,0)), ``whitened``, ``explained``, ``identity_error``
    (doubles).

    Vectors that are null or hold null, NaN or infinite entries have no rows. Entries become
    x = floor(scale * entry), limited to the range of bigint. The fit list is each distinct x once:
    n vectors with sums S. Components are the unit eigenvectors of the list's covariance (divisor
    n), by falling eigenvalue e; ``whitened`` is x - S/n projected on one, over sqrt(e);
    ``explained`` is e over the trace; ``deviation`` the exact sum of (n x - S)^2, null beyond 38
    digits; ``identity_error`` the largest absolute entry of the whitened list's covariance minus
    the identity.

    Vectors of different lengths are fitted apart. Components without variance (fewer distinct
    vectors or dimensions than ``components``) are left out, so a list of one vector gives no
    rows; of equal eigenvalues any orthogonal set serves. Repeated rows and null ids are rows like
    others; other columns are ignored. The driver gets sums and one covariance per length: as
    many numbers as dimensions squared, however many vectors there are.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = rows.where(F.coalesce((F.size("v") > 0) & F.forall("v", finite), F.lit(False)))
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("x"))
    fit = cut(rows.select("x").distinct(), "distinct-vectors")
    counts = {length: n for length, n in fit.groupBy(F.size("x")).count().collect()}
    sums = _by_length(_exact_sums(fit))
    fits = {length: Fit(n, [int(sums[length][i,]) for i in range(length)]) for length, n in counts.items()}

    products = _by_length(_products(fit, share(spark, fits), lambda f, x: f.centred(x)))
    for length, f in fits.items():
        covariance = _matrix(products[length], length, f.n)
        f.trace = float(np.trace(covariance))
        f.values, f.directions = principal(covariance, components)
    # the whitened list's covariance, with its own mean
    means = _by_length(_products(fit, share(spark, fits), lambda f, x: f.whitened(x)))
    for length, f in fits.items():
        f.shift = np.array([means[length][i, -1] / f.n for i in range(len(f.values))])
    products = _by_length(_products(fit, share(spark, fits), lambda f, x: f.whitened(x) - f.shift))
    for length, f in fits.items():
        if len(f.values):
            f.error = float(np.abs(_matrix(products[length], len(f.values), f.n) - np.eye(len(f.values))).max())

    models = share(spark, fits)
    most = 10**38 - 1

    def project(batches):
        for batch in batches:
            for at, x in _matrices(batch.column(1)):
                f = shared(models)[x.shape[1]]
                k = len(f.values)
                if not k:
                    continue
                deviations = [Decimal(d) if d <= most else None for d in f.deviations(x) for _ in range(k)]
                repeated = pa.array(np.repeat(at, k))
                arrays = [
                    batch.column(0).take(repeated), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()),
                    pa.array(np.full(len(at) * k, f.n), pa.int64()), pa.array(deviations, pa.decimal128(38, 0)),
                    pa.array(f.whitened(x).ravel()), pa.array(np.tile(f.values / f.trace, len(at))), pa.array(np.full(len(at) * k, f.error)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names)

    new = T.StructType.fromDDL("component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    schema = T.StructType([rows.schema["vec_id"], *new])
    names = schema.names
    return rows.mapInArrow(project, schema)
