"""Whitening of embeddings by spectrum slicing.

1. Vectors become integers, ``x = floor(64 c) + 1000000``; the fit list has each distinct x vector once. Its covariance is exact:
   rows are centred at the rounded mean before they are multiplied, products are summed as integers inside tasks and then by
   cells of the matrix, and the rest of the mean is taken off in rational arithmetic. What comes to the driver has a size in dimensions.
2. An LDL' factorisation of the covariance less a shift has as many positive pivots as there are eigenvalues above the shift
   (Sylvester's law of inertia). Bisection on these counts isolates each leading eigenvalue; where two can't be told apart at
   ``CLUSTER`` of the largest, they are taken together.
3. Rayleigh quotient iteration starts inside the interval of an eigenvalue and converges cubically; each step solves with an LDL'
   factorisation too. A result outside its interval is refused and the interval halved again. At last the counts on both
   sides of every eigenvalue certify its number.
4. Every row is projected on the components where it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covarium.llm import shared

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Eigenvalues closer than this share of the largest count as one of higher multiplicity; below FLAT of the trace there is no component.
CLUSTER, FLAT = 1e-12, 1e-10
#: The driver and each task hold matrices of this many dimensions at most.
MOST_DIMENSIONS = 2_048


# --- LDL' factorisation and the slicing of a spectrum ----------------------------------------------

_ALPHA = (1 + 17**0.5) / 8


class Factor:
    """P' A P = L D L' of a symmetric matrix, with pivots of size 1 and 2 (Bunch and Kaufman)."""

    def __init__(self, a: np.ndarray) -> None:
        a = np.array(a, float)
        n = len(a)
        self.order, self.lower, self.blocks = np.arange(n), np.eye(n), []
        k = 0
        while k < n:
            size = 1
            if k + 1 < n:
                r = k + 1 + int(np.abs(a[k + 1 :, k]).argmax())
                below, own = abs(a[r, k]), abs(a[k, k])
                if own < _ALPHA * below:
                    row = np.abs(a[r, k:])
                    row[r - k] = 0
                    most = row.max()
                    if own * most < _ALPHA * below * below:
                        if abs(a[r, r]) >= _ALPHA * most:
                            self._swap(a, k, r, k)
                        else:
                            size = 2
                            self._swap(a, k + 1, r, k)
            at, rest = slice(k, k + size), slice(k + size, n)
            d = a[at, at].copy()
            if size == 1 and d[0, 0] == 0:
                self.blocks.append((k, d))
            else:
                low = a[rest, at] / d[0, 0] if size == 1 else np.linalg.solve(d, a[at, rest]).T
                self.lower[rest, at] = low
                a[rest, rest] -= low @ a[at, rest]
                self.blocks.append((k, d))
            k += size

    def _swap(self, a: np.ndarray, i: int, j: int, done: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            self.order[[i, j]] = self.order[[j, i]]
            self.lower[[i, j], :done] = self.lower[[j, i], :done]

    def positive(self) -> int:
        """The number of positive eigenvalues."""
        count = 0
        for _, d in self.blocks:
            if len(d) == 1:
                count += d[0, 0] > 0
            else:
                det, trace = d[0, 0] * d[1, 1] - d[0, 1] * d[1, 0], d[0, 0] + d[1, 1]
                count += 1 if det < 0 else 2 * (trace > 0)
        return int(count)

    def solve(self, b: np.ndarray, tiny: float) -> np.ndarray:
        """A x = b; zero pivots count as ``tiny``."""
        n = len(b)
        y = np.array(b, float)[self.order]
        for i in range(n):
            y[i] -= self.lower[i, :i] @ y[:i]
        for k, d in self.blocks:
            if len(d) == 1:
                y[k] /= d[0, 0] if abs(d[0, 0]) > tiny else tiny
            else:
                y[k : k + 2] = np.linalg.solve(d, y[k : k + 2])
        for i in range(n - 1, -1, -1):
            y[i] -= self.lower[i + 1 :, i] @ y[i + 1 :]
        out = np.empty_like(y)
        out[self.order] = y
        return out


@dataclass
class Slice:
    """Eigenvalues ``first`` to ``last`` (from 1, falling), the only ones in (low, high]."""

    first: int
    last: int
    low: float
    high: float


class Spectrum:
    """Leading eigenvalues and eigenvectors of a symmetric, positive semidefinite matrix."""

    def __init__(self, a: np.ndarray) -> None:
        self.a = a
        self.size = float(np.abs(a).sum(axis=1).max()) if len(a) else 0.0
        self.counts: dict[float, int] = {}

    def above(self, shift: float) -> int:
        """The number of eigenvalues above ``shift``, by inertia."""
        if shift not in self.counts:
            self.counts[shift] = Factor(self.a - shift * np.eye(len(self.a))).positive()
        return self.counts[shift]

    def slices(self, k: int, floor: float) -> list[Slice]:
        """Intervals with one eigenvalue each, or several that can't be told apart, for the leading ``k`` above ``floor``."""
        k = min(k, self.above(floor))
        out: list[Slice] = []
        open_ = [Slice(1, self.above(floor), floor, 1.01 * self.size)] if k else []
        while open_:
            s = open_.pop()
            if s.first > k:
                continue
            if s.first == s.last or s.high - s.low <= CLUSTER * self.size:
                out.append(s)
                continue
            middle = (s.low + s.high) / 2
            above = self.above(middle)
            if above >= s.first:
                open_.append(Slice(s.first, min(above, s.last), middle, s.high))
            if above < s.last:
                open_.append(Slice(max(above + 1, s.first), s.last, s.low, middle))
        return sorted(out, key=lambda s: s.first)

    def _halved(self, s: Slice) -> Slice:
        middle = (s.low + s.high) / 2
        return Slice(s.first, s.last, middle, s.high) if self.above(middle) >= s.last else Slice(s.first, s.last, s.low, middle)

    def _away(self, v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            for u in others:
                v = v - (u @ v) * u
        return v / np.linalg.norm(v)

    def iterate(self, s: Slice, v: np.ndarray, others: list[np.ndarray]) -> tuple[float, np.ndarray, bool]:
        """Rayleigh quotient iteration from ``v``; whether it ended, inside the interval."""
        eye, tiny, best = np.eye(len(self.a)), np.finfo(float).eps * self.size, np.inf
        shift = (s.low + s.high) / 2
        for step in range(12):
            v = self._away(Factor(self.a - shift * eye).solve(v, tiny), others)
            value = float(v @ self.a @ v)
            residual = float(np.linalg.norm(self.a @ v - value * v))
            inside = s.low < value <= s.high
            if residual <= 4 * tiny or (step and inside and residual >= best / 2 and residual <= 1e-11 * self.size):
                return value, v, inside
            best = min(best, residual)
            shift = value if inside else shift
        return value, v, False

    def leading(self, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(values, unit vectors in columns) of the leading ``k`` eigenvalues above ``floor``, their numbers certified by counts."""
        rng = np.random.default_rng(7)
        values: list[float] = []
        vectors: list[np.ndarray] = []
        for s in self.slices(k, floor):
            for number in range(s.first, min(s.last, k) + 1):
                interval = s
                for _ in range(60):
                    near = [u for e, u in zip(values, vectors, strict=True) if e - interval.high < 1e-3 * self.size or s.first != s.last]
                    start = self._away(rng.standard_normal(len(self.a)), near)
                    value, v, good = self.iterate(interval, start, near)
                    if good or interval.high - interval.low <= CLUSTER * self.size:
                        break
                    interval = self._halved(interval)
                values.append(value)
                vectors.append(v)
            self._certify(s, values[s.first - 1 :])
        order = np.argsort(-np.array(values), kind="stable") if values else []
        return np.array([values[i] for i in order]), np.stack([vectors[i] for i in order], axis=1) if len(order) else np.zeros((len(self.a), 0))

    def _certify(self, s: Slice, found: list[float]) -> None:
        """Raise unless the counts beside the values found are those of their numbers."""
        margin = 1e-10 * self.size
        for value in found:
            if self.above(value + margin) > s.last - 1 or self.above(value - margin) < s.first:
                raise ArithmeticError(f"an eigenvalue near {value} doesn't have number {s.first}")


# --- Covariance over the fit list ------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    """(rows, dimensions) of a list column without nulls; lists of several lengths raise."""
    at = column.offsets.to_numpy()
    width = np.diff(at)
    if len(width) and (width != width[0]).any():
        raise ValueError("vectors have several lengths; whitening needs one")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), int(width[0]) if len(width) else 0)


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of rows whose vector isn't null and has no null or non-finite entry; vectors without entries have no components and go."""
    shared.narrow_batches(vectors.sparkSession)
    c = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    rows = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    return rows.select("vec_id", F.transform(c, lambda x: (F.floor(x * SCALE) + OFFSET).cast("long")).alias("x"))


def _sum_parts(rows: DataFrame, cells, keys: str) -> dict[tuple[int, ...], int]:
    """Sum integers by cell exactly: each task gives its own sums as a high and a low part of 32 bits. ``cells(matrix)`` gives an int64 or object array of sums of a batch."""
    names = keys.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = cells(_matrix(batch.column("x"))).astype(object)
                total = part if total is None else total + part
        if total is None:
            return
        index = np.indices(total.shape).reshape(total.ndim, -1)
        if total.ndim == 2:  # symmetric
            index = index[:, index[0] <= index[1]]
        found = [total[tuple(i)] for i in index.T]
        yield pa.RecordBatch.from_arrays([*[pa.array(i.astype(np.int32)) for i in index], pa.array([v >> 32 for v in found], pa.int64()), pa.array([v & 0xFFFFFFFF for v in found], pa.int64())], [*names, "high", "low"])

    schema = ", ".join(f"{k} int" for k in names) + ", high long, low long"
    summed = rows.select("x").mapInArrow(run, schema).groupBy(*names).agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return {tuple(r[k] for k in names): (r["high"] << 32) + r["low"] for r in summed.toLocalIterator()}


def _gram(z: np.ndarray) -> np.ndarray:
    """Z' Z exactly."""
    most = int(np.abs(z).max(initial=0))
    if most * most * max(len(z), 1) < 1 << 53:
        y = z.astype(float)
        return np.rint(y.T @ y).astype(np.int64)
    y = z.astype(object)
    return y.T @ y


@dataclass
class Fit:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(deviations, whitened) of rows of x."""
        sums = np.array(self.sums, object)
        most = max(int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums), 1)
        centred = self.n * x - sums.astype(np.int64) if 2 * most < 1 << 62 else self.n * x.astype(object) - sums
        peak = int(np.abs(centred).max(initial=0))
        squares = (centred * centred).sum(axis=1) if peak * peak * x.shape[1] < 1 << 62 else (centred.astype(object) ** 2).sum(axis=1)
        if len(squares) and max(squares) >= 1 << 63:
            raise OverflowError("a deviation is beyond 64 bits")
        return squares.astype(np.int64), (centred / self.n).astype(float) @ (self.vectors / np.sqrt(self.values))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Fit:
    """Moments and leading components of ``distinct(x)``, rows that are all different."""
    n = distinct.count()
    if not n:
        return Fit(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    first = _sum_parts(distinct, lambda x: x.sum(axis=0) if np.abs(x).max(initial=0) < 1 << 40 else x.astype(object).sum(axis=0), "i")
    d = len(first)
    if d > MOST_DIMENSIONS:
        raise ValueError(f"a covariance of {d} dimensions is too large for the driver")
    sums = [first[(i,)] for i in range(d)]
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    products = _sum_parts(distinct, lambda x: _gram(x - middle), "i, j")
    rest = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]  # of the mean, after rounding
    v = np.zeros((d, d))
    for (i, j), p in products.items():
        v[i, j] = v[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
    trace = float(np.trace(v))
    values, vectors = Spectrum(v).leading(components, FLAT * trace) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    return Fit(n, sums, values, vectors, trace)


def _identity_error(distinct: DataFrame, f: Fit) -> float:
    """The largest absolute entry of the covariance of the whitened fit list, less the identity."""
    k = len(f.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                y = f.project(_matrix(batch.column("x")))[1]
                total[:k] += y.T @ y
                total[k] += y.sum(axis=0)
        i, j = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "s"])

    total = np.zeros((k + 1, k))
    for r in distinct.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
        total[r["i"], r["j"]] = r["s"]
    mean = total[k] / f.n
    return float(np.abs(total[:k] / f.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of ``vectors(vec_id, embedding)``.

    A row for each usable row and component, ``components`` at most. Vectors that are null or hold null or non-finite entries have no
    rows; vectors without entries neither. Rows without vec_id and repeated rows are projected like all others; equal vectors
    count once in the fit. Components whose eigenvalue is below ``FLAT`` of the trace don't exist, so that an empty table, one
    vector or equal vectors give no rows. Equal eigenvalues have any basis of their space. Vectors of several lengths raise, as do entries
    and deviations beyond 64 bits. Other columns, whatever their names, go.
    """
    usable = _usable(vectors)
    distinct = shared.written(usable.select("x").distinct())
    f = fit(distinct, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    k = len(f.values)
    error = _identity_error(distinct, f) if k else 0.0
    explained = f.values / f.trace if k else f.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows if k else 0
            if not rows:
                continue
            deviation, white = f.project(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, f.n, np.int64)),
                    pa.array(np.repeat(deviation, k)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return usable.mapInArrow(run, schema)
