"""Whitening of vectors along their strongest directions, found by contour integration (FEAST).

Entries become whole numbers first, so sums and products over all vectors are
exact and alike in any order; tasks send sums of squares of their own rows, a
number for each pair of dimensions. The covariance, dimensions by dimensions,
is all that the driver holds.

Its eigenvalues are counted below any number by inertia. The spectrum is cut
into intervals from above until enough are found. For each, a quadrature of
shifted solves around a circle through the interval's ends projects random
vectors onto its eigenvectors, Rayleigh-Ritz extracts them, and both repeat
until residuals are at rounding. An interval must yield as many as inertia counts.

Defined results: a vector that is null, empty or holds null, NaN, infinite or
(scaled) 2^53 or more has no part; nor has one of another length than most
have (of equally frequent lengths the largest counts). Repeated rows count as
often as they are there, ids may be null. Directions without variance, beyond
rounding, have null for ``whitened`` and 0 for ``explained``. An empty table
gives an empty result. A direction's largest entry, of equal ones the first, is
positive. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = float(np.finfo(np.float64).eps)
LONG = 1 << 63


@dataclass(frozen=True)
class WhiteningConfig:
    components: int = 8
    #: An entry c is floor(scale * c) + shift.
    scale: float = 1024.0
    shift: int = 100_000
    #: Points on the upper half of a circle.
    points: int = 16
    #: Ratio of the ends of an interval, and most eigenvalues in it.
    ratio: float = 4.0
    most_inside: int = 16
    most_rounds: int = 40
    seed: int = 11


def whole_numbers(batch: pa.RecordBatch, size: int, config: WhiteningConfig) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of (id, vector) have a part, and their vectors as whole numbers."""
    vectors = batch.column(1)
    good = np.asarray(vectors.is_valid()) & (np.asarray(vectors.value_lengths().fill_null(0)) == size)
    own = vectors.filter(pa.array(good))
    flat = own.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, size)  # null entries are NaN here
    whole = np.floor(values * config.scale) + config.shift
    fine = (np.abs(whole) < 2.0**53).all(axis=1) & np.isfinite(values).all(axis=1)
    at = np.flatnonzero(good)[fine]
    return at, whole[fine].astype(np.int64)


def _exact_sum(values: np.ndarray) -> list[int]:
    """Sums of columns, exactly."""
    high, low = values >> 26, values & ((1 << 26) - 1)
    return [(int(h) << 26) + int(x) for h, x in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]


def squares(values: np.ndarray) -> np.ndarray:
    """``values.T @ values`` as Python's numbers, exactly; entries must be under 2^53."""
    size = values.shape[1]
    total = np.zeros((size, size), dtype=object)
    most = int(np.abs(values).max(initial=0))
    if most >= 1 << 26:  # halves of 26 bits are multiplied apart
        high, low = values >> 26, values & ((1 << 26) - 1)
        hh, both = squares(high), squares(np.concatenate([high, low], axis=1))
        cross = both[:size, size:]
        return hh * (1 << 52) + (cross + cross.T) * (1 << 26) + both[size:, size:]
    rows = max(1, (1 << 53) // max(1, most * most))
    for a in range(0, len(values), rows):
        part = values[a : a + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _sums(size: int, config: WhiteningConfig):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for batch in batches:
            at, values = whole_numbers(batch, size, config)
            n += len(at)
            total = [a + b for a, b in zip(total, _exact_sum(values), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(map(str, total))], ["at", "n", "s"])

    return rows


def _products(centre: np.ndarray, config: WhiteningConfig):
    size = len(centre)
    i, j = np.triu_indices(size)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), dtype=object)
        for batch in batches:
            total = total + squares(whole_numbers(batch, size, config)[1] - centre)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(x) for x in total[i, j]])], ["i", "j", "s"])

    return rows


class Inertia:
    """How many eigenvalues of a symmetric matrix are below a number: signs of the pivots of its tridiagonal form."""

    def __init__(self, matrix: np.ndarray):
        a = matrix.copy()
        for k in range(len(a) - 2):  # Householder's reflections
            x = a[k + 1 :, k].copy()
            x[0] += np.copysign(np.linalg.norm(x), x[0])
            length = np.linalg.norm(x)
            if length:
                x /= length
                a[k + 1 :] -= 2 * np.outer(x, x @ a[k + 1 :])
                a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        self.diagonal, self.beside = np.diag(a).tolist(), (np.diag(a, 1) ** 2).tolist()

    def below(self, s: float) -> int:
        count, pivot = 0, 1.0
        for d, b in zip(self.diagonal, [0.0, *self.beside], strict=True):
            pivot = d - s - b / pivot
            if abs(pivot) < 1e-300:
                pivot = -1e-300
            count += pivot < 0
        return count


def _contour(matrix: np.ndarray, start: np.ndarray, low: float, high: float, points: int) -> np.ndarray:
    """Gauss-Legendre quadrature of the resolvent around the circle through ``low`` and ``high``, applied to ``start``.

    The lower half of the circle is the conjugate of the upper.
    """
    centre, radius = (low + high) / 2, (high - low) / 2
    at, weight = np.polynomial.legendre.leggauss(points)
    out = np.zeros_like(start)
    for x, w in zip(at, weight, strict=True):
        turn = np.exp(0.5j * np.pi * (x + 1))
        shifted = (centre + radius * turn) * np.eye(len(matrix)) - matrix
        out += w / 2 * (radius * turn * np.linalg.solve(shifted, start.astype(np.complex128))).real
    return out


def _in_interval(matrix: np.ndarray, low: float, high: float, count: int, config: WhiteningConfig) -> np.ndarray:
    """The ``count`` eigenvectors of eigenvalues in an interval, as columns."""
    n = len(matrix)
    size = min(n, 2 * count + 8)
    while True:
        block = np.random.default_rng(config.seed).standard_normal((n, size))
        before = np.inf
        for _ in range(config.most_rounds):
            basis = np.linalg.qr(_contour(matrix, block, low, high, config.points))[0]
            values, turns = np.linalg.eigh(basis.T @ matrix @ basis)
            block = basis @ turns
            inside = (values > low) & (values < high)
            found = block[:, inside]
            worst = np.linalg.norm(matrix @ found - found * values[inside], axis=0).max(initial=0)
            if inside.sum() == count and (worst < 8 * EPS or worst > before / 2 and worst < 1e-12):
                return found
            before = worst
        if size == n:
            raise RuntimeError(f"{int(inside.sum())} of {count} eigenvectors between {low} and {high} settled")
        size = min(n, 2 * size)


def leading(matrix: np.ndarray, config: WhiteningConfig = WhiteningConfig()) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; only those over rounding."""
    norm = float(np.abs(matrix).sum(axis=1).max(initial=0))
    if norm == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    scaled = matrix / norm
    inertia, n = Inertia(scaled), len(matrix)
    floor = 8 * n * EPS

    def clear(s: float) -> float:
        """A number close to ``s`` and not within a millionth of an eigenvalue."""
        for k in range(200):
            at = s * (1 - 0.003 * k)
            if inertia.below(at * (1 - 1e-6)) == inertia.below(at * (1 + 1e-6)):
                return at
        return s

    wanted = min(config.components, n - inertia.below(floor))
    # The top is clear of all; intervals reach down from it.
    parts, high = [], 1.01
    while sum(p[2] for p in parts) < wanted:
        low = clear(max(high / config.ratio, floor))
        count = inertia.below(high) - inertia.below(low)
        while count > config.most_inside and high / low > 1.001:
            low = clear((low * high) ** 0.5)
            count = inertia.below(high) - inertia.below(low)
        if count:
            parts.append((low, high, count))
        high = low
        if low <= floor:
            break
    found = np.concatenate([np.zeros((n, 0)), *[_in_interval(scaled, *p, config) for p in parts]], axis=1)
    basis = np.linalg.qr(found)[0]
    values, turns = np.linalg.eigh(basis.T @ scaled @ basis)
    order = np.argsort(-values)[:wanted]
    vectors = (basis @ turns)[:, order]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] if len(order) else np.zeros(0)
    return values[order] * norm, vectors * np.where(largest < 0, -1, 1)


@dataclass(frozen=True)
class Whitening:
    n: int
    #: Sums of the whole numbers, and whole numbers next to the means.
    sums: list[int]
    centre: np.ndarray
    covariance: np.ndarray
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def beyond(self) -> np.ndarray:
        """The means less ``centre``."""
        return np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.centre, strict=True)])


def fit(vectors: DataFrame, config: WhiteningConfig = WhiteningConfig()) -> Whitening | None:
    """Directions of ``vectors``, an id and an array of numbers; nothing if none has a part."""
    lengths = vectors.groupBy(F.size(vectors.columns[1]).alias("size")).count().where("size > 0")
    top = lengths.orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not top:
        return None
    size = top[0]["size"]
    sums = vectors.mapInArrow(_sums(size, config), "at int, n long, s string").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    # A row for each dimension.
    rows = sorted(sums.collect())
    n, total = int(rows[0]["n"]), [int(r["s"]) for r in rows]
    if not n:
        return None
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
    products = vectors.mapInArrow(_products(centre, config), "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    covariance = np.zeros((size, size))
    rest = [s - n * int(c) for s, c in zip(total, centre, strict=True)]
    for i, j, s in products.collect():  # a row for each two dimensions
        covariance[i, j] = covariance[j, i] = (n * int(s) - rest[i] * rest[j]) / (n * n)
    eigenvalues, directions = leading(covariance, config)
    return Whitening(n, total, centre, covariance, eigenvalues, directions, float(np.trace(covariance)))


def _projected(values: np.ndarray, model: Whitening) -> np.ndarray:
    return ((values - model.centre) - model.beyond) @ (model.vectors / np.sqrt(model.eigenvalues))


def _deviations(values: np.ndarray, model: Whitening) -> list[int | None]:
    """Exactly; null where it is no long."""
    rest = [s - model.n * int(c) for s, c in zip(model.sums, model.centre, strict=True)]
    apart = values - model.centre
    most = model.n * int(np.abs(apart).max(initial=0)) + max(map(abs, rest))
    if most * most * len(rest) < LONG:
        return (((model.n * apart - np.array(rest, np.int64)) ** 2).sum(axis=1)).tolist()
    found = [sum((model.n * int(x) - r) ** 2 for x, r in zip(row, rest, strict=True)) for row in apart.tolist()]
    return [v if v < LONG else None for v in found]


def identity_error(vectors: DataFrame, model: Whitening, config: WhiteningConfig = WhiteningConfig()) -> float:
    """How far the covariance of what ``whiten`` makes is from the identity, at its worst entry."""
    size, k = len(model.centre), len(model.eigenvalues)
    if not k:
        return 0.0
    i, j = np.triu_indices(k)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            own = _projected(whole_numbers(batch, size, config)[1], model)
            first += own.sum(axis=0)
            second += own.T @ own
        # Sums themselves have -1 for a partner.
        left, right = np.r_[np.arange(k), i], np.r_[np.full(k, -1), j]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(np.r_[first, second[i, j]])], ["i", "j", "s"])

    found = {(r["i"], r["j"]): r["s"] / model.n for r in vectors.mapInArrow(rows, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    return max(abs(found[a, b] - found[a, -1] * found[b, -1] - (a == b)) for a, b in zip(i.tolist(), j.tolist(), strict=True))


def whiten(vectors: DataFrame, config: WhiteningConfig = WhiteningConfig()) -> DataFrame:
    """A row for each row of ``vectors`` (an id and an array of numbers) that has a part, and each component."""
    key = vectors.schema[0].name
    kind = vectors.schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, config)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size, k = len(model.centre), len(model.eigenvalues)
    count = min(config.components, size)
    error = identity_error(vectors, model, config)
    explained = np.r_[model.eigenvalues / model.trace if k else np.zeros(0), np.zeros(count - k)]
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = whole_numbers(batch, size, config)
            made = np.zeros((len(at), count))
            made[:, :k] = _projected(values, model)
            none = np.tile(np.arange(count) >= k, len(at))
            each = pa.array(np.repeat(np.arange(len(at)), count))
            columns = [
                batch.column(0).take(pa.array(at)).take(each),
                pa.array(np.tile(np.arange(1, count + 1), len(at)), pa.int32()),
                pa.array(np.full(len(each), model.n), pa.int64()),
                pa.array(_deviations(values, model), pa.int64()).take(each),
                pa.array(made.ravel(), mask=none),
                pa.array(np.tile(explained, len(at))),
                pa.array(np.full(len(each), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return vectors.mapInArrow(rows, schema)
