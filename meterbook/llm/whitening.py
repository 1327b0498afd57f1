"""Whitening of embeddings on the leading components of their covariance.

Every task adds up integers: entries become x = floor(1024 c) + 100000, sums and
products of x less a whole-numbered centre are exact, so the covariance is the same
however rows are split. The components come from spectrum slicing. The inertia of
V - s I, read off the pivots of its LDLᵀ factorization (Bunch and Kaufman), counts the
eigenvalues above s; bisection on the counts isolates each of the leading ones;
Rayleigh quotient iteration, which converges cubically, finds value and vector; counts
on both sides of the value certify its number. Where several eigenvalues agree to
rounding, any orthonormal basis of their space is right, and one is taken.

The driver holds one matrix of width x width, whose size does not follow the rows.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are
left out, as are vectors of another width than the commonest (of equally common ones,
the larger). Repeated rows and null ids are rows like others. Without remaining rows
there is no result row. A component without variance (its eigenvalue is below the
rounding error of the trace) has a null ``whitened``; ``explained`` is 0 then, or null if
nothing varies. A ``deviation`` beyond 64 bits is null. 1024 c is held to +-2^45.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .common import prepare, staged

COMPONENTS = 8
SCALE, OFFSET, MOST = 1024, 100_000, 2.0**45
#: Rows multiplied at once.
BLOCK = 1024
EPS = np.finfo(np.float64).eps
_ALPHA = (1 + 17**0.5) / 8


# Slicing the spectrum of one symmetric matrix


def inertia_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``shift``.

    By Sylvester's law as many as the positive pivots of an LDLᵀ factorization of
    ``matrix - shift I``, with pivots of size one and two.
    """
    a = matrix - shift * np.eye(len(matrix))
    tiny = EPS * max(float(np.abs(matrix).max(initial=0.0)), abs(shift), np.finfo(np.float64).tiny)
    above = 0
    while len(a):
        rest = np.abs(a[1:, 0])
        r = int(rest.argmax()) + 1 if len(rest) else 0
        largest = rest[r - 1] if len(rest) else 0.0
        size = 1
        if abs(a[0, 0]) < _ALPHA * largest:
            row = np.abs(a[r])
            row[r] = 0.0
            sigma = row.max()
            if abs(a[0, 0]) * sigma >= _ALPHA * largest**2:
                pass
            elif abs(a[r, r]) >= _ALPHA * sigma:
                _swap(a, 0, r)
            else:
                _swap(a, 1, r)
                size = 2
        if size == 1:
            pivot = a[0, 0] if abs(a[0, 0]) > tiny else -tiny
            above += pivot > 0
            a = a[1:, 1:] - np.outer(a[1:, 0], a[1:, 0] / pivot)
        else:  # such a pivot has one eigenvalue of each sign
            above += 1
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
    return int(above)


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray, nudge: float) -> np.ndarray:
    """(matrix - shift I)^-1 right; a shift that is an eigenvalue is moved by rounding."""
    for step in range(8):
        try:
            found = np.linalg.solve(matrix - (shift + step * nudge) * np.eye(len(matrix)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    return right


def _free(vector: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """The unit vector along the part that is orthogonal to the known ones."""
    for _ in range(2):
        for other in known:
            vector = vector - (vector @ other) * other
    norm = float(np.linalg.norm(vector))
    return vector / norm if norm > 0 else vector


def _rayleigh(matrix: np.ndarray, start: np.ndarray, low: float, high: float, known: list[np.ndarray], nudge: float):
    """Rayleigh quotient iteration from inverse iterations at the middle of an interval."""
    vector = start
    for _ in range(3):
        vector = _free(_solve(matrix, (low + high) / 2, vector, nudge), known)
    value = float(vector @ matrix @ vector)
    for _ in range(12):
        after = _free(_solve(matrix, value, vector, nudge), known)
        now = float(after @ matrix @ after)
        done = abs(now - value) <= nudge
        vector, value = after, now
        if done:
            break
    return value, vector


def leading_eigenpairs(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and their unit vectors as columns."""
    width = len(matrix)
    most = min(most, width)
    radius = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
    floor = float((np.diag(matrix) - radius).min(initial=0.0))
    ceiling = float((np.diag(matrix) + radius).max(initial=0.0))
    nudge = 4 * EPS * max(abs(floor), abs(ceiling), np.finfo(np.float64).tiny)
    counted: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counted:
            counted[shift] = inertia_above(matrix, shift)
        return counted[shift]

    margin = (ceiling - floor) * 1e-3 + nudge
    counted[floor - margin], counted[ceiling + margin] = width, 0
    values: list[float] = []
    vectors: list[np.ndarray] = []
    random = np.random.default_rng(11)
    while len(values) < most:
        number = len(values) + 1
        high = min(s for s, n in counted.items() if n < number)
        low = max(s for s, n in counted.items() if n >= number)
        start = random.standard_normal(width)
        while True:
            if above(low) - above(high) > 1 and high - low > 8 * nudge:
                middle = (low + high) / 2
                low, high = (middle, high) if above(middle) >= number else (low, middle)
                continue
            value, vector = _rayleigh(matrix, start, low, high, vectors, nudge)
            margin = 64 * nudge
            if above(value - margin) >= number > above(value + margin) or high - low <= 8 * nudge:
                break
            middle = (low + high) / 2  # led elsewhere: start from a narrower interval
            low, high = (middle, high) if above(middle) >= number else (low, middle)
        values.append(value)
        vectors.append(vector)
    order = np.argsort(-np.array(values), kind="stable")  # equal to rounding, found in either order
    return np.array(values)[order], np.array(vectors).reshape(most, width)[order].T


# Exact sums over the rows


def _rows(batch: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of usable vectors of one width, and their places in the batch."""
    offsets = batch.offsets.to_numpy()
    values = batch.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # nulls become nan
    sizes = np.diff(offsets)
    null = batch.is_null().to_numpy(zero_copy_only=False)
    for width in np.unique(sizes[~null & (sizes > 0)]):
        places = np.flatnonzero(~null & (sizes == width))
        for at in range(0, len(places), BLOCK):
            part = places[at : at + BLOCK]
            found = values[offsets[part][:, None] + np.arange(width)]
            fine = np.isfinite(found).all(axis=1)
            scaled = np.clip(np.floor(SCALE * found[fine]), -MOST, MOST)
            yield part[fine], scaled.astype(np.int64) + OFFSET


def _vectors(df: DataFrame, column: str):
    """The vector column as array<float> or array<double>."""
    kind = df.schema[column].dataType
    inner = kind.elementType if isinstance(kind, T.ArrayType) else None
    return F.col(f"`{column}`") if isinstance(inner, (T.FloatType, T.DoubleType)) else F.col(f"`{column}`").cast("array<double>")


_EXACT = pa.decimal128(38, 0)
_SUMS = pa.schema({"width": pa.int32(), "dim": pa.int32(), "n": pa.int64(), "total": _EXACT})
_PRODUCTS = pa.schema({"row": pa.int32(), "totals": pa.list_(_EXACT)})
_MOMENTS = pa.schema({"cell": pa.int32(), "total": pa.float64()})
_WHITENED = pa.schema({
    "vec_id": pa.int64(), "component": pa.int32(), "n": pa.int64(), "deviation": pa.int64(),
    "whitened": pa.float64(), "explained": pa.float64(),
})


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, list] = {}
    for batch in batches:
        for places, x in _rows(batch.column(0)):
            if not len(places):
                continue
            own = totals.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
            own[0] += len(x)
            own[1] += x.sum(axis=0).astype(object)
    for width, (n, total) in totals.items():
        cols = [[width] * width, range(width), [n] * width, total.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SUMS, strict=True)], schema=_SUMS)


def _exact_products(z: np.ndarray) -> np.ndarray:
    """zᵀz as Python integers."""
    if not len(z):
        return np.zeros((z.shape[1], z.shape[1]), object)
    if float(np.abs(z).max()) ** 2 * len(z) < 2.0**53:
        real = z.astype(np.float64)
        return (real.T @ real).astype(np.int64)
    wide = z.astype(object)
    return wide.T @ wide


def _products(centre: np.ndarray):
    """Sums of products of centred entries: the upper triangle, a row of it to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centre), len(centre)), object)
        part, room = np.zeros(total.shape, np.int64), 0
        for batch in batches:
            for _, x in _rows(batch.column(0)):
                if x.shape[1] != len(centre) or not len(x):
                    continue
                found = _exact_products(x - centre)
                if found.dtype == object:
                    total += found
                    continue
                part += found  # each below 2^53: 500 fit
                room += 1
                if room == 500:
                    total += part.astype(object)
                    part[:], room = 0, 0
        total += part.astype(object)
        if total.any():
            rows = [total[i, i:].tolist() for i in range(len(centre))]
            arrays = [pa.array(range(len(centre)), pa.int32()), pa.array(rows, _PRODUCTS.field(1).type)]
            yield pa.RecordBatch.from_arrays(arrays, schema=_PRODUCTS)

    return run


@dataclass
class Whitening:
    """What a worker needs to whiten a vector; a few rows of one vector's width."""

    n: int
    centre: np.ndarray  # whole numbers nearest to the means
    rest: np.ndarray  # total - n * centre, exact
    axes: np.ndarray  # width x components
    values: np.ndarray
    trace: float

    def positive(self) -> np.ndarray:
        return self.values > 16 * EPS * max(self.trace, 0.0) * max(len(self.centre), 1)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections of x less the mean over the deviation along each component."""
        shifted = (x - self.centre).astype(np.float64) - self.rest.astype(np.float64) / max(self.n, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.positive(), 1 / np.sqrt(np.abs(self.values)), np.nan)
        return (shifted @ self.axes) * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - total)^2, exact; null beyond 64 bits."""
        z = x - self.centre
        top = (self.n * (int(np.abs(z).max(initial=0)) + 1)) ** 2 * max(z.shape[1], 1)
        if top < 1 << 63:
            return ((self.n * z - self.rest) ** 2).sum(axis=1).tolist()
        wide = ((self.n * z.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in wide.tolist()]


def fit(df: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Components of all usable vectors; None without any."""
    prepare(df.sparkSession)
    vectors = df.select(_vectors(df, column).alias("v"))
    partial = staged(vectors.mapInArrow(_sums, from_arrow_schema(_SUMS)), "vector-sums")
    widths = partial.filter("dim = 0").groupBy("width").agg(F.sum("n").alias("n"))
    widest = widths.orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    if not widest:
        return None
    width, n = widest[0]
    sums = partial.filter(F.col("width") == width).groupBy("dim").agg(F.sum("total").alias("total")).collect()
    total = [0] * width
    for r in sums:
        total[r.dim] = int(r.total)
    centre = np.array([(2 * t + n) // (2 * n) for t in total], np.int64)
    rest = np.array([t - n * int(c) for t, c in zip(total, centre, strict=True)], np.int64)

    products = vectors.mapInArrow(_products(centre), from_arrow_schema(_PRODUCTS))
    cells = products.select("row", F.posexplode("totals").alias("at", "total")).groupBy("row", "at").agg(F.sum("total").alias("total"))
    covariance = np.zeros((width, width))
    delta = rest.astype(np.float64) / n
    for r in cells.toLocalIterator():
        i, j = r.row, r.row + r["at"]
        covariance[i, j] = covariance[j, i] = int(r.total) / n
    covariance -= np.outer(delta, delta)
    values, axes = leading_eigenpairs(covariance, components)
    return Whitening(n, centre, rest, axes, np.maximum(values, 0.0), float(np.trace(covariance)))


def _moments(model: Whitening):
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in _rows(batch.column(0)):
                if x.shape[1] == len(model.centre):
                    w = np.nan_to_num(model.whiten(x))
                    first += w.sum(axis=0)
                    second += w.T @ w
        cells = np.vstack([first, second]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells)], schema=_MOMENTS)

    return run


def identity_error(df: DataFrame, model: Whitening, column: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened covariance less the identity, over all rows."""
    k, good = len(model.values), model.positive()
    if not good.any():
        return None
    vectors = df.select(_vectors(df, column).alias("v"))
    cells = vectors.mapInArrow(_moments(model), from_arrow_schema(_MOMENTS)).groupBy("cell").agg(F.sum("total").alias("total"))
    found = np.zeros((k + 1) * k)
    for r in cells.collect():  # (components + 1) x components numbers
        found[r.cell] = r.total
    mean, second = found[:k] / model.n, found[k:].reshape(k, k) / model.n
    gap = second - np.outer(mean, mean) - np.eye(k)
    return float(np.abs(gap[np.ix_(good, good)]).max())


def whiten(df: DataFrame, model: Whitening | None, column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained; a row per vector and component."""
    spark = prepare(df.sparkSession)
    schema = from_arrow_schema(_WHITENED)
    if model is None:
        return spark.createDataFrame([], schema)
    k = len(model.values)
    share = np.where(model.positive(), model.values / model.trace, 0.0) if model.trace > 0 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for places, x in _rows(batch.column(1)):
                if x.shape[1] != len(model.centre) or not len(x):
                    continue
                w = model.whiten(x).ravel()
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(places)).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(w), model.n, np.int64)),
                        pa.array(model.deviations(x), pa.int64()).take(pa.array(each)),
                        pa.array(w, mask=np.isnan(w)),
                        pa.array([None] * len(w), pa.float64()) if share is None else pa.array(np.tile(share, len(x))),
                    ],
                    schema=_WHITENED,
                )

    return df.select(F.col("`vec_id`").cast("long").alias("vec_id"), _vectors(df, column).alias("v")).mapInArrow(run, schema)
