"""Whitening of embeddings by a compensated covariance.

Vectors become integers, so sums and means are exact. The covariance is a sum of centred outer products. Centred values
are pairs of doubles (high and low part); those of a block of vectors are cut in slices of ``SLICE`` bits, so that the
product of two slices over the block is a matrix of integers below 2**53, which holds no rounding error whatever the
order of its additions. These matrices, scaled by powers of two, are added up as pairs of doubles with the error of
each addition carried along, within a task, and the tasks' high and low parts are merged in the same way, row by row of the
matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinweave.llm.shared import stored
from pinweave.ship import ship

#: Vectors in a block and bits in a slice: BLOCK * 2 ** (2 * SLICE) is at most 2 ** 53.
BLOCK, SLICE, SLICES = 1024, 21, 4
SCALE, SHIFT = 64, 1_000_000
#: Entries from this on, as multiples of 1 / SCALE, are no entries: their squares are beyond exact sums.
LARGEST = 2.0**52


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(hi: np.ndarray, lo: np.ndarray, more: np.ndarray, low: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """A pair of doubles plus another one."""
    s, e = two_sum(hi, more)
    t, f = two_sum(lo, low + np.zeros_like(lo))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def as_pair(x: Fraction) -> tuple[float, float]:
    hi = float(x)
    return hi, float(x - Fraction(hi))


def centred(x: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x less the mean, both parts; ``mean`` has a row of high and one of low parts."""
    s, e = two_sum(x.astype(np.float64), -mean[0])
    return two_sum(s, e - mean[1])


def sliced(hi: np.ndarray, lo: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Integers of at most SLICE bits and a sign for each slice of the columns, and each column's power of two."""
    most = np.abs(hi).max(axis=0)
    power = np.where(most > 0, np.frexp(most)[1], 0)
    rest, low = np.ldexp(hi, -power), np.ldexp(lo, -power)
    out = []
    for _ in range(SLICES):
        rest, low = np.ldexp(rest, SLICE), np.ldexp(low, SLICE)
        whole = np.rint(rest)
        out.append(whole)
        rest, low = two_sum(rest - whole, low)
    return out, power


def outer(hi: np.ndarray, lo: np.ndarray) -> Iterator[np.ndarray]:
    """Matrices without rounding errors whose sum is that of the outer products of a block's rows with themselves."""
    parts, power = sliced(hi, lo)
    scale = power[:, None] + power[None, :]
    for i in range(SLICES):
        for j in range(i, SLICES - i):
            product = parts[i].T @ parts[j]
            if i != j:
                product = product + product.T  # below 2 ** 53, too: there are half as many vectors in a block as would do
            yield np.ldexp(product, scale - SLICE * (i + j + 2))


class Sum:
    """Symmetric matrices added up as pairs of doubles."""

    def __init__(self, size: int):
        self.hi, self.lo = np.zeros((size, size)), np.zeros((size, size))

    def add(self, hi: np.ndarray, lo: np.ndarray) -> None:
        for at in range(0, len(hi), BLOCK):
            for product in outer(hi[at : at + BLOCK], lo[at : at + BLOCK]):
                self.hi, self.lo = add(self.hi, self.lo, product)


def matrix(batch: pa.RecordBatch | pa.Table, name: str, size: int) -> np.ndarray:
    column = batch.column(name)
    values = column.flatten() if isinstance(column, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return values.to_numpy(zero_copy_only=False).reshape(-1, size)


ROWS = "row int, hi array<double>, lo array<double>"


def _rows(hi: np.ndarray, lo: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel())) for x in (hi, lo)]
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), *lists], ["row", "hi", "lo"])


def merged(parts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of matrices given by rows (task, row, hi, lo), as high and low parts.

    First the tasks' rows are merged in as many shares as the square root of the cores, then the shares. What comes to
    the driver is one matrix, whose size is that of a vector, squared.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            hi, lo = matrix(batch, "hi", size), matrix(batch, "lo", size)
            for k, row in enumerate(batch.column("row").to_pylist()):
                held[row] = add(*held[row], hi[k], lo[k]) if row in held else (hi[k].copy(), lo[k].copy())
        if held:
            yield _rows(np.stack([x[0] for x in held.values()]), np.stack([x[1] for x in held.values()]), np.array(list(held)))

    shares = F.ceil(F.sqrt(F.lit(max(1, parts.sparkSession.sparkContext.defaultParallelism)))).cast("int")
    once = parts.repartition("row", F.pmod(F.col("task"), shares)).select("row", "hi", "lo").mapInArrow(merge, ROWS)
    hi, lo = np.zeros((size, size)), np.zeros((size, size))
    for r in once.repartition("row").mapInArrow(merge, ROWS).toLocalIterator():
        hi[r["row"]], lo[r["row"]] = r["hi"], r["lo"]
    return hi, lo


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x array<bigint>): x = floor(64 c) + 1000000 of each vector; unfit rows are dropped.

    Unfit are null vectors and those with a null, not finite or unspeakably large (2**46) entry, empty ones, and ones of
    another size than most have (of sizes that are equally frequent the smallest counts).
    """
    ship(vectors.sparkSession)
    c = F.transform(F.col(f"`{column}`"), lambda v: F.floor(v.cast("double") * SCALE))
    # Comparisons are false for null and NaN; a double beyond the range of bigint is never cast.
    fit = F.forall(F.col(f"`{column}`"), lambda v: F.coalesce(F.abs(v.cast("double") * SCALE) < LARGEST, F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(fit & (F.size(F.col(f"`{column}`")) > 0), F.transform(c, lambda v: v.cast("bigint") + SHIFT)).alias("x"))
    return rows.where("x is not null")


def _most_frequent_size(rows: DataFrame) -> int | None:
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return sizes and sizes["size"]


def sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of vectors x and their exact sum in each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for batch in batches:
            x = matrix(batch, "x", size)
            n += len(x)
            # 2**52 at most each: halves of 26 bits add up without overflow.
            high, low = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
            total = [t + (int(h) << 26) + int(l) for t, h, l in zip(total, high, low, strict=True)]
        kind = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([Decimal(n), *map(Decimal, total)], kind)], ["dim", "total"])

    found = fit.select("x").mapInArrow(run, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total")).collect()
    by = {r["dim"]: int(r["total"]) for r in found}
    return by.get(-1, 0), [by.get(k, 0) for k in range(size)]


def products(fit: DataFrame, mean: np.ndarray, axes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the outer products of the centred x or, with ``axes``, of their projections on the axes' columns."""
    size = mean.shape[1]
    width = size if axes is None else axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = Sum(width), False
        for batch in batches:
            if batch.num_rows:
                hi, lo = centred(matrix(batch, "x", size), mean)
                if axes is not None:
                    hi, lo = hi @ axes, np.zeros((len(hi), width))
                total.add(hi, lo)
                seen = True
        if seen:
            yield _rows(total.hi, total.lo, np.arange(width))

    parts = fit.select("x").mapInArrow(run, ROWS)
    return merged(parts.withColumn("task", F.spark_partition_id()), width)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and the orthogonal q with q.T @ a @ q tridiagonal, by Householder reflections."""
    a, n, size = a.copy(), len(a), np.abs(a).max()
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        norm = np.linalg.norm(x)
        if norm <= 1e-40 * size:  # nothing that matters is left below the diagonal
            a[k + 1, k] = 0.0
            continue
        v = x.copy()
        v[0] += norm if v[0] >= 0 else -norm
        v /= np.linalg.norm(v)
        own = a[k + 1 :, k + 1 :]
        w = own @ v
        w -= (v @ w) * v
        own -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = -np.copysign(norm, x[0] if x[0] else 1.0)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of diag(d) + rho z z^T; d rises strictly, z has no zero, rho is above 0.

    The roots lie one in each gap. Each is found by bisection, as an offset from the nearer end of its gap, so that its
    distances from all of d are accurate; z is then recomputed from these distances, for which the vectors are orthogonal.
    """
    n = len(d)
    z2 = z * z
    gap = np.append(np.diff(d), rho * z2.sum())
    middle = d + gap / 2
    at_middle = 1 + rho * (z2[None, :] / (d[None, :] - middle[:, None])).sum(axis=1)
    right = at_middle < 0
    right[-1] = False
    base = np.arange(n) + right
    far = d[None, :] - d[base][:, None]  # distances of d from the base of each root
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, gap / 2)
    high[-1] = gap[-1]
    for _ in range(200):
        mid = (low + high) / 2
        with np.errstate(divide="ignore"):
            f = 1 + rho * (z2[None, :] / (far - mid[:, None])).sum(axis=1)
        if np.all((mid == low) | (mid == high)):
            break
        low, high = np.where(f < 0, mid, low), np.where(f < 0, high, mid)
    offset = np.where(right, low, high)  # never 0, the base itself
    away = far - offset[:, None]  # d_j - lambda_i
    # z from the roots (Gu and Eisenstat): z_j^2 = prod_i (lambda_i - d_j) / prod_{i != j} (d_i - d_j) / rho
    ratio = -away.T  # [j, i]: lambda_i - d_j
    other = d[None, :] - d[:, None]  # [j, i]: d_i - d_j
    np.fill_diagonal(other, 1.0)
    own = np.sqrt(np.abs(np.prod(ratio / other, axis=1)) / rho) * np.sign(z)
    vectors = own[:, None] / away.T
    return d[base] + offset, vectors / np.linalg.norm(vectors, axis=0)


def divide(d: np.ndarray, e: np.ndarray, norm: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of a symmetric tridiagonal matrix by divide and conquer.

    What is below the rounding errors of the whole matrix, of size ``norm``, is taken as 0.
    """
    n = len(d)
    norm = max(np.abs(d).max(), np.abs(e).max(initial=0.0)) if norm is None else norm
    if n == 1:
        return d.copy(), np.ones((1, 1))
    m = n // 2
    beta = e[m - 1]
    rho = abs(beta) if abs(beta) > np.finfo(float).eps * norm else 0.0
    upper, lower = d[:m].copy(), d[m:].copy()
    upper[-1] -= rho
    lower[0] -= rho
    (d1, q1), (d2, q2) = divide(upper, e[: m - 1], norm), divide(lower, e[m:], norm)
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    values = np.concatenate([d1, d2])
    z = np.concatenate([q1[-1], np.sign(beta) * q2[0]])
    order = np.argsort(values, kind="stable")
    values, z, q = values[order], z[order], q[:, order]
    if rho == 0:
        return values, q
    # Deflation: entries of z that do not matter, and values that are as good as equal, turned into one of them.
    small = 8 * np.finfo(float).eps * norm
    keep: list[int] = []
    for k in range(n):
        if rho * abs(z[k]) * np.linalg.norm(z) <= small:
            continue
        if keep:
            j = keep[-1]
            r = np.hypot(z[j], z[k])
            c, s = z[k] / r, z[j] / r
            if abs((values[k] - values[j]) * c * s) <= small:
                z[k], z[j] = r, 0.0
                q[:, j], q[:, k] = c * q[:, j] - s * q[:, k], s * q[:, j] + c * q[:, k]
                values[j], values[k] = c * c * values[j] + s * s * values[k], s * s * values[j] + c * c * values[k]
                keep[-1] = k
                continue
        keep.append(k)
    if keep:
        own = np.array(keep)
        own = own[np.argsort(values[own], kind="stable")]
        values[own], vectors = secular(values[own], z[own], rho)
        q[:, own] = q[:, own] @ vectors
    order = np.argsort(values, kind="stable")
    return values[order], q[:, order]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    scale = np.abs(a).max() or 1.0
    d, e, q = tridiagonal(a / scale)
    values, vectors = divide(d, e)
    return values[::-1] * scale, (q @ vectors)[:, ::-1]


class Fit:
    """Mean, components and quality of a whitening; a few matrices of the size of a vector, squared."""

    def __init__(self, fit: DataFrame, size: int, most: int):
        self.size = size
        self.n, self.sums = sums(fit, size)
        mean = [as_pair(Fraction(s, self.n)) for s in self.sums]
        self.mean = np.array(mean).T.copy()
        hi, lo = products(fit, self.mean)
        v = (hi + lo) / self.n
        v = (v + v.T) / 2
        e, u = eigen(v)
        # Components without variance cannot be scaled to variance 1.
        self.rank = min(most, int((e > size * np.finfo(float).eps * max(e[0], 0)).sum()))
        self.values, self.axes = e[: self.rank], u[:, : self.rank] / np.sqrt(e[: self.rank])
        self.explained = self.values / (np.trace(v) or 1.0)
        self.error = 0.0
        if self.rank:
            hi, lo = products(fit, self.mean, self.axes)
            self.error = float(np.abs((hi + lo) / self.n - np.eye(self.rank)).max())


SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 16, column: str = "embedding") -> DataFrame:
    """A row for each fit vector and each of its first ``components`` whitened values.

    The mean and the components come from each distinct integer vector once; see ``integers`` for rows left out.
    deviation is the exact sum of (n x - S)^2 over the dimensions, null where it is beyond a bigint. Components without
    variance (fewer distinct vectors than dimensions, constant dimensions) are left out; if none has any, there are no
    rows. ``identity_error`` is measured on the fit list by a pass of its own. Repeated rows come out one by one, a null
    vec_id stays null, an empty table gives no rows, columns other than vec_id and the vector are left out.
    """
    rows = stored(integers(vectors, column))
    size = _most_frequent_size(rows)
    if size is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    rows = rows.where(F.size("x") == size)
    held = Fit(stored(rows.select("x").distinct()), size, components)
    n, k = held.n, held.rank
    mean, axes, explained, error = held.mean, held.axes, held.explained, held.error
    total = np.array(held.sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, "x", size)
            hi, lo = centred(x, mean)
            whitened = hi @ axes + lo @ axes
            deviation = [None if s >= 1 << 63 else s for s in deviations(x, total, n)]
            each = lambda v: np.repeat(np.asarray(v), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each(np.arange(len(x))))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n)),
                    pa.array(deviation, pa.int64()).take(pa.array(each(np.arange(len(x))))),
                    pa.array(whitened.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(x) * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, SCHEMA) if k else vectors.sparkSession.createDataFrame([], SCHEMA)


def deviations(x: np.ndarray, total: np.ndarray, n: int) -> list[int]:
    """Exact sums of (n x - S)^2, in machine integers where they suffice."""
    most = np.abs(x.astype(np.float64) * n - total.astype(np.float64)).max(initial=0)
    if 2.0 * x.shape[1] * most * most < 2.0**62 and float(np.abs(x).max(initial=0)) * n < 2.0**62:
        d = x * n - total.astype(np.int64)
        return (d * d).sum(axis=1).tolist()
    return [sum((n * a - s) ** 2 for a, s in zip(row, total.tolist(), strict=True)) for row in x.tolist()]
