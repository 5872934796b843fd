"""Operator 13: whitening of vectors.

Each entry c becomes the whole number x = floor(1024 * c) + 100000. Sums and the scatter of the x-vectors are
taken in tasks and added up by Spark, so that only one number for each pair of dimensions reaches the driver.
The scatter is centred at the rounded mean before multiplying and is added up in whole numbers; the rest of
the mean, under one half, is taken away exactly. The driver then works on a small matrix alone: pivoted
Cholesky P'VP = LL', then one-sided Jacobi on the columns of L. Rotations W that make them orthogonal give
LW = UD: the squared norms D*D are the eigenvalues, the normalised columns, put back in order, the components.

Edge cases: rows whose vector is null, empty or holds null or non-finite entries go. Vectors of another
length than the most frequent one (ties: the longer) go too. Null ids stay and repeated rows count each time.
Entries beyond 2**62 count as that. Directions without variance are no components, so that fewer than eight, or
none, may be left (one vector, or equal ones). An empty table gives no rows. Other columns are not read.
Memory of a task: a few blocks of BLOCK vectors, and two square matrices of one vector's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows multiplied at once: products below 2**40 then add up to less than 2**52, exactly.
BLOCK = 4096
SMALL = 1 << 20
#: Blocks whose whole-number sums fit 64 bits.
FLUSH = 1 << 10
SHIFT = 100000
EDGE = float(1 << 62)
#: Relative size below which a pivot is rounding.
TINY = 1e-14


@dataclass
class Whitening:
    """What a fit yields: counts and sums in whole numbers, components as columns."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    total: float

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.total


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector can be worked on, and its length."""
    v = F.col(vector)
    known = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.filter(v.isNotNull() & (F.size(v) > 0) & known)


def whole(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix of x."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.clip(np.floor(flat * 1024), -EDGE, EDGE).astype(np.int64).reshape(len(column), -1) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[np.ndarray]:
    for batch in batches:
        x = whole(batch.column(name)) if len(batch) else np.zeros((0, 1), np.int64)
        for lo in range(0, len(x), BLOCK):
            yield x[lo : lo + BLOCK]


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min())))


def column_sums(df: DataFrame, vector: str, dim: int) -> tuple[int, list[int]]:
    """How many vectors there are, and their sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for x in _blocks(batches, vector):
            n += len(x)
            total += x.sum(0).astype(object) if _largest(x) < 1 << 50 else x.astype(object).sum(0)
        if n:
            sums = pa.array([str(v) for v in (n, *total)])
            yield pa.record_batch([pa.array(range(-1, dim), pa.int32()), sums], ["i", "s"])

    parts = df.select(vector).mapInArrow(run, "i int, s string")
    rows = dict(parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)"))).collect())  # one a dimension
    return int(rows.get(-1, 0)), [int(rows[i]) for i in range(dim)] if rows else []


def scatter(df: DataFrame, vector: str, n: int, sums: list[int]) -> np.ndarray:
    """The covariance of x: centred products in whole numbers, divided by n at the end."""
    dim = len(sums)
    middle = [round(Fraction(s, n)) for s in sums]
    centre = np.array(middle, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, rough = np.zeros((dim, dim), np.int64), np.zeros((dim, dim))
        low = np.tril_indices(dim)
        names = ["i", "j", "exact", "rough"]

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(low[0].astype(np.int32)), pa.array(low[1].astype(np.int32)), pa.array(exact[low]), pa.array(rough[low])], names)

        done = 0
        for x in _blocks(batches, vector):
            u = x - centre
            products = u.T.astype(float) @ u.astype(float)
            if _largest(u) < SMALL:
                exact += products.astype(np.int64)
            else:
                rough += products
            done += 1
            if done % FLUSH == 0:
                yield rows()
                exact[:], rough[:] = 0, 0
        if done % FLUSH:
            yield rows()

    parts = df.select(vector).mapInArrow(run, "i int, j int, exact bigint, rough double")
    added = parts.groupBy("i", "j").agg(F.sum(F.col("exact").cast("decimal(38,0)")).alias("exact"), F.sum("rough").alias("rough"))
    rest = [s - n * m for s, m in zip(sums, middle)]
    out = np.zeros((dim, dim))
    for r in added.collect():  # one row for each pair of dimensions
        i, j = r["i"], r["j"]
        out[i, j] = out[j, i] = float((Fraction(int(r["exact"])) - Fraction(rest[i] * rest[j], n)) / n) + r["rough"] / n
    return out


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower trapezoid L and order p with a[p][:, p] = LL'; L has as many columns as a has rank."""
    a, n = a.copy(), len(a)
    p, top = np.arange(n), float(np.diag(a).max(initial=0))
    out = np.zeros((n, n))
    for k in range(n):
        q = k + int(np.argmax(np.diag(a)[k:]))
        if a[q, q] <= top * n * TINY:
            return out[:, :k], p
        for m in (a, out):
            m[[k, q]] = m[[q, k]]
        a[:, [k, q]] = a[:, [q, k]]
        p[[k, q]] = p[[q, k]]
        out[k, k] = np.sqrt(a[k, k])
        out[k + 1 :, k] = a[k + 1 :, k] / out[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(out[k + 1 :, k], out[k + 1 :, k])
    return out, p


def one_sided_jacobi(b: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of b rotated in pairs until all are orthogonal to working precision."""
    b = np.asfortranarray(b)
    for _ in range(sweeps):
        turned = False
        for i in range(b.shape[1] - 1):
            for j in range(i + 1, b.shape[1]):
                x, y = b[:, i], b[:, j]
                xx, yy, xy = x @ x, y @ y, x @ y
                if abs(xy) <= 1e-15 * np.sqrt(xx * yy):
                    continue
                turned = True
                z = (yy - xx) / (2 * xy)
                t = np.copysign(1.0, z) / (abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                b[:, i], b[:, j] = c * x - s * y, s * x + c * y
        if not turned:
            break
    return b


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance from the largest down, and unit eigenvectors as columns."""
    factor, p = pivoted_cholesky(v)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned**2).sum(0))
    order = np.argsort(-norms, kind="stable")
    vectors = np.zeros_like(turned)
    vectors[p] = turned / norms
    return norms[order] ** 2, vectors[:, order]


def fit(df: DataFrame, vector: str = "embedding") -> tuple[DataFrame, Whitening | None]:
    """Usable rows of one length, and their components; None where there are none."""
    rows = usable(df, vector)
    lengths = rows.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return rows, None
    rows = rows.filter(F.size(vector) == most["d"])
    n, sums = column_sums(rows, vector, most["d"])
    v = scatter(rows, vector, n, sums)
    values, vectors = eigen(v)
    return rows, Whitening(n, sums, vectors, values, float(np.trace(v)))


def from_mean(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - sums, in whole numbers: 64 bits where they hold it, else Python's."""
    if _largest(x) * model.n + max(map(abs, model.sums)) < 1 << 62:
        return model.n * x - np.array(model.sums, np.int64)
    return model.n * x.astype(object) - np.array(model.sums, object)


def squares(y: np.ndarray) -> list[int]:
    """Sum of squares of each row, exactly."""
    if y.dtype != object and y.size and _largest(y) < 1 << 53:
        # In halves of 27 bits: up to 2**9 of their products fit 64 bits, so longer rows are cut.
        high, low = y >> 27, y & ((1 << 27) - 1)
        total = [0] * len(y)
        for lo in range(0, y.shape[1], 256):
            h, w = high[:, lo : lo + 256], low[:, lo : lo + 256]
            parts = zip((h * h).sum(1).tolist(), (h * w).sum(1).tolist(), (w * w).sum(1).tolist())
            total = [t + (a << 54) + (b << 28) + c for t, (a, b, c) in zip(total, parts)]
        return total
    return [int(v) for v in (y.astype(object) ** 2).sum(1)]


def projector(model: Whitening, count: int) -> Callable[[np.ndarray], np.ndarray]:
    """Whitened coordinates of rows of n * x - sums."""
    turn = model.components[:, :count] / np.sqrt(model.values[:count])
    return lambda y: (y.astype(float) / model.n) @ turn


def identity_error(rows: DataFrame, model: Whitening, vector: str, count: int) -> float:
    """Largest entry of the whitened rows' covariance minus the identity."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # as large as the matrix of components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        put = projector(m, count)
        total = np.zeros((count, count + 1))
        for x in _blocks(batches, vector):
            w = put(from_mean(x, m))
            total += w.T @ np.column_stack([w, np.ones(len(w))])
        i, j = np.indices(total.shape).reshape(2, -1).astype(np.int32)
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "s"])

    parts = rows.select(vector).mapInArrow(run, "i int, j int, s double")
    total = np.zeros((count, count + 1))
    for i, j, s in parts.groupBy("i", "j").agg(F.sum("s")).collect():  # pairs of components
        total[i, j] = s / model.n
    mean = total[:, count]  # nothing but rounding: rows are centred before they are multiplied
    return float(np.abs(total[:, :count] - np.outer(mean, mean) - np.eye(count)).max())


def whiten(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", count: int = 8) -> DataFrame:
    """One row for each vector and component up to `count`: id, component, n, deviation (decimal, exact;
    null beyond 38 digits), whitened, explained, identity_error."""
    kind = df.schema[id_column].dataType.simpleString()
    names = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"id {kind}, component int, n bigint, deviation string, whitened double, explained double, identity_error double"
    rows, model = fit(df.select(id_column, vector), vector)
    have = 0 if model is None else min(count, len(model.values))
    error = identity_error(rows, model, vector, have) if have else 0.0
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches if have else ():
            x = whole(batch.column(vector)) if len(batch) else None
            for lo in range(0, len(batch), BLOCK):
                y = from_mean(x[lo : lo + BLOCK], m)
                k = len(y)
                ids = batch.column(id_column).slice(lo, k).take(pa.array(np.repeat(np.arange(k), have)))
                far = pa.array([str(v) for v in squares(y)]).take(pa.array(np.repeat(np.arange(k), have)))
                yield pa.record_batch(
                    [ids, pa.array(np.tile(np.arange(1, have + 1, dtype=np.int32), k)), pa.array(np.full(k * have, m.n)), far,
                     pa.array(projector(m, have)(y).ravel()), pa.array(np.tile(m.explained[:have], k)), pa.array(np.full(k * have, error))],
                    ["id", *names],
                )

    out = rows.mapInArrow(run, schema).withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))"))
    return out.select(F.col("id").alias(id_column), *names)
