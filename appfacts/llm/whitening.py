"""Whitening of embeddings: components of their covariance by spectral divide and conquer.

Sums and products are gathered by Spark over different vectors, as exact whole numbers.  The covariance (as large as the
dimension squared, whatever the number of rows) is split on the driver: the polar factor of the covariance less a shift,
by dynamically weighted Halley steps in their QR form (QDWH), is the sign of the eigenvalues about the shift; so half of it
and half of the identity project on the invariant subspace above, whose basis halves the problem, down to single
components.  The matrix of components is then sent to all tasks and applied to every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appfacts.llm.tables import map_batches, workers_import, written

#: Entries are counted in steps of 1 / STEPS, and shifted.
STEPS, SHIFT = 64, 1_000_000
COMPONENTS = 16
EPS = float(np.finfo(float).eps)
#: Whole numbers below this are exact as doubles.
EXACT = 1 << 53


# -- spectral divide and conquer --------------------------------------------------------------------------------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric, not singular matrix, by QDWH.

    For a symmetric matrix that is its sign: eigenvalues become 1 or -1.  Six steps or so, whatever the condition.
    """
    n = len(a)
    x = a / np.linalg.norm(a)  # the Frobenius norm bounds the largest singular value
    least = max(_least_singular(x), EPS / 4)
    for _ in range(40):
        # Weights that lift the interval [least, 1] of singular values as far as a step of this form can.
        d = np.cbrt(4 * (1 - least**2) / least**4)
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - least**2) / (least**2 * root), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack((np.sqrt(wc) * x, np.eye(n))))
        last, x = x, (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        x = (x + x.T) / 2
        least = min(least * (wa + wb * least**2) / (1 + wc * least**2), 1.0)
        if np.linalg.norm(x - last) <= np.cbrt(EPS) * 1e-3 and abs(1 - least) < 1e-12:
            break
    # One Newton-Schulz step removes what rounding has left.
    return 1.5 * x - 0.5 * x @ (x.T @ x)


def _least_singular(x: np.ndarray) -> float:
    """A lower estimate of the least singular value, from the triangular factor."""
    r = np.linalg.qr(x, mode="r")
    diagonal = np.abs(np.diag(r))
    if diagonal.min() == 0:
        return 0.0
    return float(0.9 / np.linalg.norm(np.linalg.inv(r)))


def _range_basis(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of its complement: subspace iteration from its largest columns."""
    n = len(projector)
    left, chosen = projector.copy(), []
    for _ in range(rank):  # columns by what the chosen ones don't explain yet
        norms = (left**2).sum(0)
        norms[chosen] = -1
        j = int(np.argmax(norms))
        chosen.append(j)
        v = left[:, j] / np.sqrt(max(norms[j], EPS**2))
        left = left - np.outer(v, v @ left)
    basis = projector[:, chosen]
    for _ in range(2):
        basis = np.linalg.qr(projector @ basis)[0]
    full, _ = np.linalg.qr(np.hstack((basis, np.eye(n))))
    rest = full[:, rank:n]
    rest = np.linalg.qr(rest - basis @ (basis.T @ rest))[0]
    return basis, rest


def spectral_components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix.

    A block whose eigenvalues agree to rounding isn't split: any basis of it will do.
    """
    n = len(v)
    scale = np.linalg.norm(v)
    values, vectors = [], []
    todo = [(np.eye(n), v)] if n else []
    while todo:
        basis, block = todo.pop()
        block = (block + block.T) / 2
        m = len(block)
        mean = np.trace(block) / m
        spread = np.linalg.norm(block - mean * np.eye(m))
        if m == 1 or spread <= 4 * m * EPS * scale:
            values += np.diag(block).tolist()
            vectors += list(basis.T)
            continue
        for shift in _shifts(block, mean, spread):
            sign = polar_factor(block - shift * np.eye(m))
            rank = int(round((m + np.trace(sign)) / 2))
            if not 0 < rank < m:
                continue
            above, below = _range_basis((sign + np.eye(m)) / 2, rank)
            if np.abs(above.T @ block @ below).max() <= 64 * m * EPS * scale:
                break
        else:
            # No shift lies between eigenvalues that are told apart: they agree to rounding.
            values += np.diag(block).tolist()
            vectors += list(basis.T)
            continue
        todo += [(basis @ above, above.T @ block @ above), (basis @ below, below.T @ block @ below)]
    vectors = np.array(vectors).T.reshape(n, n)
    # Newton steps towards orthonormal columns; eigenvalues anew from the whole matrix.
    for _ in range(2):
        vectors = vectors @ (1.5 * np.eye(n) - 0.5 * vectors.T @ vectors)
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _shifts(block: np.ndarray, mean: float, spread: float) -> Iterator[float]:
    """Shifts to try, first the middle of the diagonal."""
    diagonal = np.sort(np.diag(block))
    yield float(np.median(diagonal)) + 0.0
    yield mean
    for i in range(1, 24):
        turn = ((i * 0.6180339887498949) % 1) * 2 - 1
        yield mean + spread / np.sqrt(len(block)) * turn * (0.9 if i < 12 else 0.1)


# -- sums over the rows -----------------------------------------------------------------------------------------


def steps(vector: str) -> Column:
    """The vector in whole steps, shifted: floor(64 c) + 1000000."""
    return F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * STEPS).cast("bigint") + SHIFT)


def usable(vector: str) -> Column:
    """Whether a vector is there and has finite entries only."""
    bad = F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.ListArray, d: int) -> np.ndarray:
    """Rows of lists, all of size ``d``, less the shift."""
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, d) - SHIFT


def _sum_rows(df: DataFrame, column: str, d: int, size: int, of) -> list[int]:
    """Sums over all rows of ``size`` whole numbers that ``of`` gives for a matrix of rows.

    A task adds up its rows, and Spark the tasks' sums in decimals, so the result is exact; ``size`` numbers come to the
    driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_matrix(batch.column(0), d))
                total = np.zeros(size, np.int64) if total is None else total
                # Python's whole numbers take over before 64 bits don't hold the sum.
                if object not in (part.dtype, total.dtype) and max(np.abs(part).max(), np.abs(total).max()) >= 1 << 62:
                    total = total.astype(object)
                total = total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size), pa.int32()), pa.array([str(int(t)) for t in total])], names=["i", "t"]
            )

    workers_import(df.sparkSession)
    parts = df.select(column).mapInArrow(run, "i int, t string")
    rows = parts.groupBy("i").agg(F.sum(F.col("t").cast("decimal(38,0)")).alias("t")).collect()
    out = [0] * size
    for r in rows:
        out[r.i] = int(r.t)
    return out


def covariance(fit: DataFrame, column: str, d: int) -> tuple[int, list[int], np.ndarray]:
    """Number of rows, sum of each (shifted) dimension, and covariance with divisor n.

    Rows are centred on the nearest whole mean before they are multiplied, so products are small whole numbers and their
    sums exact; the rest of the mean is then taken off in fractions.
    """
    n = fit.count()
    if not n:
        return 0, [0] * d, np.zeros((d, d))
    sums = _sum_rows(fit, column, d, d, lambda x: x.sum(0))
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = np.triu_indices(d)

    def products(x: np.ndarray) -> np.ndarray:
        x = x - centre
        most = int(np.abs(x).max(initial=0))
        if most**2 * len(x) < EXACT:
            y = x.astype(float)
            return (y.T @ y)[upper].astype(np.int64)
        y = x.astype(object)
        return (y.T @ y)[upper]

    moments = _sum_rows(fit, column, d, len(upper[0]), products)
    left = [Fraction(s, n) - int(c) for s, c in zip(sums, centre, strict=True)]
    v = np.zeros((d, d))
    for i, j, m in zip(*upper, moments, strict=True):
        v[i, j] = v[j, i] = float(Fraction(m, n) - left[i] * left[j])
    return n, [s + SHIFT * n for s in sums], v


class Whitener:
    """Mean and components of the different vectors of a table."""

    def __init__(self, n: int, sums: list[int], v: np.ndarray, components: int = COMPONENTS):
        self.n, self.sums, self.d = n, sums, len(sums)
        values, vectors = spectral_components(v)
        trace = float(np.trace(v))
        # A direction without variance cannot be scaled to one.
        kept = int(np.count_nonzero(values > self.d * EPS * max(trace, 0.0))) if trace > 0 else 0
        self.k = min(components, kept)
        self.values, self.vectors = values[: self.k], vectors[:, : self.k]
        self.explained = self.values / trace if self.k else self.values
        self.mean = np.array([float(Fraction(s, max(n, 1)) - SHIFT) for s in sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of (unshifted) whole steps."""
        return (x - self.mean) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S) squared, exact; above 64 bits Python fails rather than wrap around."""
        s = np.array([t - SHIFT * self.n for t in self.sums], object)
        most = max(int(np.abs(x).max(initial=0)) * self.n + int(max(map(abs, s), default=0)), 1)
        if most**2 * max(self.d, 1) < 1 << 63:
            y = x * self.n - s.astype(np.int64)
            return (y * y).sum(1)
        y = x.astype(object) * self.n - s
        return (y * y).sum(1)

    def identity_error(self, fit: DataFrame, column: str) -> float:
        """Largest entry of the whitened rows' covariance less the identity, measured over the rows."""
        k, d, upper = self.k, self.d, np.triu_indices(self.k)
        names = ["i", "t"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k + len(upper[0]))
            for batch in batches:
                w = self.project(_matrix(batch.column(0), d))
                total += np.concatenate((w.sum(0), (w.T @ w)[upper]))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=names)

        workers_import(fit.sparkSession)
        rows = fit.select(column).mapInArrow(run, "i int, t double").groupBy("i").agg(F.sum("t").alias("t")).collect()
        total = np.zeros(k + len(upper[0]))
        for r in rows:
            total[r.i] = r.t / self.n
        mean, c = total[:k], np.zeros((k, k))
        c[upper] = total[k:]
        c = np.where(np.tri(k, k, -1, bool), c.T, c) - np.outer(mean, mean)
        return float(np.abs(c - np.eye(k)).max(initial=0.0))


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null or hold null or non-finite entries are left out.  So are vectors of another size than most
    (of equally frequent sizes the larger counts), which have no place in the space.  Equal vectors are fitted on once;
    repeated rows, null keys and ties all give rows.  Directions without variance have no component, so a table of one
    vector, or none, gives no rows.  Other columns aren't used.
    """
    rows = table.where(usable(vector)).select(F.col(f"`{key}`").alias("__key"), steps(vector).alias("__x"))
    sizes = rows.groupBy(F.size("__x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = sizes.d if sizes else 0
    rows = rows.where(F.size("__x") == d)
    # Copies are dropped in the tasks first, so that no vector's rows meet in one of them.
    fit = written(rows.select("__x").distinct())
    n, sums, v = covariance(fit, "__x", d)
    model = Whitener(n, sums, v, components)
    error = model.identity_error(fit, "__x") if model.k else 0.0
    fields = {"component": pa.int32(), "n": pa.int64(), "deviation": pa.int64(), "whitened": pa.float64(), "explained": pa.float64(), "identity_error": pa.float64()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not model.k:
            return None
        x, m, k = _matrix(batch.column("__x"), d), len(batch), model.k
        values = {
            "component": np.tile(np.arange(1, k + 1), m), "n": np.full(m * k, n), "deviation": np.repeat(model.deviation(x), k),
            "whitened": model.project(x).reshape(-1), "explained": np.tile(model.explained, m), "identity_error": np.full(m * k, error),
        }
        keys = batch.column("__key").take(pa.array(np.repeat(np.arange(m), k)))
        return pa.RecordBatch.from_arrays([keys, *[pa.array(values[f], t) for f, t in fields.items()]], names=["__key", *fields])

    id_type = rows.schema["__key"].dataType.simpleString()
    schema = f"__key {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    return map_batches(rows, run, schema, limit=1 << 20).withColumnRenamed("__key", key)
