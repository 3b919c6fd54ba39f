"""Embedding whitening: a distributed covariance, float32 eigenvectors, and their refinement in higher precision.

The covariance is exact: the executors sum whole numbers, centred by the whole part of the mean before they are
multiplied, and the driver subtracts the fraction's share in integers. Only the dim x dim matrix reaches it.

Eigenvectors start in float32 and are corrected by the matrix-multiplication iteration of Ogita and Aishima in
extended precision: one correction from the residuals of orthogonality and of the diagonal form. Eigenvalues closer
than the current error can't be told apart by it; each such cluster is turned by the eigenvectors of its own small
matrix, shifted by the cluster's centre, and the iteration goes on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erashift.llm.common import stored

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
LARGEST = 2.0**25      # entries whose scaled size reaches this have no place in the exact sums
EXACT_FLOAT = 2.0**53  # whole numbers below this are exact in a double
ROUNDS = 30
MARGIN = 100           # eigenvalues this many errors apart are told apart; then no correction exceeds 1 / MARGIN
NOISE = 2.0**-44       # components below this share of the variance are rounding


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x: the usable rows with their entries as whole numbers."""
    c = vectors[vector_col]
    usable = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & (F.abs(v.cast("double") * SCALE) < LARGEST))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE) + F.lit(OFFSET).cast("long"))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(vectors[id_col].cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _sums(df: DataFrame, run, column: str) -> list[int]:
    """Adds up the arrays that the tasks yield, entry by entry, exactly."""
    parts = df.mapInArrow(run, f"{column} array<long>").select(F.posexplode(column).alias("at", "part"))
    total = parts.groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    return [int(r["total"]) for r in total.orderBy("at").collect()]


def entry_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows and each dimension's sum."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dim)
                yield pa.RecordBatch.from_arrays([pa.array([[len(x), *x.sum(0).tolist()]], pa.list_(pa.int64()))], names=["s"])

    got = _sums(fit, run, "s")
    return (got[0], got[1:]) if got else (0, [])


def product_sums(fit: DataFrame, dim: int, centre: list[int]) -> list[list[int]]:
    """Sum over all rows of (x - centre)(x - centre)', in whole numbers."""
    def run(batches):
        c = np.array(centre, np.int64)
        total = np.zeros((dim, dim), np.int64)
        for b in batches:
            whole = _matrix(b.column(0), dim) - c
            for at in range(0, len(whole), 1024):  # 1024 squares of 26 bits fit a long
                d = whole[at:at + 1024]
                if float(np.abs(d).max(initial=0))**2 * len(d) < EXACT_FLOAT:
                    part = (d.T.astype(np.float64) @ d.astype(np.float64)).astype(np.int64)
                else:
                    part = d.T @ d
                if float(np.abs(total).max()) + float(np.abs(part).max()) > 2.0**62:
                    yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], names=["m"])
                    total = np.zeros((dim, dim), np.int64)
                total = total + part
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], names=["m"])

    flat = _sums(fit, run, "m") or [0] * dim * dim  # all vectors are alike
    return [flat[i * dim:(i + 1) * dim] for i in range(dim)]


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of two or more eigenvalues of which neighbours are at most gap apart."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refined_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, in extended precision.

    The largest entry of each vector is positive.
    """
    a = np.asarray(matrix, np.longdouble)
    n = len(a)
    size = np.abs(a).max(initial=0)
    if not size:
        return np.zeros(n, np.longdouble), np.eye(n, dtype=np.longdouble)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    eye = np.eye(n, dtype=np.longdouble)
    norm = np.sqrt((a * a).sum())
    tiny = np.finfo(np.longdouble).eps
    for _ in range(ROUNDS):
        r = eye - x.T @ x
        s = x.T @ (a @ x)
        value = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(value)
        error = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        gap = MARGIN * error
        apart = value[None, :] - value[:, None]
        near = np.abs(apart) <= gap
        e = np.where(near, r / 2, (s + value[None, :] * r) / np.where(near, 1, apart))
        x = x + x @ e
        for cluster in _clusters(value, gap):
            part = x[:, cluster]
            centre = value[cluster].mean()
            small = part.T @ (a @ part - centre * part)
            small = (small + small.T) / 2
            turn = np.linalg.eigh((small / max(np.abs(small).max(), tiny)).astype(np.float64))[1]
            x[:, cluster] = part @ turn.astype(np.longdouble)
        if error <= 64 * n * tiny * norm:
            break
    for _ in range(3):  # what the turns of clusters, made in doubles, leave of non-orthogonality
        x = x + x @ (eye - x.T @ x) / 2
    value = (x * (a @ x)).sum(0) * size
    order = np.argsort(-value, kind="stable")
    x = x[:, order]
    x = x * np.sign(x[np.abs(x).argmax(0), np.arange(n)])
    return value[order], x


@dataclass
class Whitening:
    """The fitted map: whitened = ((x - centre) - rest / n) @ weight."""

    n: int
    centre: list[int]      # whole part of the mean
    rest: list[int]        # sums minus n * centre, from 0 to n - 1
    weight: np.ndarray     # dim x components
    explained: np.ndarray
    identity_error: float


def fit_whitening(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on each distinct vector of column x once; None without rows. All vectors have one length."""
    fit = stored(x.select("x").distinct(), "whitening-fit")
    first = fit.first()
    if first is None:
        return None
    dim = len(first["x"])
    n, sums = entry_sums(fit, dim)
    centre = [s // n for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    products = product_sums(fit, dim, centre)
    exact = [[np.longdouble(str(n * p - a * b)) for p, b in zip(row, rest)] for row, a in zip(products, rest)]
    cov = np.array(exact, np.longdouble).reshape(dim, dim) / np.longdouble(str(n * n))
    value, vector = refined_eigen(cov)
    trace = np.trace(cov)
    k = int(min(components, (value > NOISE * trace).sum()))
    weight = (vector[:, :k] / np.sqrt(value[:k])).astype(np.float64)
    spread = weight.astype(np.longdouble).T @ cov @ weight.astype(np.longdouble)
    error = float(np.abs(spread - np.eye(k)).max(initial=0))
    return Whitening(n, centre, rest, weight, (value[:k] / trace if trace else value[:k]).astype(np.float64), error)


def _deviation(whole: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; None where a long can't hold it."""
    far = float(np.abs(whole).max(initial=0)) * n + n
    if far < 2.0**62 and far * far * whole.shape[1] < 2.0**63:
        d = n * whole - rest
        return (d * d).sum(1).tolist()
    out = [sum((n * v - r)**2 for v, r in zip(row, rest.tolist())) for row in whole.tolist()]
    return [v if v < 2**63 else None for v in out]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row and component.

    Rows whose vector is NULL or has a NULL, non-finite or very large entry (LARGEST) are left out, as are vectors of
    another length than the most frequent one (of equally frequent ones the longest). Repeated vectors count once in
    the fit, and every row of them is answered, with or without an id. There are at most `components` components, and
    fewer when the vectors have fewer directions in which they differ at all; without any, and for an empty table, no
    rows. The result of a row never depends on how the table is split.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("x").alias("len")).count().orderBy(F.desc("count"), F.desc("len")).limit(1).collect()
    dim = lengths[0]["len"] if lengths else 0
    rows = rows.where(F.size("x") == dim)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit_whitening(rows, components) if dim else None
    if fitted is None or not fitted.weight.shape[1]:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(fitted)  # dim x components numbers

    def run(batches):
        w = shared.value
        centre, rest, k = np.array(w.centre, np.int64), np.array(w.rest, np.int64), w.weight.shape[1]
        for b in batches:
            whole = _matrix(b.column(1), dim) - centre
            off, white = whole - rest / w.n, np.zeros((b.num_rows, k))
            for j in range(dim):  # one order of additions, which a matrix product of another length would not keep
                white += off[:, j, None] * w.weight[j]
            each = np.repeat(np.arange(b.num_rows), k)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                pa.array(np.full(len(each), w.n)), pa.array(_deviation(whole, w.n, rest), pa.int64()).take(pa.array(each)),
                pa.array(white.ravel()), pa.array(np.tile(w.explained, b.num_rows)), pa.array(np.full(len(each), w.identity_error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
