"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X (n x d) are never multiplied into a d x d matrix. Starting from a block of orthonormal directions V1,
two kinds of passes alternate:

    X V_j     = U_j A_j + U_(j-1) B_(j-1)     one pass, gives A_j
    X' U_j    = V_j A_j' + V_(j+1) B_j'       one pass, gives V_(j+1) and B_j

with all U and all V kept orthonormal by full reorthogonalisation. The blocks A, B form a small block bidiagonal matrix whose
singular values are those of X and whose right vectors give the components. U has as many rows as X and isn't stored: every U_j is X
times a small matrix, so a pass recomputes it from the rows and sends back sums of at most d x d numbers, which Spark adds
up by position before the driver sees them. A pass works on `BLOCK` directions at once, since reading the rows costs most.
It stops when the residuals of the wanted components vanish, at the latest after d directions, when the decomposition is complete.

Defined results: vectors that are null, empty or hold null, non-finite or huge (2^40) entries are dropped, and so are vectors whose length isn't the
most common one (the longer at ties), since only vectors of one length have a covariance. Components without
variance (below 1e-12 of the largest) are left out, so constant, single or too short vectors give fewer than `k` rows. Repeated rows
and ids count and return as often as they occur. An empty table gives an empty result. Columns besides the two named are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrisk.llm import columns as C

BLOCK = 8
#: Residual of a component, as a share of the largest singular value, at which it counts as found.
CONVERGED = 1e-14
#: Variances below this share of the largest one are none.
NO_VARIANCE = 1e-12
#: Entries from here on don't fit a long with room for sums; like infinite ones they drop their vector.
LARGEST = 2.0 ** 40
#: Rows turned into doubles at once.
ROWS = 1 << 13


@dataclass
class Whitening:
    """n, integer sums per dimension, their mean (integer and fraction), components (d x k, orthonormal), their variances, and the total variance."""

    n: int
    sums: list[int]
    mean: tuple[np.ndarray, np.ndarray]
    components: np.ndarray
    variances: np.ndarray
    total: float


def quantised(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, x): finite vectors of the common length as integers floor(1024 c) + 100000."""
    good = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)))
    whole = C.stored(good.select("vec_id", F.transform("v", lambda c: F.floor(c * 1024).cast("long") + F.lit(100000).cast("long")).alias("x")), "vectors")
    lengths = whole.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
    return whole.where(F.size("x") == (lengths["d"] if lengths else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, d)


def _added(rows: DataFrame, d: int, make: Callable[[np.ndarray], np.ndarray], size: int, kind=np.float64) -> np.ndarray:
    """Sum over all rows of what `make` gives for a matrix of integer rows; summed per task, then by position in Spark."""
    spark_type = "double" if kind is np.float64 else "long"

    def run(batches):
        total, seen = np.zeros(size, kind), False
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for at in range(0, len(x), ROWS):
                total += make(x[at:at + ROWS]).ravel()
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "value"])

    out = np.zeros(size, kind)
    sums = rows.select("x").mapInArrow(run, f"at int, value {spark_type}").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out[np.asarray(sums["at"])] = np.asarray(sums["value"])
    return out


def _centred(x: np.ndarray, whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """x - mean, where the mean is whole + part: the integer difference is exact."""
    return (x - whole) - part


def fit_whitening(rows: DataFrame, k: int = 8, block: int = BLOCK) -> Whitening | None:
    """Decompose rows (x array<long>, one length, stored); None without rows."""
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    # sums in two halves, so that they can't overflow
    moments = _added(rows, d, lambda x: np.concatenate([[len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]), 2 * d + 1, np.int64)
    n, sums = int(moments[0]), [(int(hi) << 32) + int(lo) for hi, lo in zip(moments[1:d + 1], moments[d + 1:], strict=True)]
    nearest = [(2 * s + n) // (2 * n) for s in sums]
    mean = np.array(nearest, np.int64), np.array([(s - n * m) / n for s, m in zip(sums, nearest, strict=True)])

    def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """(X left)' (X right), in one pass."""
        both = np.concatenate([left, right], 1)

        def one(x):
            y = _centred(x, *mean) @ both
            return y[:, :left.shape[1]].T @ y[:, left.shape[1]:]

        return _added(rows, d, one, left.shape[1] * right.shape[1]).reshape(left.shape[1], right.shape[1])

    def transposed(p: np.ndarray) -> np.ndarray:
        """X' (X p), in one pass."""

        def one(x):
            c = _centred(x, *mean)
            return c.T @ (c @ p)

        return _added(rows, d, one, p.size).reshape(p.shape)

    total = float(_added(rows, d, lambda x: np.square(_centred(x, *mean)).sum(), 1)[0])
    rng, block = np.random.default_rng(20240229), max(1, min(block, d))
    v = np.linalg.qr(rng.standard_normal((d, block)))[0]
    ahead, p = v, np.zeros((d, 0))  # the directions that come next; U = X p
    small = np.zeros((0, 0))  # U' X V
    while total > 0:
        # X V_j without its parts along U, then orthonormal: twice by Gram matrices, since one leaves rounding behind
        fresh, along = ahead, np.zeros((p.shape[1], ahead.shape[1]))
        for again in (False, True):
            crossed = products(np.concatenate([p, fresh], 1), fresh)
            lean, gram = crossed[:p.shape[1]], crossed[p.shape[1]:]
            along = along if again else lean
            values, turn = np.linalg.eigh(gram - lean.T @ lean)
            keep = values > 1e-13 * (1 if again else total)
            fresh = (fresh - p @ lean) @ (turn[:, keep] / np.sqrt(values[keep]))
            if not fresh.shape[1]:
                break
        small, ahead = np.concatenate([small, along], 1), np.zeros((d, 0))
        if fresh.shape[1]:
            p = np.concatenate([p, fresh], 1)
            # X' U_j: what lies along V is a row of the small matrix, the rest gives the next directions
            out, inside = transposed(fresh), np.zeros((v.shape[1], fresh.shape[1]))
            for _ in range(2):
                lean = v.T @ out
                out, inside = out - v @ lean, inside + lean
            small = np.concatenate([small, inside.T])
            left, values, _ = np.linalg.svd(small)
            loose = np.linalg.norm(out @ left[-fresh.shape[1]:, :k], axis=0)
            # a block as wide as k can't miss copies of one value, a narrower one could
            if block >= k and len(values) >= k and np.all(loose <= CONVERGED * values[0]):
                break
            turned, sizes, _ = np.linalg.svd(out, full_matrices=False)
            ahead = turned[:, sizes > CONVERGED * values[0]]
        if v.shape[1] == d:
            break
        if not ahead.shape[1]:  # the rows' space is used up from these directions: go on with others
            ahead = rng.standard_normal((d, block))
        ahead = ahead[:, :d - v.shape[1]]
        for _ in range(2):
            ahead = np.linalg.qr(ahead - v @ (v.T @ ahead))[0]
        v = np.concatenate([v, ahead], 1)
    _, values, right = np.linalg.svd(small) if small.size else (None, np.zeros(0), np.zeros((0, 0)))
    variances = np.square(values) / n
    keep = np.flatnonzero(variances > NO_VARIANCE * variances.max(initial=0))[:k]
    return Whitening(n, sums, mean, v @ right[keep].T if len(keep) else np.zeros((d, 0)), variances[keep], total / n)


def whiten(embeddings: DataFrame, k: int = 8, id_column: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Per remaining row: vec_id, n, deviation decimal(38,0), whitened and explained (an entry per component), identity_error.

    deviation is exact, and null where it has more than 38 digits.
    """
    rows = quantised(embeddings, id_column, vector)
    fit = fit_whitening(rows, k, block)
    schema = "vec_id long, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if fit is None or not len(fit.variances):
        return embeddings.sparkSession.createDataFrame([], schema)
    d, m, n, mean = len(fit.sums), len(fit.variances), fit.n, fit.mean
    project = fit.components / np.sqrt(fit.variances)

    def spread(x):
        y = _centred(x, *mean) @ project
        return np.concatenate([y.sum(0), (y.T @ y).ravel()])

    # the mean of the projections is zero but for rounding, so removing it afterwards loses nothing
    moments = _added(rows, d, spread, m + m * m)
    centre = moments[:m] / n
    covariance = moments[m:].reshape(m, m) / n - np.outer(centre, centre)
    error = float(np.abs(covariance - np.eye(m)).max())

    def run(batches):
        for batch in batches:
            y = _centred(_matrix(batch.column(1), d), *mean) @ project
            offsets = pa.array(np.arange(0, len(y) * m + 1, m, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))], ["vec_id", "x", "whitened"])

    sent = F.array(*(F.lit(s).cast("decimal(38,0)") for s in fit.sums))
    off = F.zip_with("x", sent, lambda x, s: F.try_subtract(F.try_multiply(x.cast("decimal(19,0)"), F.lit(n).cast("decimal(18,0)")), s).cast("decimal(38,0)"))
    squares = F.transform(off, lambda y: F.try_multiply(y, y))
    deviation = F.aggregate(squares, F.lit(0).cast("decimal(38,0)"), lambda a, y: F.try_add(a, y).try_cast("decimal(38,0)"))
    out = rows.mapInArrow(run, "vec_id long, x array<long>, whitened array<double>")
    return out.select(
        "vec_id", F.lit(n).cast("long").alias("n"), deviation.alias("deviation"), "whitened",
        F.array(*(F.lit(float(e / fit.total)) for e in fit.variances)).alias("explained"), F.lit(error).alias("identity_error"))
