"""Matrix algebra: distributed where a side is tall, numpy on the driver where both are small.

A tall matrix is a DataFrame whose numeric columns are the matrix's columns.  Products with
small matrices are column expressions; Gram matrices and least squares reduce the rows to a
d x d summary on the executors, so only that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import ieee

#: Relative cutoff of singular values in :func:`lstsq_min_norm`: ten times the float32 epsilon.
RANK_CUTOFF = 10 * float(np.finfo(np.float32).eps)


class SingularError(ValueError):
    """The matrix has no inverse, or not the rank that is needed."""


def _m(a) -> np.ndarray:
    return np.atleast_2d(np.asarray(a, float))


# --- small matrices -------------------------------------------------------------------------


def cholesky(a) -> np.ndarray:
    try:
        return np.linalg.cholesky(_m(a))
    except np.linalg.LinAlgError as x:
        raise SingularError("the matrix is not positive definite") from x


def lu(a) -> tuple[np.ndarray, np.ndarray]:
    """Packed factors and 1-based row interchanges (partial pivoting)."""
    x = _m(a).copy()
    n, m = x.shape
    pivots = np.arange(1, min(n, m) + 1)
    for k in range(min(n, m)):
        p = k + int(np.argmax(np.abs(x[k:, k])))
        pivots[k] = p + 1
        if p != k:
            x[[k, p]] = x[[p, k]]
        if x[k, k] != 0:
            x[k + 1 :, k] /= x[k, k]
            x[k + 1 :, k + 1 :] -= np.outer(x[k + 1 :, k], x[k, k + 1 :])
    return x, pivots


def qr(a) -> tuple[np.ndarray, np.ndarray]:
    a = _m(a)
    if a.shape[0] < a.shape[1]:
        raise ValueError("an economy QR needs as many rows as columns")
    return np.linalg.qr(a)


def eig_sym(a) -> tuple[np.ndarray, np.ndarray]:
    a = _m(a)
    if not np.isfinite(a).all():
        raise ValueError("eigenvalues of a matrix with NaN or infinity")
    return np.linalg.eigh(a)


def svd(a) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.linalg.svd(_m(a), full_matrices=False)


def eig(a) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary parts of the eigenvalues of a general matrix."""
    w = np.linalg.eigvals(_m(a))
    return w.real, w.imag


def rank(a) -> int:
    a = _m(a)
    s = np.linalg.svd(a, compute_uv=False)
    return int((s > max(a.shape) * np.finfo(float).eps * (s[0] if len(s) else 0)).sum())


def _square(a) -> np.ndarray:
    a = _m(a)
    if a.shape[0] != a.shape[1]:
        raise ValueError("a square matrix is needed")
    return a


def det(a) -> float:
    a = _square(a)
    if rank(a) < len(a):
        raise SingularError("determinant of a singular matrix")
    return float(np.linalg.det(a))


def inv(a) -> np.ndarray:
    a = _square(a)
    if rank(a) < len(a):
        raise SingularError("inverse of a singular matrix")
    return np.linalg.inv(a)


def cond(a) -> float:
    s = np.linalg.svd(_m(a), compute_uv=False)
    return float("inf") if s[-1] == 0 else float(s[0] / s[-1])


def solve(a, b) -> np.ndarray:
    a = _square(a)
    if rank(a) < len(a):
        raise SingularError("the system is singular")
    return np.linalg.solve(a, np.asarray(b, float))


def solve_symmetric(a, b) -> np.ndarray:
    a = _square(a)
    return solve((a + a.T) / 2, b)


def triangular_solve(t, b, lower: bool = True, transposed: bool = False, unit: bool = False) -> np.ndarray:
    t = _square(t)
    t = np.tril(t) if lower else np.triu(t)
    if unit:
        np.fill_diagonal(t, 1.0)
    if (np.diag(t) == 0).any():
        raise SingularError("a zero on the diagonal")
    if transposed:
        t, lower = t.T, not lower
    x = np.array(b, float, copy=True)
    for i in range(len(t)) if lower else range(len(t) - 1, -1, -1):
        seen = slice(0, i) if lower else slice(i + 1, len(t))
        x[i] = (x[i] - t[i, seen] @ x[seen]) / t[i, i]
    return x


def lu_solve(factors: tuple[np.ndarray, np.ndarray], b) -> np.ndarray:
    packed, pivots = factors
    x = np.array(b, float, copy=True)
    for k, p in enumerate(pivots - 1):
        if p != k:
            x[[k, p]] = x[[p, k]]
    return triangular_solve(packed, triangular_solve(packed, x, True, unit=True), False)


def chol_solve(factor, b) -> np.ndarray:
    return triangular_solve(factor, triangular_solve(factor, b, True), True, transposed=True)


def norm(a, kind: str = "F") -> float:
    """F or E: Frobenius; 1 or O: greatest column sum; I: greatest row sum; M: greatest entry."""
    a, k = np.abs(_m(a)), kind.upper()
    if np.isnan(a).any():
        return float("nan")
    if k in ("F", "E"):
        return float(np.sqrt((a * a).sum()))
    if k in ("1", "O"):
        return float(a.sum(axis=0).max())
    if k == "I":
        return float(a.sum(axis=1).max())
    if k == "M":
        return float(a.max())
    raise ValueError(f"unknown norm {kind!r}")


def integer_power(a, n: int) -> np.ndarray:
    """Element-wise power by squaring; x ** 0 is 1."""
    a = np.asarray(a, float)
    out, base, k = np.ones_like(a), a.copy(), abs(int(n))
    while k:
        if k & 1:
            out = out * base
        base = base * base
        k >>= 1
    with np.errstate(divide="ignore"):
        return 1.0 / out if n < 0 else out


def transpose(a) -> np.ndarray:
    return _m(a).T.copy()


def trace(a) -> float:
    return float(np.trace(_square(a)))


def vcat(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def hcat(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Columns of both sides, rows matched by a position column that both have."""
    return a.join(b, on)


# --- tall matrices --------------------------------------------------------------------------


def multiply(df: DataFrame, xs: Sequence[str], small, names: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Tall times small: each result column is one expression, within the scan's stage."""
    small = _m(small)
    if small.shape[0] != len(xs):
        raise ValueError("inner dimensions differ")
    names = names or [f"col{j}" for j in range(small.shape[1])]
    cols = [F.col(x).cast("double") for x in xs]
    out = [sum((c * float(w) for c, w in zip(cols[1:], small[1:, j])), cols[0] * float(small[0, j])).alias(n) for j, n in enumerate(names)]
    return df.select(*keep, *out)


def multiply_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two matrices given by their cells, (i, k, v) times (k, j, v): cells (i, j, v).

    A join on the inner index and a sum that combines before its shuffle; cells that are not
    there are zeros, so both sides may be of any size.
    """
    left = a.select("i", "k", F.col("v").cast("double").alias("__a"))
    right = b.select("k", "j", F.col("v").cast("double").alias("__b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("__a") * F.col("__b")).alias("v"))


def combine(a: DataFrame, b: DataFrame, on: str, xs: Sequence[str], operation: str) -> DataFrame:
    """Element-wise ``add``, ``sub``, ``emul`` or ``ediv`` of the columns ``xs`` of two frames, rows matched by ``on``."""
    work = {"add": lambda p, q: p + q, "sub": lambda p, q: p - q, "emul": lambda p, q: p * q, "ediv": ieee.divide}[operation]
    right = b.select(F.col(on).alias("__on"), *[F.col(x).cast("double").alias(f"__{i}") for i, x in enumerate(xs)])
    both = a.join(right, F.col(on) == F.col("__on"))
    return both.select(on, *[work(F.col(x).cast("double"), F.col(f"__{i}")).alias(x) for i, x in enumerate(xs)])


def scale(df: DataFrame, xs: Sequence[str], factor: float, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[(F.col(x).cast("double") * float(factor)).alias(x) for x in xs])


def slice_rows(df: DataFrame, order_by: str, first: int, end: int) -> DataFrame:
    """Rows ``first`` up to before ``end`` in the order of a column, distributed."""
    from tessera.operators.stats import positions

    return positions(df, order_by, "__pos").where((F.col("__pos") >= first) & (F.col("__pos") < end)).drop("__pos")


def reshape(df: DataFrame, order_by: str, xs: Sequence[str], width: int, names: Sequence[str] | None = None) -> DataFrame:
    """The cells of ``xs`` in row order as rows of ``width`` columns, with the column ``row``."""
    from tessera.operators.stats import positions

    names = list(names or [f"col{j}" for j in range(width)])
    cells = F.posexplode(F.array(*[F.col(x).cast("double") for x in xs])).alias("__j", "__v")
    at = positions(df.select(F.col(order_by).alias("__t"), *[F.col(x).alias(x) for x in xs]), "__t", "__pos", xs).select("__pos", cells)
    at = at.withColumn("__at", F.col("__pos") * len(xs) + F.col("__j"))
    picked = [F.max(F.when(F.col("__at") % width == j, F.col("__v"))).alias(n) for j, n in enumerate(names)]
    return at.groupBy(F.floor(F.col("__at") / width).alias("row")).agg(*picked)


def dot(df: DataFrame, a: str, b: str, name: str = "dot") -> DataFrame:
    """Inner product of two columns."""
    return df.agg(F.coalesce(F.sum(F.col(a).cast("double") * F.col(b).cast("double")), F.lit(0.0)).alias(name))


def vector_norm(df: DataFrame, a: str, name: str = "norm") -> DataFrame:
    """Euclidean length of a column."""
    return dot(df, a, a, name).select(F.sqrt(name).alias(name))


def gram(df: DataFrame, xs: Sequence[str]) -> np.ndarray:
    """X'X by one aggregation with map-side partial sums."""
    cols = [F.col(x).cast("double") for x in xs]
    d = len(xs)
    row = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
    return out


def tsqr_r(df: DataFrame, xs: Sequence[str]) -> np.ndarray:
    """R of a tall-skinny QR: each partition reduces its rows to a d x d factor, then the
    factors are reduced again in groups, so the driver gets a few of them at any row count."""
    names, d = [f"x{i}" for i in range(len(xs))], len(xs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, d))
        for batch in batches:
            r = np.linalg.qr(np.concatenate([r, batch[names].to_numpy(float)]), mode="r")
        if len(r):
            yield pd.DataFrame(r, columns=names)

    schema = ", ".join(f"{n} double" for n in names)
    first = df.select(*[F.col(x).cast("double").alias(n) for x, n in zip(xs, names)]).mapInPandas(run, schema)
    parts = first.coalesce(16).mapInPandas(run, schema).collect()  # at most 16 factors of d rows
    return np.linalg.qr(np.array([tuple(p) for p in parts]).reshape(-1, d), mode="r")


def tall_svd(df: DataFrame, xs: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (descending) and right singular vectors (rows) of a tall matrix.

    They are those of its R factor; left vectors are :func:`multiply` by V' / s."""
    _, s, vt = np.linalg.svd(tsqr_r(df, xs), full_matrices=False)
    return s, vt


def _with_constant(df: DataFrame, xs: Sequence[str], y: str, intercept: bool) -> tuple[DataFrame, list[str]]:
    columns = [F.col(x).cast("double").alias(f"a{i}") for i, x in enumerate(xs)]
    names = [f"a{i}" for i in range(len(xs))]
    if intercept:
        columns, names = [F.lit(1.0).alias("a_const"), *columns], ["a_const", *names]
    return df.select(*columns, F.col(y).cast("double").alias("target")), [*names, "target"]


def lstsq(df: DataFrame, xs: Sequence[str], y: str, intercept: bool = False) -> np.ndarray:
    """Least squares of full rank, by the R factor of [X y] (no squared condition number)."""
    table, names = _with_constant(df, xs, y, intercept)
    r = tsqr_r(table, names)
    d = len(names) - 1
    r, b = r[:d, :d], r[:d, d]
    if r.shape[0] < d or rank(r) < d:
        raise SingularError("the regressors do not have full rank")
    return triangular_solve(r, b, lower=False)


def lstsq_min_norm(df: DataFrame, xs: Sequence[str], y: str, intercept: bool = False) -> tuple[np.ndarray, int]:
    """Least squares of least norm for any rank, and the rank."""
    table, names = _with_constant(df, xs, y, intercept)
    r = tsqr_r(table, names)
    d = len(names) - 1
    x, _, found, _ = np.linalg.lstsq(r[:, :d], r[:, d], rcond=RANK_CUTOFF)
    return x, int(found)
