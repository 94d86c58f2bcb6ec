"""Densities, scores and samplers of the normal, Student-t, their multivariate forms and the
matrix normal.

Scalar functions broadcast as numpy does.  In the multivariate ones ``x`` is n x d and
``loc`` is 1 x d (or n x d).  Gradients with respect to a covariance are those of the total
log-likelihood, each entry taken as independent.  An infinite number of degrees of freedom is
the normal distribution, element by element.  The column forms at the end are Catalyst
expressions for the normal, and Arrow-batched kernels where log-gamma is needed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions.rng import Rng
from tessera.functions.special import digamma, lgamma
from tessera.operators.linalg import cholesky

_LOG_2PI = math.log(2 * math.pi)


def _arrays(*xs):
    return [np.asarray(x, float) for x in xs]


# --- normal ---


def gauss_logpdf(x, loc=0.0, scale=1.0):
    x, loc, scale = _arrays(x, loc, scale)
    z = (x - loc) / scale
    return -0.5 * z * z - np.log(scale) - 0.5 * _LOG_2PI


def gauss_pdf(x, loc=0.0, scale=1.0):
    return np.exp(gauss_logpdf(x, loc, scale))


def gauss_dlogpdf_loc(x, loc=0.0, scale=1.0):
    x, loc, scale = _arrays(x, loc, scale)
    return (x - loc) / (scale * scale)


def gauss_dlogpdf_scale(x, loc=0.0, scale=1.0):
    x, loc, scale = _arrays(x, loc, scale)
    z = (x - loc) / scale
    return (z * z - 1) / scale


def gauss_sample(rng: Rng, loc, scale, shape: tuple[int, ...]) -> np.ndarray:
    n = int(np.prod(shape))
    return np.asarray(loc) + np.asarray(scale) * np.array([rng.normal() for _ in range(n)]).reshape(shape)


# --- Student t ---


def _split(nu, finite, infinite, *args):
    """``finite`` where nu is finite, ``infinite`` elsewhere."""
    *args, nu = np.broadcast_arrays(*_arrays(*args, nu))
    out, inf = np.empty(nu.shape), np.isinf(nu)
    if inf.any():
        out[inf] = infinite(*[a[inf] for a in args])
    if (~inf).any():
        out[~inf] = finite(*[a[~inf] for a in args], nu[~inf])
    return out


def student_logpdf(x, loc=0.0, scale=1.0, nu=1.0):
    def finite(x, loc, scale, nu):
        z = (x - loc) / scale
        return lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * np.log(nu * np.pi) - np.log(scale) - (nu + 1) / 2 * np.log1p(z * z / nu)

    return _split(nu, finite, gauss_logpdf, x, loc, scale)


def student_pdf(x, loc=0.0, scale=1.0, nu=1.0):
    return np.exp(student_logpdf(x, loc, scale, nu))


def student_dlogpdf_loc(x, loc=0.0, scale=1.0, nu=1.0):
    def finite(x, loc, scale, nu):
        z = (x - loc) / scale
        return (nu + 1) * z / (scale * (nu + z * z))

    return _split(nu, finite, gauss_dlogpdf_loc, x, loc, scale)


def student_dlogpdf_scale(x, loc=0.0, scale=1.0, nu=1.0):
    def finite(x, loc, scale, nu):
        z = (x - loc) / scale
        return ((nu + 1) * z * z / (nu + z * z) - 1) / scale

    return _split(nu, finite, gauss_dlogpdf_scale, x, loc, scale)


def _score_of_nu(q, nu, d):
    return 0.5 * (digamma((nu + d) / 2) - digamma(nu / 2)) - d / (2 * nu) - 0.5 * np.log1p(q / nu) + (nu + d) * q / (2 * nu * (nu + q))


def student_dlogpdf_nu(x, loc=0.0, scale=1.0, nu=1.0):
    return _split(nu, lambda x, loc, scale, nu: _score_of_nu(((x - loc) / scale) ** 2, nu, 1), lambda x, *_: np.zeros_like(x), x, loc, scale)


def student_sample(rng: Rng, loc, scale, nu: float, shape: tuple[int, ...]) -> np.ndarray:
    z = gauss_sample(rng, 0.0, 1.0, shape)
    if not math.isinf(nu):
        z = z * np.sqrt(nu / np.array([2 * rng.gamma(nu / 2) for _ in range(z.size)]).reshape(shape))
    return np.asarray(loc) + np.asarray(scale) * z


# --- multivariate ---


class _Deviations:
    """What every multivariate function starts from: one Cholesky factor for all rows."""

    def __init__(self, x, loc, cov) -> None:
        self.x, loc, cov = np.atleast_2d(np.asarray(x, float)), np.atleast_2d(np.asarray(loc, float)), np.atleast_2d(np.asarray(cov, float))
        self.n, self.d = self.x.shape
        self.low = cholesky(np.tril(cov) + np.tril(cov, -1).T)
        self.diff = self.x - loc
        self.white = np.linalg.solve(self.low, self.diff.T)
        self.q = (self.white * self.white).sum(axis=0)
        self.half_logdet = np.log(np.diag(self.low)).sum()

    def solved(self) -> np.ndarray:
        """cov^-1 (x - loc), a row for each row."""
        return np.linalg.solve(self.low.T, self.white).T

    def inverse(self) -> np.ndarray:
        half = np.linalg.inv(self.low)
        return half.T @ half


def mvgauss_logpdf(x, loc, cov):
    d = _Deviations(x, loc, cov)
    return -0.5 * d.q - d.half_logdet - 0.5 * d.d * _LOG_2PI


def mvgauss_pdf(x, loc, cov):
    return np.exp(mvgauss_logpdf(x, loc, cov))


def mvgauss_dlogpdf_loc(x, loc, cov):
    return _Deviations(x, loc, cov).solved()


def mvgauss_dlogpdf_cov(x, loc, cov):
    d = _Deviations(x, loc, cov)
    w = d.solved()
    return (w.T @ w - d.n * d.inverse()) / 2


def mvgauss_sample(rng: Rng, loc, cov, n: int) -> np.ndarray:
    low = cholesky(cov)
    return np.atleast_2d(np.asarray(loc, float)) + gauss_sample(rng, 0.0, 1.0, (n, len(low))) @ low.T


def mvstudent_logpdf(x, loc, cov, nu: float):
    if math.isinf(nu):
        return mvgauss_logpdf(x, loc, cov)
    d = _Deviations(x, loc, cov)
    top = math.lgamma((nu + d.d) / 2) - math.lgamma(nu / 2) - 0.5 * d.d * math.log(nu * math.pi)
    return top - d.half_logdet - (nu + d.d) / 2 * np.log1p(d.q / nu)


def mvstudent_pdf(x, loc, cov, nu: float):
    return np.exp(mvstudent_logpdf(x, loc, cov, nu))


def mvstudent_dlogpdf_loc(x, loc, cov, nu: float):
    if math.isinf(nu):
        return mvgauss_dlogpdf_loc(x, loc, cov)
    d = _Deviations(x, loc, cov)
    return d.solved() * ((nu + d.d) / (nu + d.q))[:, None]


def mvstudent_dlogpdf_cov(x, loc, cov, nu: float):
    if math.isinf(nu):
        return mvgauss_dlogpdf_cov(x, loc, cov)
    d = _Deviations(x, loc, cov)
    w = d.solved()
    return ((w * ((nu + d.d) / (nu + d.q))[:, None]).T @ w - d.n * d.inverse()) / 2


def mvstudent_dlogpdf_nu(x, loc, cov, nu: float):
    d = _Deviations(x, loc, cov)
    return np.zeros(d.n) if math.isinf(nu) else _score_of_nu(d.q, np.full(d.n, float(nu)), d.d)


def mvstudent_sample(rng: Rng, loc, cov, nu: float, n: int) -> np.ndarray:
    low = cholesky(cov)
    z = gauss_sample(rng, 0.0, 1.0, (n, len(low))) @ low.T
    if not math.isinf(nu):
        z = z * np.sqrt(nu / np.array([2 * rng.gamma(nu / 2) for _ in range(n)]))[:, None]
    return np.atleast_2d(np.asarray(loc, float)) + z


# --- matrix normal: one n x p observation a call ---


def _whitened(x, loc, rowcov, colcov):
    x, loc = np.atleast_2d(np.asarray(x, float)), np.atleast_2d(np.asarray(loc, float))
    r, c = cholesky(rowcov), cholesky(colcov)
    if x.shape != loc.shape or x.shape != (len(r), len(c)):
        raise ValueError("x and loc are n x p, rowcov is n x n and colcov p x p")
    half = np.linalg.solve(r, x - loc)
    return np.linalg.solve(c, half.T).T, r, c


def matgauss_logpdf(x, loc, rowcov, colcov) -> float:
    w, r, c = _whitened(x, loc, rowcov, colcov)
    n, p = w.shape
    return float(-0.5 * (w * w).sum() - p * np.log(np.diag(r)).sum() - n * np.log(np.diag(c)).sum() - 0.5 * n * p * _LOG_2PI)


def matgauss_pdf(x, loc, rowcov, colcov) -> float:
    return math.exp(matgauss_logpdf(x, loc, rowcov, colcov))


def matgauss_dlogpdf_loc(x, loc, rowcov, colcov):
    w, r, c = _whitened(x, loc, rowcov, colcov)
    return np.linalg.solve(r.T, w) @ np.linalg.inv(c)


def matgauss_dlogpdf_rowcov(x, loc, rowcov, colcov):
    w, r, _ = _whitened(x, loc, rowcov, colcov)
    a, inverse = np.linalg.solve(r.T, w), np.linalg.inv(r)
    return (a @ a.T - w.shape[1] * inverse.T @ inverse) / 2


def matgauss_dlogpdf_colcov(x, loc, rowcov, colcov):
    w, _, c = _whitened(x, loc, rowcov, colcov)
    s, inverse = w @ np.linalg.inv(c), np.linalg.inv(c)
    return (s.T @ s - w.shape[0] * inverse.T @ inverse) / 2


def matgauss_sample(rng: Rng, loc, rowcov, colcov) -> np.ndarray:
    loc = np.atleast_2d(np.asarray(loc, float))
    return loc + cholesky(rowcov) @ gauss_sample(rng, 0.0, 1.0, loc.shape) @ cholesky(colcov).T


# --- columns ---


def gauss_logpdf_column(x: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    z = (x.cast("double") - F.lit(float(loc))) / F.lit(float(scale))
    return F.lit(-0.5) * z * z - F.lit(math.log(scale) + 0.5 * _LOG_2PI)


def gauss_score_columns(x: Column, loc: float = 0.0, scale: float = 1.0) -> tuple[Column, Column]:
    """Derivatives of the log-density by loc and by scale."""
    z = (x.cast("double") - F.lit(float(loc))) / F.lit(float(scale))
    return z / F.lit(float(scale)), (z * z - 1) / F.lit(float(scale))


def gauss_sample_column(loc: float = 0.0, scale: float = 1.0, seed: int = 0) -> Column:
    return F.randn(seed) * F.lit(float(scale)) + F.lit(float(loc))


def student_logpdf_column(x: Column, loc: float = 0.0, scale: float = 1.0, nu: float = 1.0) -> Column:
    @pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(student_logpdf(v.to_numpy(float), loc, scale, nu))

    return run(x.cast("double"))


def mv_logpdf(df: DataFrame, xs: Sequence[str], loc, cov, nu: float = math.inf, name: str = "logpdf", keep: Sequence[str] = ()) -> DataFrame:
    """Multivariate log-density of each row; the d x d covariance goes to the executors once."""
    sent = df.sparkSession.sparkContext.broadcast((np.asarray(loc, float), np.asarray(cov, float)))

    @pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        a = np.array(x.tolist(), float).reshape(len(x), -1)
        return pd.Series(mvstudent_logpdf(a, *sent.value, nu) if len(a) else np.zeros(0))

    return df.select(*keep, run(F.array(*[F.col(c).cast("double") for c in xs])).alias(name))
