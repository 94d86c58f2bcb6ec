"""Special functions, as numpy functions and as columns.

Spark has no error function, log-gamma or digamma, so the column forms are Arrow-batched
pandas UDFs over these vectorised kernels.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

_erfc = np.vectorize(math.erfc, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def norm_cdf(x):
    """Normal distribution function, accurate in the lower tail."""
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2.0))


def lgamma(x):
    return _lgamma(np.asarray(x, float))


def digamma(x):
    """Digamma for x > 0: recurrence up to 6, then the asymptotic series to x ** -10."""
    x = np.array(x, float, copy=True)
    if (x <= 0).any():
        raise ValueError("digamma needs x above zero")
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out = np.where(small, out - 1.0 / x, out)
        x = np.where(small, x + 1.0, x)
    y = 1.0 / (x * x)
    series = y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    return out + np.log(x) - 0.5 / x - series


def _column(kernel):
    @pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(kernel(x.to_numpy(float)))

    return run


def norm_cdf_column(c: Column) -> Column:
    return _column(norm_cdf)(c.cast("double"))


def digamma_column(c: Column) -> Column:
    return _column(digamma)(c.cast("double"))


def lgamma_column(c: Column) -> Column:
    return _column(lgamma)(c.cast("double"))
