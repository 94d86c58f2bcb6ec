"""Descriptive statistics and prediction metrics.

Conventions: double accumulation; variances and covariances divide by n, not n - 1; a
correlation with a constant side is an error.  Every function takes a frame and column names
and returns a frame: one row, or one a group where ``by`` names group columns.

Order matters to the lag statistics, and Spark frames have none, so these take ``order_by``.
Rows get global positions without a one-task window: quantiles of the order column make
buckets, bucket sizes are summed up, and rows are numbered inside buckets.  Lags then look
back over chunks of positions that overlap by the greatest lag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ieee

By = Sequence[str] | None
_CHUNK = 50_000
_BUCKETS = 64
#: Rows that a bucket holds, about, however many rows there are.
_BUCKET_ROWS = 100_000


class StatsError(ValueError):
    """The statistic is not defined for the input."""


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _agg(df: DataFrame, by: By, *columns: Column) -> DataFrame:
    return df.groupBy(*by).agg(*columns) if by else df.agg(*columns)


def _guard(bad: Column, message: str, value: Column) -> Column:
    """``value``, or an error at run time where ``bad`` holds."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def mean(df: DataFrame, x: str, by: By = None, name: str = "mean") -> DataFrame:
    return _agg(df, by, F.avg(_d(x)).alias(name))


def variance(df: DataFrame, x: str, by: By = None, name: str = "var") -> DataFrame:
    return _agg(df, by, F.var_pop(_d(x)).alias(name))


def correlation(df: DataFrame, x: str, y: str, by: By = None, name: str = "corr") -> DataFrame:
    return _agg(df, by, _corr(_d(x), _d(y)).alias(name))


def _corr(x: Column, y: Column) -> Column:
    vx, vy = F.var_pop(x), F.var_pop(y)
    value = F.covar_pop(x, y) / F.when((vx > 0) & (vy > 0), F.sqrt(vx) * F.sqrt(vy)).otherwise(F.lit(None))
    return _guard(~((vx > 0) & (vy > 0)), "correlation of a constant column", value)


def column_means(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(_d(x)).alias(x) for x in xs])


def median(df: DataFrame, x: str, by: By = None, name: str = "median", approx: bool = False) -> DataFrame:
    """Exact by default; ``approx`` keeps a sketch of bounded size instead of all values.

    Ungrouped, the middle rows are found by their positions, so no task holds all values.
    """
    if approx or by:
        return _agg(df, by, (F.percentile_approx(_d(x), 0.5, 10_000) if approx else F.median(_d(x))).alias(name))
    values = df.select(_d(x).alias("__x")).where(F.col("__x").isNotNull())
    n = values.count()
    placed = positions(values, "__x", "__pos", rows=n)
    return placed.where(F.col("__pos").isin((n - 1) // 2, n // 2)).agg(F.avg("__x").alias(name))


def _scale(df: DataFrame, column: str) -> Column:
    """The column as a double, in the same order (times without a zone as whole seconds)."""
    c, kind = F.col(column), df.schema[column].dataType.typeName()
    if kind not in ("date", "timestamp_ntz"):
        return c.cast("double")
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    if kind == "date":
        return days
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def _bucketed(df: DataFrame, column: str, rows: int | None = None) -> DataFrame:
    """Add ``__bucket``, which grows with a numeric or time column.

    Quantiles make ``_BUCKETS`` wide buckets; each is cut evenly between its ends, as often as
    the number of rows asks for.  Equal values share a bucket.
    """
    value = _scale(df, column)
    at = [i / _BUCKETS for i in range(_BUCKETS + 1)]
    bounded = df.where(~F.isnan(value))
    found = bounded.agg(F.percentile_approx(value, at, 10_000).alias("q"), F.count(F.lit(1)).alias("n")).first()
    bounds = sorted({q for q in (found["q"] or []) if abs(q) != float("inf")}) if found else []
    cuts = max(1, -(-(rows or (found["n"] if found else 0)) // (_BUCKETS * _BUCKET_ROWS)))
    if not bounds:
        return df.withColumn("__bucket", F.lit(0).cast("long"))
    df = df.withColumn("__scaled", value)
    df, value, wide = df.withColumn("__wide", _bounds_below(F.col("__scaled"), bounds)), F.col("__scaled"), F.col("__wide")
    if cuts == 1:
        return df.withColumn("__bucket", wide.cast("long")).drop("__scaled", "__wide")
    ends = F.array(*[F.lit(b) for b in bounds])
    low, high = F.element_at(ends, F.greatest(wide, F.lit(1))), F.element_at(ends, F.least(wide + 1, F.lit(len(bounds))))
    part = F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))
    part = F.when(F.isnan(value) | (wide >= len(bounds)), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(part, F.lit(1.0))))
    return df.withColumn("__bucket", (wide * (cuts + 1) + F.floor(part * cuts)).cast("long")).drop("__scaled", "__wide")


def _bounds_below(value: Column, bounds: Sequence[float], start: int = 0) -> Column:
    """How many of the sorted bounds lie below the value, by bisection."""
    if not bounds:
        return F.lit(start)
    mid = len(bounds) // 2
    return F.when(F.lit(bounds[mid]) < value, _bounds_below(value, bounds[mid + 1 :], start + mid + 1)).otherwise(_bounds_below(value, bounds[:mid], start))


def positions(df: DataFrame, order_by: str, name: str = "pos", ties: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Add the row's position from 0 in the order of a numeric or time column (nulls are dropped).

    Rows that are equal in it follow the order of the columns ``ties``; what is equal there too
    may come in any order.
    """
    tagged = _bucketed(df.where(F.col(order_by).isNotNull()), order_by, rows)
    sizes = tagged.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    starts = sizes.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(order_by, *ties)) - 1
    placed = tagged.withColumn("__inside", inside).join(starts, F.col("__bucket").eqNullSafe(F.col("__b")))
    return placed.withColumn(name, (F.col("__start") + F.col("__inside")).cast("long")).drop("__bucket", "__b", "__inside", "__start")


def lagged(df: DataFrame, xs: Sequence[str], order_by: str, lags: Sequence[int], by: By = None, ties: Sequence[str] = ()) -> DataFrame:
    """Columns ``x`` and ``x_lag{k}`` (null before the start) for each row, distributed.

    With ``by`` each group is a series of its own (one window partition a group).  Rows of one
    time follow the columns ``ties`` (say, their place in a file), then the order of their values,
    so the result depends on the data alone.
    """
    last = [*[f"__tie{i}" for i in range(len(ties))], *xs]
    picked = [F.col(order_by).alias("__t"), *[F.col(c).alias(f"__tie{i}") for i, c in enumerate(ties)], *[_d(x).alias(x) for x in dict.fromkeys(xs)]]
    if by:
        w = Window.partitionBy(*by).orderBy("__t", *last)
        return df.select(*by, *picked).select(*by, *xs, *[F.lag(x, k).over(w).alias(f"{x}_lag{k}") for x in xs for k in lags])
    most = max(lags, default=0)
    size = max(_CHUNK, 4 * most)
    placed = positions(df.select(*picked), "__t", "__pos", last).select("__pos", *dict.fromkeys(xs))
    chunk = F.floor(F.col("__pos") / size)
    tail = F.col("__pos") % size >= size - most
    copies = F.when(tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    placed = placed.withColumn("__own", chunk).withColumn("__chunk", F.explode(copies))
    w = Window.partitionBy("__chunk").orderBy("__pos")
    out = placed.select("__own", "__chunk", *xs, *[F.lag(x, k).over(w).alias(f"{x}_lag{k}") for x in xs for k in lags])
    return out.where(F.col("__own") == F.col("__chunk")).drop("__own", "__chunk")


def autocorrelation(df: DataFrame, x: str, lag: int, order_by: str, by: By = None, name: str = "autocorr", ties: Sequence[str] = ()) -> DataFrame:
    """Correlation of a series with itself ``lag`` rows on, each side with its own mean."""
    rows = lagged(df, [x], order_by, [lag], by, ties).where(F.col(f"{x}_lag{lag}").isNotNull())
    c = _corr(F.col(x), F.col(f"{x}_lag{lag}"))
    return _agg(rows, by, _guard(F.count(F.lit(1)) < 2, "autocorrelation needs two pairs", c).alias(name))


def _centred(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    means = df.agg(*[F.avg(_d(x)).alias(f"__m{i}") for i, x in enumerate(xs)])
    shown = df.crossJoin(F.broadcast(means))  # one row
    for i, x in enumerate(xs):
        shown = shown.withColumn(x, _d(x) - F.col(f"__m{i}"))
    return shown.drop(*[f"__m{i}" for i in range(len(xs))])


def autocovariance(df: DataFrame, xs: Sequence[str], lag: int = 0, order_by: str | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Matrix as rows (row, column, value): mean of a(t) * b(t + lag), centred by full-sample means."""
    if lag == 0:
        rows = df.agg(*[F.covar_pop(_d(a), _d(b)).alias(f"v{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs)])
    else:
        if order_by is None:
            raise ValueError("a lag needs order_by")
        pairs = lagged(_centred(df.select(order_by, *ties, *xs), xs), xs, order_by, [lag], ties=ties)  # pairs with a null count for neither sum nor number
        rows = pairs.agg(*[F.avg(F.col(f"{a}_lag{lag}") * F.col(b)).alias(f"v{i}_{j}") for i, a in enumerate(xs) for j, b in enumerate(xs)])
    cells = [F.struct(F.lit(a).alias("row"), F.lit(b).alias("column"), F.col(f"v{i}_{j}").alias("value")) for i, a in enumerate(xs) for j, b in enumerate(xs)]
    return rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def hac_weight(kernel: str, k: int, lags: int) -> float:
    """Bartlett: 1 - k / (lags + 1); rectangular: 1."""
    if kernel not in ("bartlett", "rectangular"):
        raise ValueError(f"unknown kernel {kernel!r}")
    return 1.0 - k / (lags + 1) if kernel == "bartlett" else 1.0


def hac_variance(df: DataFrame, x: str, lags: int, order_by: str, kernel: str = "bartlett", name: str = "hac", ties: Sequence[str] = ()) -> DataFrame:
    """Long-run variance: g0 + 2 * sum of w(k) g(k), every g(k) divided by n."""
    hac_weight(kernel, 0, lags)
    rows = lagged(_centred(df.select(order_by, *ties, x), [x]), [x], order_by, list(range(1, lags + 1)), ties=ties)
    n = F.count(F.lit(1))
    total = F.sum(F.col(x) * F.col(x))
    for k in range(1, lags + 1):
        total = total + F.lit(2.0 * hac_weight(kernel, k, lags)) * F.coalesce(F.sum(F.col(x) * F.col(f"{x}_lag{k}")), F.lit(0.0))
    return rows.agg((total / n).alias(name))


def rank(df: DataFrame, x: str, by: By = None, name: str = "rank") -> DataFrame:
    """Add the ascending rank from 1; ties share the mean of their ranks.

    Ungrouped: equal values are counted, counts are summed up over buckets of values, and the
    ranks of the distinct values are joined back.
    """
    if by:
        w = Window.partitionBy(*by)
        low = F.rank().over(w.orderBy(_d(x)))
        same = F.count(F.lit(1)).over(Window.partitionBy(*by, _d(x)))
        return df.withColumn(name, low + (same - 1) / F.lit(2.0))
    counts = df.groupBy(_d(x).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    counts = _bucketed(counts, "__v")
    sizes = counts.groupBy("__bucket").agg(F.sum("__n").alias("__s"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    starts = sizes.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__bucket").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(starts, F.col("__bucket").eqNullSafe(F.col("__b")))
    ranked = ranked.select("__v", (F.col("__start") + F.col("__in") + (F.col("__n") + 1) / F.lit(2.0)).alias(name))
    return df.join(ranked, _d(x).eqNullSafe(F.col("__v"))).drop("__v")


def spearman(df: DataFrame, x: str, y: str, by: By = None, name: str = "spearman") -> DataFrame:
    keep = [*(by or []), x, y]
    ranked = rank(rank(df.select(*keep), x, by, "__rx"), y, by, "__ry")
    return _agg(ranked, by, _corr(F.col("__rx"), F.col("__ry")).alias(name))


def _error(actual: str, predicted: str) -> Column:
    return _d(actual) - _d(predicted)


def mae(df: DataFrame, actual: str, predicted: str, by: By = None, name: str = "mae") -> DataFrame:
    return _agg(df, by, F.avg(F.abs(_error(actual, predicted))).alias(name))


def mse(df: DataFrame, actual: str, predicted: str, by: By = None, name: str = "mse") -> DataFrame:
    e = _error(actual, predicted)
    return _agg(df, by, F.avg(e * e).alias(name))


def rmse(df: DataFrame, actual: str, predicted: str, by: By = None, name: str = "rmse") -> DataFrame:
    e = _error(actual, predicted)
    return _agg(df, by, F.sqrt(F.avg(e * e)).alias(name))


def medae(df: DataFrame, actual: str, predicted: str, by: By = None, name: str = "medae") -> DataFrame:
    return median(df.select(*(by or []), F.abs(_error(actual, predicted)).alias("__error")), "__error", by, name)


def mape(df: DataFrame, actual: str, predicted: str, by: By = None, name: str = "mape") -> DataFrame:
    """As a fraction; an actual value of zero is an error."""
    a = _d(actual)
    value = F.avg(F.abs(_error(actual, predicted)) / F.when(a != 0, F.abs(a)).otherwise(F.lit(None)))
    return _agg(df, by, _guard(F.count_if(a == 0) > 0, "mape of an actual value of zero", value).alias(name))


def rmsle(df: DataFrame, actual: str, predicted: str, by: By = None, name: str = "rmsle") -> DataFrame:
    """Root mean square of log(actual) - log(predicted); both must be above zero."""
    a, p = _d(actual), _d(predicted)
    e = F.ln(a) - F.ln(p)
    return _agg(df, by, _guard(F.count_if((a <= 0) | (p <= 0)) > 0, "rmsle needs values above zero", F.sqrt(F.avg(e * e))).alias(name))


def r2(df: DataFrame, actual: str, predicted: str, by: By = None, name: str = "r2") -> DataFrame:
    e, v = _error(actual, predicted), F.var_pop(_d(actual))
    value = F.lit(1.0) - F.avg(e * e) / F.when(v > 0, v).otherwise(F.lit(None))
    return _agg(df, by, _guard(~(v > 0), "r2 of a constant actual", value).alias(name))


def huber(df: DataFrame, actual: str, predicted: str, delta: float = 1.0, by: By = None, name: str = "huber") -> DataFrame:
    if not delta > 0:
        raise StatsError("delta must be above zero")
    e = F.abs(_error(actual, predicted))
    return _agg(df, by, F.avg(F.when(e <= delta, e * e / 2).otherwise(delta * (e - delta / 2))).alias(name))


def matrix_norms(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Frobenius, one, infinity and max norms of the matrix of the columns ``xs``."""
    cols = [_d(x) for x in xs]
    square = sum((c * c for c in cols[1:]), cols[0] * cols[0])
    row = sum((F.abs(c) for c in cols[1:]), F.abs(cols[0]))
    greatest = F.greatest(*[F.max(F.abs(c)) for c in cols]) if len(cols) > 1 else F.max(F.abs(cols[0]))
    one = F.greatest(*[F.sum(F.abs(c)) for c in cols]) if len(cols) > 1 else F.sum(F.abs(cols[0]))
    return df.agg(F.sqrt(F.sum(square)).alias("frobenius"), one.alias("one"), F.max(row).alias("infinity"), greatest.alias("largest"))


def reductions(df: DataFrame, x: str, by: By = None) -> DataFrame:
    """sum, mean, max and min of a column, NaN-poisoned."""
    return _agg(df, by, ieee.sum0(_d(x)).alias("sum"), ieee.avg_nan(_d(x)).alias("mean"), ieee.max_nan(_d(x)).alias("max"), ieee.min_nan(_d(x)).alias("min"))
