"""Forecast comparison: loss tables, the model confidence set and the Diebold-Mariano test.

A loss table has one numeric column for each model.  The confidence set removes, round by
round, the worst model of a test of equal losses whose distribution comes from a moving-block
bootstrap.  Draws are cut into ranges that executors work on; block starts come from one
PCG64 stream, and each draw gets the stream's state where its starts begin, so a seed gives one
result whatever the cluster.
A loss table of few cells is gathered and sent to the executors.  A longer one stays on them:
rows get positions, are packed in blocks of positions and written to the shared folder, and
each task reads a bounded stretch of them.  Means of draws are linear in the losses, so one
pass over all draws of all rounds gives their means for each model, and these (one row a draw)
are all that the rounds need on the driver.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from copy import copy
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ieee, special
from tessera.functions.rng import Rng
from tessera.operators.stats import hac_weight, lagged, positions
from tessera.plans.lowering import NUM, kind_of

#: Cells of a loss matrix that may be gathered for a test that looks at whole resampled series (hac_resample).
MOST_CELLS = 50_000_000
#: Cells up to which a loss matrix is gathered for the other tests; above, it stays on the executors.
GATHERED_CELLS = 2_000_000
#: Cells that a task holds of a matrix that stays there, rows of one block of it, and block starts drawn at once.
_TASK_CELLS = 24_000_000
_BLOCK_ROWS = 16_384
_STARTS = 32_768
_FLOOR = 1e-12


def loss(df: DataFrame, actual: str, forecasts: Sequence[str], kind: str = "mse", keep: Sequence[str] = ()) -> DataFrame:
    """Losses of forecasts: mse (a - f)^2, mae |a - f|, qlike log f + a / f (f > 0, else an error)."""
    a = F.col(actual).cast("double")

    def of(name: str):
        f = F.col(name).cast("double")
        if kind == "mse":
            return (a - f) * (a - f)
        if kind == "mae":
            return F.abs(a - f)
        if kind == "qlike":
            return F.when(f > 0, F.ln(f) + ieee.divide(a, f)).otherwise(F.raise_error(F.lit("qlike needs forecasts above zero")).cast("double"))
        raise ValueError(f"unknown loss {kind!r}")

    return df.select(*keep, *[of(n).alias(n) for n in forecasts])


def model_names(losses: DataFrame) -> list[str]:
    return [f.name for f in losses.schema.fields if kind_of(f.dataType) == NUM]


@dataclass(frozen=True)
class Options:
    alpha: float = 0.05
    draws: int = 2000
    block: int = 10
    statistic: str = "tmax"  # or tr
    variance: str = "bootstrap"  # or hac, hac_resample
    kernel: str = "bartlett"
    hac_lag: int = -1
    seed: int = 123
    stream: int = 0

    def lag(self, n: int) -> int:
        return min(max(0, self.block - 1 if self.hac_lag < 0 else self.hac_lag), n - 1)


@dataclass
class Result:
    models: list[str]
    mean_loss: list[float]
    pvalue: list[float]
    in_set: list[bool]
    eliminated: list[str] = field(default_factory=list)
    converged: bool = True

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.models, self.mean_loss, self.pvalue, self.in_set))
        return spark.createDataFrame(rows, "model string, mean_loss double, pvalue double, in_set boolean")


def block_starts(rng: Rng, n: int, block: int, draws: int) -> np.ndarray:
    """Starts of the blocks of each draw, uniform on [0, n - block]."""
    per = -(-n // block)
    return rng.below_many(n - block + 1, draws * per).reshape(draws, per)


def _draw_states(rng: Rng, n: int, block: int, draws: int) -> list[Rng]:
    """The generator before each of the draws that ``block_starts`` would make in a row; moves ``rng`` past them."""
    out = []
    for _ in range(draws):
        out.append(copy(rng))
        block_starts(rng, n, block, 1)
    return out


def block_indices(starts: np.ndarray, n: int, block: int) -> np.ndarray:
    """Rows of one draw: the blocks in order, the last one cut."""
    return (starts[:, None] + np.arange(block)[None, :]).ravel()[:n]


def differentials(x: np.ndarray, statistic: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """tr: all pairs i < j; tmax: own loss minus the mean of the others."""
    m = x.shape[1]
    if statistic == "tr":
        pairs = [(i, j) for i in range(m) for j in range(i + 1, m)]
        return np.stack([x[:, i] - x[:, j] for i, j in pairs], axis=1), pairs
    total = x.sum(axis=1, keepdims=True)
    return x - (total - x) / (m - 1), [(i, i) for i in range(m)]


def _hac_of_mean(d: np.ndarray, lag: int, kernel: str) -> np.ndarray:
    n = len(d)
    c = d - d.mean(axis=0)
    v = (c * c).sum(axis=0) / n
    for k in range(1, lag + 1):
        v = v + 2 * hac_weight(kernel, k, lag) * (c[k:] * c[:-k]).sum(axis=0) / n
    return np.maximum(v / n, _FLOOR)


def _reduce(t: np.ndarray, statistic: str) -> np.ndarray:
    return np.abs(t).max(axis=-1) if statistic == "tr" else t.max(axis=-1)


def worst_model(t: np.ndarray, pairs: list[tuple[int, int]], m: int, statistic: str) -> int:
    """tmax: the greatest t; tr: the model whose greatest pairwise t is greatest."""
    if statistic == "tmax":
        return int(np.argmax(t))
    full = np.full((m, m), -np.inf)
    for k, (i, j) in enumerate(pairs):
        full[i, j], full[j, i] = t[k], -t[k]
    return int(np.argmax(full.max(axis=1)))


def _draw_means(d: np.ndarray, states: Sequence[Rng], o: Options, resample: bool) -> tuple[np.ndarray, np.ndarray | None]:
    means, variances = [], []
    for state in states:
        starts = block_starts(copy(state), len(d), o.block, 1)[0]
        x = d[block_indices(starts, len(d), o.block)]
        means.append(x.mean(axis=0))
        if resample:
            variances.append(_hac_of_mean(x, o.lag(len(d)), o.kernel))
    return np.array(means), np.array(variances) if resample else None


def _round(spark: SparkSession | None, d: np.ndarray, states: list[Rng], o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and bootstrap means (and variances) of one round; on executors if ``spark`` is given."""
    resample = o.variance == "hac_resample"
    if spark is None:
        means, variances = _draw_means(d, states, o, resample)
    else:
        sent = spark.sparkContext.broadcast((d, states))
        width = d.shape[1]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            data, plan = sent.value
            for batch in batches:
                m, v = _draw_means(data, [plan[i] for i in batch["id"]], o, resample)
                both = np.concatenate([m, v], axis=1) if v is not None else m
                yield pd.DataFrame({"id": batch["id"].to_numpy(), "x": list(both)})

        rows = spark.range(len(states)).mapInPandas(run, "id long, x array<double>").orderBy("id").collect()  # one row a draw
        both = np.array([r.x for r in rows])
        means, variances = both[:, :width], both[:, width:] if resample else None
        sent.destroy()
    mean = d.mean(axis=0)
    centred = means - mean
    if o.variance == "bootstrap":
        v = np.maximum((centred * centred).mean(axis=0), _FLOOR)
    else:
        v = _hac_of_mean(d, o.lag(len(d)), o.kernel)
    t = mean / np.sqrt(v)
    return t, centred / np.sqrt(variances if resample else v), mean


def _matrix(losses: DataFrame, names: list[str], order_by: str | None, rows: int, ties: Sequence[str] = ()) -> np.ndarray:
    if rows * max(1, len(names)) > MOST_CELLS:
        raise ValueError(f"a loss table of {rows} x {len(names)} is above the {MOST_CELLS} cells a test gathers")
    df = losses.orderBy(order_by, *ties) if order_by else losses
    return df.select(*[F.col(n).cast("double") for n in names]).toPandas().to_numpy(float)


def _packed(losses: DataFrame, names: list[str], order_by: str | None, rows: int, ties: Sequence[str]) -> DataFrame:
    """The matrix as rows (block, x): bytes of ``_BLOCK_ROWS`` rows by position."""
    picked = [F.coalesce(F.col(n).cast("double"), F.lit(math.nan)).alias(f"x{i}") for i, n in enumerate(names)]
    cells = [f"x{i}" for i in range(len(names))]
    t = F.col(order_by) if order_by else F.monotonically_increasing_id()
    last = [F.col(c).alias(f"__tie{i}") for i, c in enumerate(ties)]
    placed = positions(losses.select(t.alias("__t"), *last, *picked), "__t", "__pos", [*[f"__tie{i}" for i in range(len(ties))], *cells], rows)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__pos")
        return pd.DataFrame({"block": part["block"].iloc[:1].to_numpy(), "x": [part[cells].to_numpy(float).tobytes()]})

    placed = placed.select(F.floor(F.col("__pos") / _BLOCK_ROWS).cast("long").alias("block"), "__pos", *cells)
    return placed.groupBy("block").applyInPandas(pack, "block long, x binary")


def _sums_of_blocks(x: np.ndarray, length: int) -> None:
    """In place: each row becomes the sum of the ``length`` rows from it on (fewer at the end)."""
    for at in range(0, len(x), _STARTS):
        piece = x[at : at + _STARTS + length - 1]
        size = min(_STARTS, len(piece))
        total = np.zeros((size, x.shape[1]))
        for j in range(length):
            total[: len(piece) - j] += piece[j : j + size]
        x[at : at + size] = total


def _draw_sums(blocks: DataFrame, m: int, n: int, block: int, offsets: dict[int, int], rng: Rng) -> tuple[dict[int, np.ndarray], set[int]]:
    """Sums of the resampled rows of the draws whose starts begin so many words into ``rng``, and
    which words of the stream (from 0) were rejected on the way."""
    spark, per = blocks.sparkSession, -(-n // block)
    last = n - (per - 1) * block  # rows of the last block
    stretch = max(1, _TASK_CELLS // (m if last == block else 2 * m) // _BLOCK_ROWS) * _BLOCK_ROWS
    stretch = max(stretch, -(-block // _BLOCK_ROWS) * _BLOCK_ROWS)
    ids = sorted(offsets)
    groups = min(len(ids), max(2 * spark.sparkContext.defaultParallelism, -(-len(ids) * per // 200_000_000)))
    shares = [[(i, offsets[i]) for i in ids[g::groups]] for g in range(groups)]
    sums, rejected = {i: np.zeros(m) for i in ids}, set()
    for low in range(0, n - block + 1, stretch):
        high = min(n, low + stretch + block - 1)  # blocks that start before low + stretch end before it
        size = high - low

        def run(batches: Iterator[pa.RecordBatch], low: int = low, size: int = size) -> Iterator[pa.RecordBatch]:
            x, mine = np.zeros((size, m)), set()
            for batch in batches:
                for b, cells in zip(batch.column("block").to_pylist(), batch.column("x")):
                    rows, at = np.frombuffer(cells.as_buffer(), float).reshape(-1, m), b * _BLOCK_ROWS - low
                    rows, at = rows[max(0, -at) :], max(0, at)
                    rows = rows[: size - at]
                    x[at : at + len(rows)] = rows
                mine.update(batch.column("share").to_pylist())
            if not mine:
                return
            end = x.copy() if last < block else None
            _sums_of_blocks(x, block)
            if end is not None:
                _sums_of_blocks(end, last)
            top, ones = min(stretch, size), np.ones(_STARTS)
            for i, offset in [draw for g in sorted(mine) for draw in shares[g]]:
                stream, total, bad, words = copy(rng).advance(offset), np.zeros(m), [], offset
                for done in range(0, per, _STARTS):
                    starts, off, taken = stream.below_told(n - block + 1, min(_STARTS, per - done))
                    bad += [words + k for k in off]
                    words += taken
                    starts -= low
                    if end is not None and done + _STARTS >= per:
                        if 0 <= starts[-1] < top:
                            total += end[starts[-1]]
                        starts = starts[:-1]
                    if size < n:
                        starts = starts[(starts >= 0) & (starts < top)]
                    total += ones[: len(starts)] @ x.take(starts, axis=0)
                told = pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([bad], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([i]), *told], ["id", "x", "rejected"])

        here = blocks.where(F.col("block").between(low // _BLOCK_ROWS, (high - 1) // _BLOCK_ROWS)).coalesce(1)
        shared = here.hint("shuffle_replicate_nl").crossJoin(spark.range(0, groups, 1, groups).withColumnRenamed("id", "share"))
        for r in shared.mapInArrow(run, "id long, x array<double>, rejected array<long>").collect():  # one row a draw
            sums[r.id] = sums[r.id] + np.array(r.x)
            rejected.update(r.rejected)
    return sums, rejected


def _all_draw_sums(blocks: DataFrame, m: int, n: int, block: int, draws: int, rng: Rng) -> np.ndarray:
    """Sums of the resampled rows of ``draws`` draws whose starts follow one another in ``rng``.

    A start takes one word unless a word is rejected (once in 2^64 / n).  So draws begin where
    they do without rejections; those after a rejected word are made again from where they do.
    """
    per, known, done, sums = -(-n // block), set(), {}, {}
    while True:
        offsets, before, ordered = {}, 0, sorted(known)
        for i in range(draws):
            while before < len(ordered) and ordered[before] < i * per + before:
                before += 1
            offsets[i] = i * per + before
        again = {i: o for i, o in offsets.items() if done.get(i) != o}
        if not again:
            return np.array([sums[i] for i in range(draws)])
        found, rejected = _draw_sums(blocks, m, n, block, again, rng)
        sums |= found
        done |= again
        known |= rejected


def _spread_out(losses: DataFrame, names: list[str], order_by: str | None, rows: int, o: Options, ties: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Mean losses, means of the draws of all rounds, and (for hac) the long-run covariance, without gathering the table."""
    spark, m = losses.sparkSession, len(names)
    if order_by and losses.where(F.col(order_by).isNull()).limit(1).count():
        raise ValueError(f"rows without {order_by!r} have no place in the series")
    mean = np.array(losses.agg(*[F.avg(F.coalesce(F.col(x).cast("double"), F.lit(math.nan))) for x in names]).first(), float)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = f"{shared.rstrip('/') if shared else 'file://' + tempfile.mkdtemp(prefix='tessera-')}/tessera/mcs-{uuid.uuid4().hex}"
    try:
        _packed(losses, names, order_by, rows, ties).write.parquet(path)
        blocks = spark.read.schema("block long, x binary").parquet(path)
        sums = _all_draw_sums(blocks, m, rows, o.block, (m - 1) * o.draws, Rng(o.seed, o.stream))
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    longrun = _longrun(losses, names, order_by, rows, mean, o, ties) if o.variance == "hac" else None
    return mean, (sums / rows).reshape(m - 1, o.draws, m), longrun


def _longrun(losses: DataFrame, names: list[str], order_by: str | None, rows: int, mean: np.ndarray, o: Options, ties: Sequence[str]) -> np.ndarray:
    """Long-run covariance matrix of the losses, as ``_hac_of_mean`` weighs lags."""
    m, lags = len(names), list(range(1, o.lag(rows) + 1))
    t = F.col(order_by) if order_by else F.monotonically_increasing_id()
    c = losses.select(t.alias("__order"), *ties, *[(F.coalesce(F.col(x).cast("double"), F.lit(math.nan)) - F.lit(float(mean[i]))).alias(f"x{i}") for i, x in enumerate(names)])
    cells = [f"x{i}" for i in range(m)]
    pairs = lagged(c, cells, "__order", lags, ties=ties)
    named = [(k, i, j) for k in [0, *lags] for i in range(m) for j in range(m)]
    found = pairs.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}_lag{k}" if k else f"x{j}")).alias(f"s{at}") for at, (k, i, j) in enumerate(named)]).first()
    total = np.zeros((m, m))
    for (k, i, j), v in zip(named, found):
        total[i, j] += v / rows * (2 * hac_weight(o.kernel, k, o.lag(rows)) if k else 1)
    return total


def _contrasts(m: int, statistic: str) -> np.ndarray:
    """The matrix that ``differentials`` multiplies losses by."""
    return differentials(np.eye(m), statistic)[0]


def mcs(
    losses: DataFrame, options: Options = Options(), order_by: str | None = None, names: Sequence[str] | None = None, parallel: bool = True, ties: Sequence[str] = ()
) -> Result:
    """Model confidence set.  All rounds are run; the set is what stood at the first round with
    p >= alpha; a model's p-value is the greatest so far, and the last model's is 1.  Rows that
    are equal in ``order_by`` follow the columns ``ties``, which are no models."""
    names = list(names or [n for n in model_names(losses) if n != order_by and n not in ties])
    n, m = losses.count(), len(names)
    if m < 2 or n < 2 or not 1 <= options.block <= n:
        raise ValueError("a confidence set needs two models, two rows and a block within the rows")
    spread = parallel and options.variance != "hac_resample" and n * m > GATHERED_CELLS
    if spread:
        mean, means, longrun = _spread_out(losses, names, order_by, n, options, ties)
    else:
        x = _matrix(losses, names, order_by, n, ties)
        mean, rng, spark = x.mean(axis=0), Rng(options.seed, options.stream), losses.sparkSession if parallel else None
    alive, p_so_far, order, pvalue, kept = list(range(m)), 0.0, [], [1.0] * m, None
    while len(alive) > 1:
        if spread:
            d, pairs = differentials(mean[None, alive], options.statistic)
            stars = differentials(means[len(order)][:, alive], options.statistic)[0] - d
            if longrun is None:
                v = (stars * stars).mean(axis=0)
            else:
                a = _contrasts(len(alive), options.statistic)
                v = (a * (longrun[np.ix_(alive, alive)] @ a)).sum(axis=0) / n
            se = np.sqrt(np.maximum(v, _FLOOR))
            t, stars = d[0] / se, stars / se
        else:
            d, pairs = differentials(x[:, alive], options.statistic)
            t, stars, _ = _round(spark, d, _draw_states(rng, n, options.block, options.draws), options)
        observed = float(_reduce(t, options.statistic))
        p = float((_reduce(stars, options.statistic) > observed).mean())
        p_so_far = max(p_so_far, p)
        if kept is None and p >= options.alpha:
            kept = list(alive)
        out = alive.pop(worst_model(t, pairs, len(alive), options.statistic))
        order.append(out)
        pvalue[out] = p_so_far
    final = kept if kept is not None else list(alive)
    return Result(
        names, [float(v) for v in mean], pvalue, [i in final for i in range(m)], [names[i] for i in order if i not in final], kept is not None
    )


def in_set(frame: DataFrame) -> DataFrame:
    return frame.where("in_set")


def report(r: Result) -> str:
    """Text report of a confidence set."""
    width = max(5, *map(len, r.models))
    lines = [f"{'model':<{width}}  {'mean loss':>12}  {'p-value':>8}  in set"]
    for row in zip(r.models, r.mean_loss, r.pvalue, r.in_set):
        lines.append(f"{row[0]:<{width}}  {row[1]:>12.6g}  {row[2]:>8.4f}  {'yes' if row[3] else 'no'}")
    return "\n".join([*lines, f"converged: {'yes' if r.converged else 'no'}"]) + "\n"


def write_report(r: Result, o: Options, path: str) -> None:
    """Options and report in one text file."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(options_report(o) + report(r))


def options_report(o: Options) -> str:
    return "".join(f"{k}: {v}\n" for k, v in vars(o).items())


@dataclass(frozen=True)
class DieboldMariano:
    statistic: float
    pvalue: float
    mean_difference: float
    variance: float
    status: str  # OK, NEGATIVE_VARIANCE, ZERO_VARIANCE


def _dm(n: int, mean: float, longrun: float) -> DieboldMariano:
    if longrun < 0:
        return DieboldMariano(math.nan, 0.0, mean, longrun, "NEGATIVE_VARIANCE")
    se = math.sqrt(longrun / n)
    if se < 1e-14:
        return DieboldMariano(0.0, 1.0, mean, longrun, "ZERO_VARIANCE")
    s = mean / se
    return DieboldMariano(s, float(2 * special.norm_cdf(-abs(s))), mean, longrun, "OK")


def dm_test(losses: DataFrame, a: str, b: str, order_by: str, horizon: int = 1, kernel: str = "rectangular", ties: Sequence[str] = ()) -> DieboldMariano:
    """Diebold-Mariano test of equal losses: mean difference over its long-run standard error,
    with lags up to horizon - 1.  Two aggregations; only their one row reaches the driver."""
    from tessera.operators.stats import hac_variance

    d = losses.select(F.col(order_by).alias("t"), *[F.col(c).alias(f"tie{i}") for i, c in enumerate(ties)], (F.col(a).cast("double") - F.col(b).cast("double")).alias("d"))
    first = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean")).first()
    if not first.n or horizon > first.n:
        raise ValueError("too few rows for the horizon")
    v = hac_variance(d, "d", horizon - 1, "t", kernel, ties=[f"tie{i}" for i in range(len(ties))]).first().hac
    return _dm(first.n, first.mean, v)


def dm_report(r: DieboldMariano) -> str:
    return f"statistic: {r.statistic:.6g}\np-value: {r.pvalue:.6g}\nmean difference: {r.mean_difference:.6g}\nstatus: {r.status}\n"
