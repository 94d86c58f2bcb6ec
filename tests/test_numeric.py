import math

import numpy as np
import pytest

from tessera.functions import autodiff as ad
from tessera.functions import distributions as d
from tessera.functions.rng import Rng
from tessera.functions.special import digamma, norm_cdf
from tessera.operators import forecast, linalg, models, ranges


def test_special():
    assert digamma([1, 0.5, 2, 10]) == pytest.approx([-0.5772157, -1.9635100, 0.4227843, 2.2517526], abs=1e-6)
    assert norm_cdf([0, 1, -6, -10]) == pytest.approx([0.5, 0.8413447, 9.865876450376946e-10, 7.619853024160525e-24], rel=1e-7)


def test_rng():
    a, b = Rng(42), Rng(42)
    first = [a.u64() for _ in range(5)]
    assert first == [b.u64() for _ in range(5)] and first != [Rng(42, 1).u64() for _ in range(5)] and first != [Rng(43).u64() for _ in range(5)]
    r = Rng(7)
    z = np.array([r.normal() for _ in range(20000)])
    g = np.array([r.gamma(0.7) for _ in range(20000)])
    assert abs(z.mean()) < 0.03 and abs(z.var() - 1) < 0.05 and abs(g.mean() - 0.7) < 0.03
    assert set(r.below(3) for _ in range(200)) == {0, 1, 2}


def _numeric(f, x, h=1e-6):
    x = np.array(x, float)
    out = np.zeros_like(x)
    for i in np.ndindex(x.shape):
        up, down = x.copy(), x.copy()
        up[i] += h
        down[i] -= h
        out[i] = (f(up) - f(down)) / (2 * h)
    return out


def test_distributions():
    assert d.gauss_logpdf(0.3, 0.1, 2.0) == pytest.approx(-0.5 * 0.01 - math.log(2) - 0.5 * math.log(2 * math.pi))
    assert d.student_logpdf([1.0, 1.0], 0, 2, [math.inf, 1e9])[0] == d.gauss_logpdf(1.0, 0, 2)
    for f, g in ((lambda v: d.student_logpdf(0.7, v[0], v[1], v[2]), lambda v: [d.student_dlogpdf_loc(0.7, *v), d.student_dlogpdf_scale(0.7, *v), d.student_dlogpdf_nu(0.7, *v)]),):
        v = np.array([0.2, 1.5, 4.0])
        assert np.array(g(v), float).ravel() == pytest.approx(_numeric(lambda q: float(f(q)), v), rel=1e-5)
    x, loc, cov = np.array([[0.5, -1], [1, 2.0]]), np.array([[0.1, 0.2]]), np.array([[2, 0.3], [0.3, 1.0]])
    assert d.mvgauss_dlogpdf_loc(x, loc, cov).sum(axis=0) == pytest.approx(_numeric(lambda q: d.mvgauss_logpdf(x, q, cov).sum(), loc).ravel(), rel=1e-5)
    assert d.mvstudent_logpdf(x, loc, cov, math.inf) == pytest.approx(d.mvgauss_logpdf(x, loc, cov))
    assert d.mvgauss_logpdf([[0.7]], [[0.1]], [[4.0]])[0] == pytest.approx(d.gauss_logpdf(0.7, 0.1, 2.0))
    diagonal = _numeric(lambda q: d.mvstudent_logpdf(x, loc, np.diag(q) + cov - np.diag(np.diag(cov)), 5).sum(), np.diag(cov))
    assert np.diag(d.mvstudent_dlogpdf_cov(x, loc, cov, 5)) == pytest.approx(diagonal, rel=1e-5)
    assert d.mvstudent_dlogpdf_nu(x, loc, cov, 5).sum() == pytest.approx(_numeric(lambda q: d.mvstudent_logpdf(x, loc, cov, q[0]).sum(), [5.0])[0], rel=1e-5)
    m, row, col = np.arange(6.0).reshape(2, 3), np.array([[2, 0.5], [0.5, 1]]), np.diag([1.0, 2, 3])
    kron = d.mvgauss_logpdf(m.T.reshape(1, -1), np.zeros((1, 6)), np.kron(col, row))[0]
    assert d.matgauss_logpdf(m, np.zeros((2, 3)), row, col) == pytest.approx(kron)
    assert d.matgauss_dlogpdf_loc(m, np.zeros((2, 3)), row, col) == pytest.approx(_numeric(lambda q: d.matgauss_logpdf(m, q, row, col), np.zeros((2, 3))), rel=1e-5)
    a, b = d.matgauss_dlogpdf_rowcov(m, np.zeros((2, 3)), row, col), d.matgauss_dlogpdf_colcov(m, np.zeros((2, 3)), row, col)
    assert (a * row).sum() == pytest.approx((b * col).sum())
    s = d.mvstudent_sample(Rng(1), [[1.0, 2.0]], cov, 30.0, 4000)
    assert s.mean(axis=0) == pytest.approx([1, 2], abs=0.12) and d.matgauss_sample(Rng(1), m, row, col).shape == (2, 3)


UNARY = {"exp": ad.exp, "tanh": ad.tanh, "identity": ad.identity, "swish": ad.swish, "log": ad.log, "lgamma": ad.lgamma_of, "pow": lambda a: ad.power(a, 3), "scale": lambda a: ad.scale(a, 2.5),
         "part": lambda a: ad.part(a, slice(0, 1), slice(0, 2)), "reshape": lambda a: ad.reshape(a, 1, 4), "inv": ad.inv, "det": ad.det}
BINARY = {"add": ad.add, "sub": ad.sub, "emul": ad.emul, "ediv": ad.ediv, "dot": ad.dot, "matmul": ad.matmul, "solve": ad.solve, "se": ad.squared_error, "mse": ad.mean_squared_error,
          "huber": lambda a, b: ad.huber_error(a, b, 0.5), "logcosh": ad.logcosh_error}
A, B = np.array([[1.5, 0.4], [0.4, 2.2]]), np.array([[0.3, 1.1], [1.9, 0.7]])


def _check(build, *values):
    tape = ad.Tape()
    leaves = [tape.leaf(v) for v in values]
    tape.backward(ad.total(build(*leaves)))
    for k, leaf in enumerate(leaves):
        def f(q, k=k):
            t = ad.Tape()
            return ad.total(build(*[t.leaf(q if j == k else v) for j, v in enumerate(values)])).value.item()

        assert leaf.grad == pytest.approx(_numeric(f, values[k]), rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("name", UNARY)
def test_unary_gradients(name):
    _check(UNARY[name], A)


@pytest.mark.parametrize("name", BINARY)
def test_binary_gradients(name):
    _check(BINARY[name], A, B)


def test_symmetric_gradients():
    _check(lambda s, a: ad.broadcast_mul(s, a), np.array([[2.0]]), A)
    b = np.array([[1.0], [2.0]])
    t = ad.Tape()
    a, v = t.leaf(A), t.leaf(b)
    t.backward(ad.chol_quadform(a, v))
    x = np.linalg.solve(A, b)
    assert a.grad == pytest.approx(-x @ x.T) and v.grad == pytest.approx(2 * x)
    t = ad.Tape()
    a, v = t.leaf(A), t.leaf(b)
    t.backward(ad.total(ad.chol_solve(a, v)))
    h = 1e-6 * np.array([[0, 1], [1, 0.0]])
    assert (a.grad * np.array([[0, 1], [1, 0]])).sum() == pytest.approx((np.linalg.solve(A + h, b).sum() - np.linalg.solve(A - h, b).sum()) / 2e-6, rel=1e-4)


def test_linear_algebra(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(5, 5))
    packed, pivots = linalg.lu(a)
    b = rng.normal(size=5)
    assert linalg.lu_solve((packed, pivots), b) == pytest.approx(np.linalg.solve(a, b)) and linalg.solve(a, b) == pytest.approx(np.linalg.solve(a, b))
    s = a @ a.T
    assert linalg.chol_solve(linalg.cholesky(s), b) == pytest.approx(np.linalg.solve(s, b)) and linalg.det(a) == pytest.approx(np.linalg.det(a))
    assert linalg.norm([[1, -2], [3, 4.0]], "1") == 6 and linalg.norm([[1, -2], [3, 4.0]], "I") == 7 and linalg.norm([[1, -2], [3, 4.0]], "M") == 4 and linalg.rank(np.ones((3, 3))) == 1
    for bad in (lambda: linalg.inv(np.ones((2, 2))), lambda: linalg.det(np.ones((2, 2))), lambda: linalg.cholesky(-np.eye(2))):
        with pytest.raises(linalg.SingularError):
            bad()
    assert linalg.integer_power([2.0, 0.0], 0).tolist() == [1, 1] and linalg.integer_power([2.0], 10)[0] == 1024
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2, 0.5] + 3
    df = spark.createDataFrame([tuple(map(float, (*r, v))) for r, v in zip(x, y)], "a double, b double, c double, y double").repartition(5)
    assert linalg.lstsq(df, ["a", "b", "c"], "y", True) == pytest.approx([3, 1, -2, 0.5]) and linalg.gram(df, ["a", "b", "c"]) == pytest.approx(x.T @ x)
    with pytest.raises(linalg.SingularError):
        linalg.lstsq(df.withColumn("d", df.a), ["a", "d"], "y")
    assert linalg.lstsq_min_norm(df.withColumn("d", df.a), ["a", "d"], "y")[1] == 1


def test_losses_and_dm(spark):
    df = spark.createDataFrame([(0, 2.0, 4.0, 1.0), (1, 5.0, 5.0, 10.0)], "t int, actual double, f1 double, f2 double")
    got = {k: [tuple(r) for r in forecast.loss(df, "actual", ["f1", "f2"], k, ["t"]).orderBy("t").collect()] for k in ("mse", "mae", "qlike")}
    assert got["mse"] == [(0, 4, 1), (1, 0, 25)] and got["mae"] == [(0, 2, 1), (1, 0, 5)]
    assert got["qlike"][0][1:] == pytest.approx((math.log(4) + 0.5, 2)) and got["qlike"][1][1:] == pytest.approx((math.log(5) + 1, math.log(10) + 0.5))
    ab = spark.createDataFrame([(i, float(i + 1), 1.0) for i in range(4)], "t int, a double, b double")
    assert forecast.dm_test(ab, "a", "b", "t").statistic == pytest.approx(1.5 / math.sqrt(0.3125))
    assert forecast.dm_test(ab, "a", "b", "t", 2).statistic == pytest.approx(1.5 / math.sqrt(0.46875)) and forecast.dm_test(ab, "a", "b", "t", 2, "bartlett").statistic == pytest.approx(2.4)
    zig = spark.createDataFrame([(i, 1.0 + (-1) ** i, 1.0) for i in range(64)], "t int, a double, b double")
    r = forecast.dm_test(zig, "a", "b", "t", 2)
    assert (r.status, r.pvalue) == ("NEGATIVE_VARIANCE", 0) and forecast.dm_test(zig, "a", "b", "t", 2, "bartlett").status == "OK" and "p-value" in forecast.dm_report(r)
    assert forecast.dm_test(ab, "a", "a", "t").status == "ZERO_VARIANCE"


@pytest.mark.parametrize("statistic", ["tmax", "tr"])
@pytest.mark.parametrize("variance", ["bootstrap", "hac", "hac_resample"])
def test_confidence_set(spark, statistic, variance):
    rng = np.random.default_rng(55)
    x = rng.normal(0, 0.3, (400, 4)) + [1, 1, 1.6, 2.4]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "t int, m0 double, m1 double, m2 double, m3 double")
    o = forecast.Options(draws=120, seed=55, statistic=statistic, variance=variance)
    r = forecast.mcs(df, o, "t", parallel=False)
    assert r.in_set == [True, True, False, False] and r.eliminated == ["m3", "m2"] and r.converged and max(r.pvalue) == 1
    if variance != "hac":
        assert forecast.mcs(df, o, "t").pvalue == r.pvalue
    assert [x.model for x in forecast.in_set(r.frame(spark)).collect()] == ["m0", "m1"] and "converged: yes" in forecast.report(r) and "alpha" in forecast.options_report(o)


def test_below_many():
    for n in (1, 3, 1000, (1 << 32) - 1):
        a, b = Rng(5), Rng(5)
        assert a.below_many(n, 50).tolist() == [b.below(n) for _ in range(50)] and a.u64() == b.u64()


def test_registered_confidence_set_takes_all_events(spark, tmp_path):
    from tessera.plans import catalogue

    g = np.random.default_rng(4)
    value, user = g.normal(0, 6, 2500) + np.where(np.arange(2500) < 2000, 0, 9), g.integers(0, 9, 2500)
    rows = [(i, float(v), int(u)) for i, (v, u) in enumerate(zip(value, user))]
    spark.createDataFrame(rows, "ts int, value double, user_id long").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    x, names = np.stack([value * value, abs(value * 3 - user), value * 0 + 40], axis=1), ["a", "b", "c"]
    rng, alive, p, so_far, kept = Rng(123), [0, 1, 2], [1.0] * 3, 0.0, None
    while len(alive) > 1:  # blocks of 10, 2000 draws, greatest t of own loss against the others' mean
        y = x[:, alive]
        d = np.stack([y[:, i] - np.delete(y, i, 1).mean(axis=1) for i in range(len(alive))], axis=1)
        stars = np.array([d[[s + k for s in [rng.below(2491) for _ in range(250)] for k in range(10)]].mean(axis=0) for _ in range(2000)]) - d.mean(axis=0)
        se = np.sqrt((stars**2).mean(axis=0))
        t = d.mean(axis=0) / se
        now = ((stars / se).max(axis=1) > t.max()).mean()
        so_far = max(so_far, now)
        kept = list(alive) if kept is None and now >= 0.05 else kept
        out = alive.pop(int(t.argmax()))
        p[out] = so_far
    got = {r.model: r for r in catalogue.queries()["mcs_set"](spark, str(tmp_path)).collect()}
    assert [got[n].mean_loss for n in names] == pytest.approx(x.mean(axis=0)) and [got[n].pvalue for n in names] == pytest.approx(p)
    assert [got[n].in_set for n in names] == [i in (kept or alive) for i in range(3)]


@pytest.mark.parametrize("block,statistic,variance", [(10, "tmax", "bootstrap"), (7, "tr", "bootstrap"), (7, "tmax", "hac"), (1, "tr", "hac")])
def test_confidence_set_without_gathering(spark, monkeypatch, block, statistic, variance):
    """A table above the cells that may be gathered stays on the executors, in several stretches, with the same result."""
    x = np.random.default_rng(8).normal(0, 1, (1000, 3)) + [1, 1.03, 1.08]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "t int, m0 double, m1 double, m2 double").repartition(5)
    o = forecast.Options(draws=150, block=block, statistic=statistic, variance=variance)
    want = forecast.mcs(df, o, "t", parallel=False)
    monkeypatch.setattr(forecast, "GATHERED_CELLS", 100)
    monkeypatch.setattr(forecast, "_TASK_CELLS", 1500)
    monkeypatch.setattr(forecast, "_BLOCK_ROWS", 64)
    monkeypatch.setattr(forecast, "_STARTS", 50)
    monkeypatch.setattr(forecast, "_matrix", None)  # would gather
    got = forecast.mcs(df, o, "t")
    assert got.mean_loss == pytest.approx(want.mean_loss) and got.pvalue == pytest.approx(want.pvalue, abs=1e-9) and 0 < min(want.pvalue) < 1
    assert (got.in_set, got.eliminated, got.converged) == (want.in_set, want.eliminated, want.converged)


def test_draws_after_rejected_words(spark, monkeypatch):
    """A rejected word moves all later draws by one word."""
    n, block, draws = 60, 4, 9  # 15 starts below 57 a draw
    rng = Rng(1)
    rng.state = (0x123456789ABCDEF << 64) | 0x123456789ABCDEF  # its word is 0, which is rejected
    rng.advance(-(4 * 15 + 6))
    again = Rng(1)
    again.state = rng.state
    starts, rejected, taken = again.below_told(57, draws * 15)
    assert rejected == [4 * 15 + 5] and taken == draws * 15 + 1
    slow = Rng(1)
    slow.state = rng.state
    assert starts.tolist() == [slow.below(57) for _ in range(draws * 15)] and slow.state == again.state
    x = np.random.default_rng(2).normal(size=(n, 2))
    blocks = spark.createDataFrame([(i, bytearray(x[i * 16 : i * 16 + 16].tobytes())) for i in range(4)], "block long, x binary")
    monkeypatch.setattr(forecast, "_BLOCK_ROWS", 16)
    monkeypatch.setattr(forecast, "_TASK_CELLS", 64)
    sums = forecast._all_draw_sums(blocks, 2, n, block, draws, rng)
    want = [x[(s[:, None] + np.arange(block)).ravel()].sum(axis=0) for s in starts.reshape(draws, 15)]
    assert sums == pytest.approx(np.array(want))


def test_models(spark, tmp_path):
    x, y = np.array([[-1, -1, 1, 1], [-1, 1, -1, 1.0]]), np.array([[-1, 1, 1, -1.0]])
    fit = models.fit(x, y, [2, 4, 1], "tanh", "tanh", epochs=400, optimizer=lambda: models.Adam(rate=0.05), seed=1)
    assert np.sign(fit.model.forecast(x)).ravel().tolist() == [-1, 1, 1, -1] and fit.losses[-1] < fit.losses[0]
    fit.model.save(path := str(tmp_path / "m.json"))
    again = models.MLP.load(path, "tanh", "tanh")
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x.T)], "i int, a double, b double")
    got = models.forecast_frame(df, again, ["a", "b"], ["y"], ["i"]).orderBy("i").collect()
    assert [r.y for r in got] == pytest.approx(fit.model.forecast(x).ravel())
    assert models.fit(x, y, [2, 2, 1], epochs=9, on_epoch=lambda e, loss: e == 2).stopped


@pytest.mark.parametrize("n", [1, 2, 7, 9, 101])
@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_ranges(spark, n, chunk):
    out = ranges.map_ranges(spark, lambda lo, x, shared: np.arange(lo, lo + x.shape[1])[None, :] * shared, n, 1, shared=2.0, chunk=chunk)
    assert sorted((r.id, r.out0) for r in out.collect()) == [(i, 2.0 * i) for i in range(n)]
    seen = []
    assert ranges.stream_ranges(out, lambda lo, m: seen.extend(range(lo, lo + m.shape[1]))) == n and sorted(seen) == list(range(n))
