import math

import numpy as np
import pytest

from tessera.operators import stats


def one(df):
    return df.first()[0]


@pytest.fixture(scope="module")
def series(spark):
    return lambda xs, ys=None: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys or xs))], "t int, x double, y double")


def test_moments(series):
    df = series([1, 2, 3, 4])
    assert (one(stats.mean(df, "x")), one(stats.variance(df, "x"))) == (2.5, 1.25)
    assert one(stats.autocorrelation(df, "x", 1, "t")) == pytest.approx(1) and one(stats.autocorrelation(df, "x", 2, "t")) == pytest.approx(1)
    assert one(stats.correlation(series([1, 2, 3], [1, 3, 2]), "x", "y")) == pytest.approx(0.5)
    assert one(stats.correlation(series([1, 2, 3], [-1, -2, -3]), "x", "y")) == pytest.approx(-1)
    assert one(stats.autocorrelation(series([1, -1] * 3), "x", 1, "t")) == pytest.approx(-1)
    with pytest.raises(Exception, match="constant"):
        one(stats.correlation(series([1, 1, 1], [1, 2, 3]), "x", "y"))


def test_autocovariance_and_hac(series):
    df = series([1, 3], [2, 6])
    cells = lambda lag: {(r.row, r.column): r.value for r in stats.autocovariance(df, ["x", "y"], lag, "t").collect()}
    assert cells(0) == {("x", "x"): 1, ("x", "y"): 2, ("y", "x"): 2, ("y", "y"): 4}
    assert cells(1) == {("x", "x"): -1, ("x", "y"): -2, ("y", "x"): -2, ("y", "y"): -4}
    df = series([1, 2, 3, 4])
    for lag, want in {0: 1.25, 1: 1.5625, 2: 1.4166667}.items():
        assert one(stats.hac_variance(df, "x", lag, "t")) == pytest.approx(want)
    for lag, want in {1: 1.875, 2: 1.125}.items():
        assert one(stats.hac_variance(df, "x", lag, "t", "rectangular")) == pytest.approx(want)


def test_lags_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(stats, "_CHUNK", 64)
    x = np.random.default_rng(1).normal(size=1000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t int, x double").repartition(7)
    got = sorted((r.x, r.x_lag1, r.x_lag3) for r in stats.lagged(df, ["x"], "t", [1, 3]).collect())
    want = sorted((x[i], x[i - 1] if i else None, x[i - 3] if i >= 3 else None) for i in range(1000))
    assert [tuple(map(repr, r)) for r in got] == [tuple(repr(float(v)) if v is not None else "None" for v in r) for r in want]
    c = x - x.mean()
    assert one(stats.hac_variance(df, "x", 3, "t")) == pytest.approx((c @ c + sum(2 * (1 - k / 4) * c[k:] @ c[:-k] for k in (1, 2, 3))) / 1000)


def test_ranks_and_medians(spark, series):
    assert one(stats.median(series([5, 1, 3, 2, 4]), "x")) == 3 and one(stats.median(series([5, 1, 3, 2]), "x")) == 2.5
    df = series([10, 20, 10, 30])
    assert [r["rank"] for r in stats.rank(df, "x").orderBy("t").collect()] == [1.5, 3, 1.5, 4]
    assert [r["rank"] for r in stats.rank(df, "x", by=["y"]).orderBy("t").collect()] == [1.5, 1, 1.5, 1]
    assert one(stats.spearman(series([1, 2, 3, 4, 5], [1, 8, 27, 64, 125]), "x", "y")) == pytest.approx(1)


def test_metrics(series):
    df = series([3, -0.5, 2, 7], [2.5, 0, 2, 8])
    for f, want in ((stats.mae, 0.5), (stats.mse, 0.375), (stats.rmse, math.sqrt(0.375)), (stats.medae, 0.5)):
        assert one(f(df, "x", "y")) == pytest.approx(want)
    assert one(stats.huber(df, "x", "y", 0.75)) == pytest.approx(0.1796875)
    assert one(stats.r2(series([1, 2, 3, 4]), "x", "y")) == 1 and one(stats.r2(series([1, 2, 3, 4], [2.5] * 4), "x", "y")) == 0
    assert one(stats.mape(series([100, 200], [110, 180]), "x", "y")) == pytest.approx(0.1)
    assert one(stats.rmsle(series([math.e, math.e**2], [1, 1]), "x", "y")) == pytest.approx(math.sqrt(2.5))
    for bad in (lambda: stats.mape(series([0, 1], [1, 1]), "x", "y"), lambda: stats.rmsle(series([-1, 1], [1, 1]), "x", "y"), lambda: stats.r2(series([1, 1]), "x", "y")):
        with pytest.raises(Exception, match="mape|rmsle|r2"):
            one(bad())


def test_lags_with_ties_do_not_depend_on_partitions(spark):
    rows = [(i // 7, float((i * 37) % 101)) for i in range(400)]
    df = spark.createDataFrame(rows, "t int, x double")
    found = {n: stats.autocorrelation(df.repartition(n), "x", 1, "t").first()[0] for n in (1, 3, 7)}
    assert max(found.values()) - min(found.values()) < 1e-12


def test_fine_buckets(spark, monkeypatch):
    monkeypatch.setattr(stats, "_BUCKET_ROWS", 1)
    values = [float("nan"), float("inf"), -float("inf"), 0.0, -0.0] + [(-1) ** i * (i % 97) ** 2 / 7 for i in range(900)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, i int").repartition(5)
    placed = [r.v for r in stats.positions(df, "v", "p", ["i"]).orderBy("p").collect()]
    want = sorted((v for v in values if v == v)) + [float("nan")]
    assert placed[:-1] == want[:-1] and placed[-1] != placed[-1] and len(placed) == len(values)
    finite = df.where("i >= 5")
    assert stats.median(finite, "v").first()[0] == sorted(values[5:])[449] / 2 + sorted(values[5:])[450] / 2
    assert stats.median(df.limit(0), "v").first()[0] is None
    ranks = {r.i: r["rank"] for r in stats.rank(finite, "v").collect()}
    assert all(abs(ranks[i] - (sum(u < v for u in values[5:]) + (sum(u == v for u in values[5:]) + 1) / 2)) < 1e-9 for i, v in enumerate(values) if i >= 5 and i % 50 == 0)


def test_registered_lags_keep_the_order_of_the_table_in_one_time(spark, tmp_path):
    """Events of one time follow their place in the files, as in DuckDB's sort of a table in the order of time."""
    import duckdb

    from tessera.plans import catalogue

    g = np.random.default_rng(6)
    rows = [(i // 3, float(v), int(u)) for i, (v, u) in enumerate(zip(g.normal(5, 3, 900), g.integers(0, 50, 900)))]
    spark.createDataFrame(rows, "ts int, value double, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    files = sorted(str(p) for p in (tmp_path / "events.parquet").glob("*.parquet"))
    assert len(files) > 1
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE TABLE events AS SELECT * FROM read_parquet({files})")
    assert [tuple(r) for r in con.sql("SELECT ts, value, user_id FROM events").fetchall()] == rows
    for name in ("stats_autocov", "stats_autocorr", "stats_hac", "dm_test"):
        got = [tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()]
        want = con.sql(catalogue.oracle_sql()[name]).fetchall()
        key = lambda r: [x for x in r if isinstance(x, str)]
        for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
            assert key(a) == key(b) and [x for x in a if not isinstance(x, str)] == pytest.approx([x for x in b if not isinstance(x, str)]), name
    x = np.array([r[1] for r in rows])
    x -= x.mean()
    assert {(r.row, r.column): r.value for r in catalogue.queries()["stats_autocov"](spark, str(tmp_path)).collect()}["value", "value"] == pytest.approx((x[2:] * x[:-2]).mean())


def test_autocovariance_leaves_out_pairs_with_a_null_only(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, None, 4.0), (2, 3.0, 9.0)], "t int, x double, y double")
    got = {(r.row, r.column): r.value for r in stats.autocovariance(df, ["x", "y"], 1, "t").collect()}
    assert got["x", "x"] is None and got["y", "y"] == pytest.approx(((2 - 5) * (4 - 5) + (4 - 5) * (9 - 5)) / 2)
    assert got["x", "y"] == pytest.approx((1 - 2) * (4 - 5)) and got["y", "x"] == pytest.approx((4 - 5) * (3 - 2))
