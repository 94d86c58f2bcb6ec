import math
import random

import pytest
from pyeval import value

from tessera.plans.lowering import sql, try_sql
from tessera.plans.sqltext import Expr, SqlDataError, SqlSyntaxError, parse

NAN = math.nan


@pytest.fixture(scope="module")
def panel(spark):
    rows = [("USA", 2019.0, 100.0, 10.0), ("USA", 2020.0, 90.0, 10.0), ("USA", 2021.0, 110.0, 10.0), ("FRA", 2019.0, 50.0, 5.0), ("FRA", 2020.0, 45.0, 5.0), ("FRA", 2021.0, 55.0, 5.0)]
    return spark.createDataFrame(rows, "country string, year double, gdp double, population double").cache()


def got(df):
    return [tuple(r) for r in df.collect()]


def test_selection_and_filters(panel):
    assert len(got(sql(panel, "SELECT * FROM df"))) == 6
    assert [r[1] for r in got(sql(panel, "SELECT country, gdp / population AS g FROM df WHERE year = 2019"))] == [10, 10]
    for text, n in {"gdp > 60": 3, "gdp > 60 AND year < 2021": 2, "NOT (gdp > 60)": 3, "gdp < 46 OR gdp > 105": 2, "country = 'FRA'": 3, "1 = 1": 6, "1 = 2": 0, "gdp": 6, "country != 'FRA'": 3}.items():
        assert len(got(sql(panel, f"SELECT country FROM df WHERE {text}"))) == n, text


def test_groups(panel):
    assert got(sql(panel, "SELECT country, SUM(gdp) AS t, AVG(gdp) AS a FROM df GROUP BY country ORDER BY country")) == [("FRA", 150, 50), ("USA", 300, 100)]
    assert got(sql(panel, "SELECT SUM(gdp) / SUM(population) AS r, SUM(gdp) / 100 AS h FROM df GROUP BY country ORDER BY h")) == [(10, 1.5), (10, 3)]
    assert got(sql(panel, "SELECT 42 AS answer FROM df")) == [(42,)] * 6
    assert got(sql(panel, "SELECT SUM(gdp > 60) AS n, COUNT(*) AS c FROM df")) == [(3, 6)]
    [(s, n, lo, a)] = got(sql(panel, "SELECT SUM(gdp) AS s, COUNT(*) AS n, MIN(gdp) AS lo, AVG(gdp) AS a FROM df WHERE gdp < 0"))
    assert (s, n) == (0, 0) and math.isnan(lo) and math.isnan(a)
    assert len(got(sql(panel, "SELECT gdp FROM df WHERE gdp > AVG(gdp)"))) == 3
    assert sql(panel, "SELECT gdp + 1, gdp * 2 FROM df").columns == ["expr", "expr"]


def test_nan_and_order(spark):
    df = spark.createDataFrame([(float(i), float(v)) for i, v in enumerate([8, 7, 1, 6, 5, 0, 9, NAN, 2, 3, 4])], "i double, x double")
    xs = [r[0] for r in got(sql(df, "SELECT x FROM t ORDER BY x"))]
    assert xs[:10] == list(range(10)) and math.isnan(xs[10])
    w = spark.createDataFrame([(1.0, 0.0), (NAN, 0.0), (3.0, 0.0), (NAN, 0.0)], "x double, c1 double")
    for text, n in {"x != 1": 3, "x = 1": 1, "x != c1": 4, "x = x": 2, "x > 0": 2, "x <= x": 2, "NOT (x > 0)": 2, "x": 4}.items():
        assert len(got(sql(w, f"SELECT x FROM t WHERE {text}"))) == n, text
    [(lo, hi)] = got(sql(w, "SELECT MIN(x) AS lo, MAX(x) AS hi FROM t"))
    assert math.isnan(lo) and math.isnan(hi)
    ties = spark.createDataFrame([(1.0, float(i)) for i in range(4)], "key double, tag double")
    assert [r[0] for r in got(sql(ties, "SELECT tag FROM t ORDER BY key", order_column="tag"))] == [0, 1, 2, 3]


SYNTAX = ["SELCT country FROM df", "SELECT country df", "SELECT country FROM df WHERE", "SELECT (country FROM df", "SELECT 'unterminated FROM df",
          "SELECT country FROM df WHERE gdp !5", "SELECT country FROM df GROUP", "SELECT country FROM df ORDER", "SELECT country FROM df EXTRA TOKENS", "", "SELECT a.b FROM t", "SELECT a FROM t; "]
DATA = ["SELECT nope FROM df", "SELECT country FROM df WHERE country > 5", "SELECT country FROM df WHERE country > 'ZZZ'", "SELECT year, SUM(gdp) AS s FROM df GROUP BY country",
        "SELECT SUM(AVG(gdp)) AS s FROM df", "SELECT * FROM df GROUP BY country", "SELECT country FROM df GROUP BY nope", "SELECT country FROM df ORDER BY nope",
        "SELECT * FROM df WHERE missing = 1", "SELECT -country FROM df", "SELECT Country FROM df", "SELECT SUM(country) AS s FROM df", "SELECT country FROM df WHERE country"]


@pytest.mark.parametrize("text", SYNTAX)
def test_syntax_errors(spark, panel, text):
    minimal = spark.range(1).select()
    a, b = try_sql(panel, text), try_sql(minimal, text)
    assert a.error == b.error == "SYNTAX" and a.message == b.message
    with pytest.raises(SqlSyntaxError):
        sql(panel, text)


@pytest.mark.parametrize("text", DATA)
def test_data_errors(panel, text):
    assert try_sql(panel, text).error == "DATA"
    with pytest.raises(SqlDataError):
        sql(panel, text)


def test_character_soup_never_crashes(panel):
    rnd = random.Random(5)
    for _ in range(400):
        text = "".join(rnd.choice(["SELECT ", "FROM t ", "WHERE ", "gdp ", "(", ")", ",", "*", "1.5 ", "'a' ", "AND ", "SUM(", "= ", "<", "-", "é", "GROUP BY ", "\n"]) for _ in range(rnd.randint(1, 12)))
        try:
            parse(text)
        except SqlSyntaxError:
            pass
    with pytest.raises(SqlSyntaxError):
        parse("SELECT " + "(" * 5000 + "1" + ")" * 5000 + " FROM t")


def _random(rnd, depth):
    if depth == 0 or rnd.random() < 0.2:
        return Expr("num", rnd.choice([0.0, 1.0, -2.5, 3.0])) if rnd.random() < 0.4 else Expr("col", rnd.choice(["x", "k"]))
    op = rnd.choice(["+", "-", "*", "/", "=", "!=", "<", "<=", ">", ">=", "AND", "OR", "NOT", "NEG"])
    if op in ("NOT", "NEG"):
        return Expr("not" if op == "NOT" else "neg", None, (_random(rnd, depth - 1),))
    return Expr("bin", op, (_random(rnd, depth - 1), _random(rnd, depth - 1)))


def _text(e):
    if e.kind in ("num", "col"):
        return f"{e.value}" if e.kind == "col" or e.value >= 0 else f"(-{-e.value})"
    if e.kind in ("not", "neg"):
        return f"({'NOT ' if e.kind == 'not' else '-'}({_text(e.args[0])}))"
    return f"({_text(e.args[0])} {e.value} {_text(e.args[1])})"


def test_fuzz_against_plain_python(spark):
    rows = [{"x": x, "k": k} for x in (0.0, -0.5, 1e6, NAN, math.inf, 1.0) for k in (-3.0, 0.0, 2.0, NAN, -math.inf)]
    df = spark.createDataFrame(rows, "x double, k double").coalesce(1).cache()
    rnd = random.Random(11)
    exprs = [_random(rnd, 3) for _ in range(60)]
    out = got(sql(df, "SELECT x, k, " + ", ".join(f"{_text(e)} AS e{i}" for i, e in enumerate(exprs)) + " FROM t"))
    for r in out:
        row = {"x": r[0], "k": r[1]}
        for e, v in zip(exprs, r[2:]):
            want = value(parse(f"SELECT {_text(e)} FROM t").items[0].expr, row)
            assert v == pytest.approx(want, nan_ok=True), (_text(e), row)


def test_pushdown(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(10).selectExpr("id", "cast(id as double) x", "'s' as s").write.parquet(path)
    plan = sql(spark.read.parquet(path), "SELECT id FROM t WHERE x > 3")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,3.0)" in plan and "ReadSchema: struct<id:bigint,x:double>" in plan
