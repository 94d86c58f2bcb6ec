"""The registered queries of the reference surface and their oracle SQL.

Each entry is a function of (spark, sf_dir) and, where SQL can say the same, DuckDB SQL over
the driver's tables with the guards and defaults spelt out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ieee
from tessera.operators import forecast, linalg, stats
from tessera.operators.join import join
from tessera.plans.lowering import sql

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, build: Callable[[Callable[[str], DataFrame]], DataFrame], oracle: str | None = None) -> None:
    _queries[name] = lambda spark, sf_dir: build(lambda t: _table(spark, sf_dir, t))
    if oracle:
        _oracles[name] = oracle


def _sql(name: str, table: str, text: str, oracle: str | None = None) -> None:
    """A query of the dialect; its oracle is the same text unless another is given."""
    _add(name, lambda t: sql(t(table), text), oracle or text)


_sql(
    "sql_pricing_summary",
    "lineitem",
    "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, SUM(l_extendedprice * (1 - l_discount)) AS sum_disc_price,"
    " AVG(l_discount) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_quantity < 45 GROUP BY l_returnflag, l_linestatus"
    " ORDER BY l_returnflag, l_linestatus",
)
_sql("sql_filter_cmp", "lineitem", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 49")
_sql(
    "sql_filter_logic",
    "orders",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice > 300000 OR o_totalprice < 2000) AND NOT (o_custkey < 100)",
)
_sql("sql_filter_string", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority != '1-URGENT'")
_sql("sql_filter_arith", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * l_discount > 2 * l_quantity * 40")
_sql("sql_filter_const", "nation", "SELECT n_name FROM nation WHERE 1 = 1")
_sql("sql_filter_never", "nation", "SELECT n_name FROM nation WHERE 1 = 2")
_sql("sql_filter_number", "lineitem", "SELECT l_orderkey FROM lineitem WHERE l_tax", "SELECT l_orderkey FROM lineitem WHERE l_tax <> 0")
_sql(
    "sql_filter_agg",
    "orders",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > 1.5 * AVG(o_totalprice)",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > 1.5 * (SELECT AVG(o_totalprice) FROM orders)",
)
_sql(
    "sql_project_arith",
    "part",
    "SELECT p_partkey, p_retailprice * 2 - p_size / 4 AS x, -p_size AS neg FROM part",
    "SELECT p_partkey, p_retailprice * 2 - p_size / 4.0::DOUBLE AS x, -(p_size::DOUBLE) AS neg FROM part",
)
_sql("sql_literal", "part", "SELECT p_partkey, 42 AS answer, 'text' AS word FROM part", "SELECT p_partkey, 42.0::DOUBLE AS answer, 'text' AS word FROM part")
_sql("sql_bool_value", "part", "SELECT p_partkey, p_size > 25 AS big FROM part", "SELECT p_partkey, (p_size > 25)::DOUBLE AS big FROM part")
_sql("sql_star", "region", "SELECT * FROM region")
_sql(
    "sql_div_ieee",
    "lineitem",
    "SELECT l_orderkey, l_linenumber, l_quantity / l_tax AS q FROM lineitem",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 'inf'::DOUBLE ELSE l_quantity / l_tax END AS q FROM lineitem",
)
_sql("sql_count", "orders", "SELECT o_orderstatus, COUNT(*) AS n, COUNT(o_totalprice) AS m FROM orders GROUP BY o_orderstatus")
_sql(
    "sql_implicit_group",
    "orders",
    "SELECT SUM(o_totalprice) AS s, AVG(o_totalprice) AS a, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, COUNT(*) AS n FROM orders",
)
_sql(
    "sql_empty_group",
    "orders",
    "SELECT SUM(o_totalprice) AS s, COUNT(*) AS n FROM orders WHERE o_totalprice < 0",
    "SELECT COALESCE(SUM(o_totalprice), 0) AS s, COUNT(*) AS n FROM orders WHERE o_totalprice < 0",
)
_sql(
    "sql_agg_ratio",
    "lineitem",
    "SELECT l_shipdate, SUM(l_extendedprice) / SUM(l_quantity) AS unit FROM lineitem GROUP BY l_shipdate",
)
_sql("sql_agg_literal", "lineitem", "SELECT l_returnflag, SUM(l_quantity) / 100 AS s, 7 AS seven FROM lineitem GROUP BY l_returnflag",
     "SELECT l_returnflag, SUM(l_quantity) / 100 AS s, 7.0::DOUBLE AS seven FROM lineitem GROUP BY l_returnflag")
_sql(
    "sql_agg_bool",
    "lineitem",
    "SELECT l_returnflag, SUM(l_quantity > 25) AS big FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, SUM((l_quantity > 25)::DOUBLE) AS big FROM lineitem GROUP BY l_returnflag",
)
_sql(
    "sql_min_max",
    "lineitem",
    "SELECT l_suppkey, MIN(l_discount) AS lo, MAX(l_tax) AS hi FROM lineitem GROUP BY l_suppkey",
    "SELECT l_suppkey, MIN(l_discount) + 0.0::DOUBLE AS lo, MAX(l_tax) AS hi FROM lineitem GROUP BY l_suppkey",
)
_sql("sql_order_multi", "customer", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment DESC, c_acctbal")
_sql("sql_order_hidden", "customer", "SELECT c_name FROM customer ORDER BY c_acctbal DESC")
_sql("sql_order_alias", "customer", "SELECT c_custkey, c_acctbal * 2 AS twice FROM customer ORDER BY twice")
_sql("sql_case_names", "nation", "select n_name as Name, n_regionkey as region from NATION where n_regionkey = 1 order by n_name",
     'SELECT n_name AS "Name", n_regionkey AS region FROM nation WHERE n_regionkey = 1')

# --- joins: one side is filtered first, so that both have rows without a partner -------------


def _orders(t):
    return sql(t("orders"), "SELECT o_custkey AS custkey, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000")


def _customers(t):
    return sql(t("customer"), "SELECT c_custkey AS custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 2000")


_JOIN = """
WITH o AS (SELECT o_custkey AS custkey, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000),
c AS (SELECT c_custkey AS custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 2000) """
_NANS = "'NaN'::DOUBLE"
_add("join_inner", lambda t: join(_orders(t), _customers(t), "custkey"), _JOIN + "SELECT o.custkey, o_orderkey, o_totalprice, c_name, c_acctbal FROM o JOIN c USING (custkey)")
_add(
    "join_left",
    lambda t: join(_orders(t), _customers(t), "custkey", "left"),
    _JOIN + f"SELECT o.custkey, o_orderkey, o_totalprice, COALESCE(c_name, 'NA') AS c_name, COALESCE(c_acctbal, {_NANS}) AS c_acctbal FROM o LEFT JOIN c USING (custkey)",
)
_add(
    "join_full",
    lambda t: join(_orders(t), _customers(t), "custkey", "full"),
    _JOIN
    + f"""SELECT COALESCE(o.custkey, c.custkey) AS custkey, COALESCE(o_orderkey::DOUBLE, {_NANS}) AS o_orderkey, COALESCE(o_totalprice, {_NANS}) AS o_totalprice,
    COALESCE(c_name, 'NA') AS c_name, COALESCE(c_acctbal, {_NANS}) AS c_acctbal FROM o FULL JOIN c ON o.custkey = c.custkey""",
)
_add(
    "join_right_swap",
    lambda t: join(_customers(t), _orders(t), "custkey", "left"),
    _JOIN + f"SELECT c.custkey, c_name, c_acctbal, COALESCE(o_orderkey::DOUBLE, {_NANS}) AS o_orderkey, COALESCE(o_totalprice, {_NANS}) AS o_totalprice FROM c LEFT JOIN o USING (custkey)",
)
_add(
    "join_collision",
    lambda t: join(
        sql(t("lineitem"), "SELECT l_suppkey AS id, SUM(l_quantity) AS v FROM l GROUP BY l_suppkey"),
        sql(t("supplier"), "SELECT s_suppkey AS id, s_acctbal AS v FROM s"),
        "id",
    ),
    "SELECT id, a.v, b.v AS v_right FROM (SELECT l_suppkey AS id, SUM(l_quantity) AS v FROM lineitem GROUP BY 1) a JOIN (SELECT s_suppkey AS id, s_acctbal AS v FROM supplier) b USING (id)",
)
_add(
    "join_string_key",
    lambda t: join(
        sql(t("customer"), "SELECT c_mktsegment AS k, COUNT(*) AS n FROM c GROUP BY c_mktsegment"),
        sql(t("customer"), "SELECT c_mktsegment AS k, MAX(c_acctbal) AS m FROM c WHERE c_mktsegment != 'BUILDING' GROUP BY c_mktsegment"),
        "k",
        "left",
    ),
    f"""SELECT k, n, COALESCE(m, {_NANS}) AS m FROM (SELECT c_mktsegment AS k, COUNT(*) AS n FROM customer GROUP BY 1) a
    LEFT JOIN (SELECT c_mktsegment AS k, MAX(c_acctbal) AS m FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1) b USING (k)""",
)

# --- statistics ------------------------------------------------------------------------------

_add("stats_mean", lambda t: stats.mean(t("lineitem"), "l_quantity", ["l_returnflag"]), "SELECT l_returnflag, AVG(l_quantity) AS mean FROM lineitem GROUP BY 1")
_add("stats_var", lambda t: stats.variance(t("lineitem"), "l_extendedprice", ["l_returnflag"]), "SELECT l_returnflag, VAR_POP(l_extendedprice) AS var FROM lineitem GROUP BY 1")
_add("stats_column_means", lambda t: stats.column_means(t("lineitem"), ["l_quantity", "l_tax"]), "SELECT AVG(l_quantity) AS l_quantity, AVG(l_tax) AS l_tax FROM lineitem")
_add(
    "stats_corr",
    lambda t: stats.correlation(t("lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]),
    "SELECT l_returnflag, CORR(l_quantity, l_extendedprice) AS corr FROM lineitem GROUP BY 1",
)
_add("stats_median", lambda t: stats.median(t("part"), "p_retailprice", ["p_brand"]), "SELECT p_brand, MEDIAN(p_retailprice) AS median FROM part GROUP BY 1")
_RANKED = "RANK() OVER (ORDER BY {0}) + (COUNT(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"
_add("stats_rank", lambda t: stats.rank(t("part").select("p_partkey", "p_size"), "p_size"), f"SELECT p_partkey, p_size, {_RANKED.format('p_size')} AS rank FROM part")
_add(
    "stats_spearman",
    lambda t: stats.spearman(t("part"), "p_size", "p_retailprice"),
    f"SELECT CORR(a, b) AS spearman FROM (SELECT {_RANKED.format('p_size')} AS a, {_RANKED.format('p_retailprice')} AS b FROM part)",
)
_PLACE = ["file", "place"]


def _events(t):
    """Events and their place in the table, which events of one time follow: SQL's sort leaves them so in a table in the order of time."""
    return t("events").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))


_add(
    "stats_autocorr",
    lambda t: stats.autocorrelation(_events(t), "value", 1, "ts", ties=_PLACE),
    "SELECT CORR(v, w) AS autocorr FROM (SELECT value AS v, LAG(value, 1) OVER (ORDER BY ts) AS w FROM events) WHERE w IS NOT NULL",
)
_COV = "WITH m AS (SELECT AVG(value) AS a, AVG(user_id) AS b FROM events), e AS (SELECT value - a AS x, user_id - b AS y, ts FROM events, m), l AS (SELECT x, y, LAG(x, {0}) OVER (ORDER BY ts) AS lx, LAG(y, {0}) OVER (ORDER BY ts) AS ly FROM e)"
_CELLS = "SELECT 'value' AS \"row\", 'value' AS \"column\", AVG(lx * x) AS value FROM l UNION ALL SELECT 'value', 'user_id', AVG(lx * y) FROM l UNION ALL SELECT 'user_id', 'value', AVG(ly * x) FROM l UNION ALL SELECT 'user_id', 'user_id', AVG(ly * y) FROM l"
_add("stats_autocov", lambda t: stats.autocovariance(_events(t), ["value", "user_id"], 2, "ts", _PLACE), _COV.format(2) + _CELLS)
_add("stats_covariance", lambda t: stats.autocovariance(t("events"), ["value", "user_id"]), _COV.format(0) + _CELLS)
_add(
    "stats_hac",
    lambda t: stats.hac_variance(_events(t), "value", 2, "ts", ties=_PLACE),
    """WITH e AS (SELECT value - (SELECT AVG(value) FROM events) AS x, ts FROM events),
    l AS (SELECT x, LAG(x, 1) OVER (ORDER BY ts) AS a, LAG(x, 2) OVER (ORDER BY ts) AS b FROM e)
    SELECT (SUM(x * x) + 2 * (2.0 / 3) * SUM(x * a) + 2 * (1.0 / 3) * SUM(x * b)) / COUNT(*) AS hac FROM l""",
)

_A, _P = "l_extendedprice", "(l_quantity * 1500)"
_METRICS = {
    "mae": (stats.mae, f"AVG(ABS({_A} - {_P}))"),
    "mse": (stats.mse, f"AVG(({_A} - {_P}) * ({_A} - {_P}))"),
    "rmse": (stats.rmse, f"SQRT(AVG(({_A} - {_P}) * ({_A} - {_P})))"),
    "medae": (stats.medae, f"MEDIAN(ABS({_A} - {_P}))"),
    "mape": (stats.mape, f"AVG(ABS({_A} - {_P}) / ABS({_A}))"),
    "rmsle": (stats.rmsle, f"SQRT(AVG((LN({_A}) - LN({_P})) * (LN({_A}) - LN({_P}))))"),
    "r2": (stats.r2, f"1 - AVG(({_A} - {_P}) * ({_A} - {_P})) / VAR_POP({_A})"),
    "huber": (
        lambda df, a, p, by, name: stats.huber(df, a, p, 5000.0, by, name),
        f"AVG(CASE WHEN ABS({_A} - {_P}) <= 5000 THEN ({_A} - {_P}) * ({_A} - {_P}) / 2 ELSE 5000 * (ABS({_A} - {_P}) - 2500) END)",
    ),
}
for _name, (_function, _text) in _METRICS.items():
    _add(
        f"metrics_{_name}",
        lambda t, f=_function, n=_name: f(
            sql(t("lineitem"), "SELECT l_returnflag, l_extendedprice AS a, l_quantity * 1500 AS p FROM l"), "a", "p", by=["l_returnflag"], name=n
        ),
        f"SELECT l_returnflag, {_text} AS {_name} FROM lineitem GROUP BY 1",
    )

# --- forecast comparison: two forecasts of an order's price made from its key ----------------


def _forecasts(t):
    return t("orders").select(
        "o_orderkey", F.col("o_totalprice").alias("actual"), (F.col("o_totalprice") * 0.9 + 10).alias("f1"), (F.col("o_totalprice") * 0.8 + F.col("o_custkey")).alias("f2")
    )


_F = "WITH f AS (SELECT o_orderkey, o_totalprice AS actual, o_totalprice * 0.9 + 10 AS f1, o_totalprice * 0.8 + o_custkey AS f2 FROM orders)"
for _name, _text in {"mse": "(actual - {0}) * (actual - {0})", "mae": "ABS(actual - {0})", "qlike": "LN({0}) + actual / {0}"}.items():
    _add(
        f"mcs_loss_{_name}",
        lambda t, k=_name: forecast.loss(_forecasts(t), "actual", ["f1", "f2"], k, ["o_orderkey"]),
        f"{_F} SELECT o_orderkey, {_text.format('f1')} AS f1, {_text.format('f2')} AS f2 FROM f",
    )


def _event_losses(t):
    e = _events(t)
    return e.select("ts", *_PLACE, (F.col("value") * F.col("value")).alias("a"), F.abs(F.col("value") * 3 - F.col("user_id")).alias("b"), (F.col("value") * 0 + 40).alias("c"))


def _mcs(t):
    losses = _event_losses(t)
    return forecast.mcs(losses, order_by="ts", ties=_PLACE).frame(losses.sparkSession)


def _dm(t):
    losses = _event_losses(t)
    r = forecast.dm_test(losses, "a", "b", "ts", 2, "bartlett", _PLACE)
    return losses.sparkSession.createDataFrame([(r.statistic, r.mean_difference, r.status)], "statistic double, mean_difference double, status string")


_add("mcs_set", _mcs)
_add(
    "dm_test",
    _dm,
    """WITH d AS (SELECT value * value - ABS(value * 3 - user_id) AS d, ts FROM events), m AS (SELECT AVG(d) AS m, COUNT(*) AS n FROM d),
    l AS (SELECT d - m AS x, LAG(d - m, 1) OVER (ORDER BY ts) AS a FROM d, m)
    SELECT (SELECT m FROM m) / SQRT(((SUM(x * x) + 2 * 0.5 * SUM(x * a)) / COUNT(*)) / COUNT(*)) AS statistic, (SELECT m FROM m) AS mean_difference, 'OK' AS status FROM l""",
)

# --- matrices --------------------------------------------------------------------------------

_X = ["l_quantity", "l_discount", "l_tax"]
_add(
    "mat_elementwise",
    lambda t: t("part").select(
        "p_partkey",
        ieee.elementwise("exp", F.col("p_size") / 10).alias("e"),
        ieee.elementwise("log", F.col("p_size")).alias("l"),
        ieee.elementwise("sqrt", F.col("p_retailprice")).alias("s"),
        ieee.elementwise("tanh", F.col("p_size") / 50).alias("t"),
        ieee.elementwise("abs", F.col("p_size") - 25).alias("a"),
        ieee.power(F.col("p_size"), 3).alias("p"),
    ),
    "SELECT p_partkey, EXP(p_size / 10.0::DOUBLE) AS e, LN(p_size::DOUBLE) AS l, SQRT(p_retailprice) AS s, TANH(p_size / 50.0::DOUBLE) AS t, ABS(p_size - 25)::DOUBLE AS a, POW(p_size::DOUBLE, 3.0::DOUBLE) AS p FROM part",
)
_add(
    "mat_norms",
    lambda t: stats.matrix_norms(t("lineitem"), _X),
    """SELECT SQRT(SUM(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax)) AS frobenius,
    GREATEST(SUM(ABS(l_quantity)), SUM(ABS(l_discount)), SUM(ABS(l_tax))) AS one, MAX(ABS(l_quantity) + ABS(l_discount) + ABS(l_tax)) AS infinity,
    GREATEST(MAX(ABS(l_quantity)), MAX(ABS(l_discount)), MAX(ABS(l_tax))) AS largest FROM lineitem""",
)
_add(
    "mat_reductions",
    lambda t: stats.reductions(t("lineitem"), "l_extendedprice", ["l_linestatus"]),
    "SELECT l_linestatus, SUM(l_extendedprice) AS sum, AVG(l_extendedprice) AS mean, MAX(l_extendedprice) AS max, MIN(l_extendedprice) AS min FROM lineitem GROUP BY 1",
)
_add(
    "mat_mul",
    lambda t: linalg.multiply(t("lineitem"), _X, [[1, 2], [3, 4], [5, 6]], ["u", "v"], ["l_orderkey", "l_linenumber"]),
    "SELECT l_orderkey, l_linenumber, l_quantity + l_discount * 3 + l_tax * 5 AS u, l_quantity * 2 + l_discount * 4 + l_tax * 6 AS v FROM lineitem",
)


def _gram(t):
    df = t("lineitem")
    g = linalg.gram(df, _X)
    return df.sparkSession.createDataFrame([(a, b, float(g[i, j])) for i, a in enumerate(_X) for j, b in enumerate(_X)], "a string, b string, v double")


_add("mat_gram", _gram, " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, SUM({a} * {b}) AS v FROM lineitem" for a in _X for b in _X))


def _coefficients(df, x, names):
    return df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, x)], "term string, value double")


_add(
    "lstsq_normal",
    lambda t: _coefficients(t("lineitem"), linalg.lstsq(t("lineitem"), ["l_quantity"], "l_extendedprice", True), ["const", "l_quantity"]),
    "SELECT 'const' AS term, REGR_INTERCEPT(l_extendedprice, l_quantity) AS value FROM lineitem UNION ALL SELECT 'l_quantity', REGR_SLOPE(l_extendedprice, l_quantity) FROM lineitem",
)
_add(
    "lstsq_rd",
    lambda t: _coefficients(
        t("lineitem"), linalg.lstsq_min_norm(t("lineitem").withColumn("twin", F.col("l_quantity")), ["l_quantity", "twin"], "l_extendedprice")[0], ["l_quantity", "twin"]
    ),
    """SELECT 'l_quantity' AS term, SUM(l_quantity * l_extendedprice) / SUM(l_quantity * l_quantity) / 2 AS value FROM lineitem
    UNION ALL SELECT 'twin', SUM(l_quantity * l_extendedprice) / SUM(l_quantity * l_quantity) / 2 FROM lineitem""",
)


# Decompositions of the 2 x 2 Gram matrix of two columns, whose oracles have closed forms.
_G = """WITH g AS (SELECT SUM(l_quantity * l_quantity) / COUNT(*) AS a, SUM(l_quantity * l_tax) / COUNT(*) AS b, SUM(l_tax * l_tax) / COUNT(*) AS c FROM lineitem)"""
_EIG = "(a + c) / 2 {0} SQRT((a - c) * (a - c) / 4 + b * b)"


def _small(make: Callable, fields: list[str]):
    def build(t):
        df = t("lineitem")
        g = linalg.gram(df, ["l_quantity", "l_tax"]) / df.count()
        return df.sparkSession.createDataFrame([tuple(float(v) for v in make(g))], ", ".join(f"{f} double" for f in fields))

    return build


_add("mat_chol", _small(lambda g: linalg.cholesky(g)[[0, 1, 1], [0, 0, 1]], ["x", "y", "z"]), f"{_G} SELECT SQRT(a) AS x, b / SQRT(a) AS y, SQRT(c - b * b / a) AS z FROM g")
_add("mat_det_trace", _small(lambda g: (linalg.det(g), linalg.trace(g)), ["d", "t"]), f"{_G} SELECT a * c - b * b AS d, a + c AS t FROM g")
_add("mat_inv", _small(lambda g: linalg.inv(g)[[0, 0, 1], [0, 1, 1]], ["x", "y", "z"]), f"{_G} SELECT c / (a * c - b * b) AS x, -b / (a * c - b * b) AS y, a / (a * c - b * b) AS z FROM g")
_add("mat_eig_sym", _small(lambda g: linalg.eig_sym(g)[0], ["lo", "hi"]), f"{_G} SELECT (a * c - b * b) / ({_EIG.format('+')}) AS lo, {_EIG.format('+')} AS hi FROM g")
_add("mat_eig", _small(lambda g: sorted(linalg.eig(g)[0]), ["lo", "hi"]), f"{_G} SELECT (a * c - b * b) / ({_EIG.format('+')}) AS lo, {_EIG.format('+')} AS hi FROM g")
_add("mat_svd", _small(lambda g: linalg.svd(g)[1], ["hi", "lo"]), f"{_G} SELECT (a * c - b * b) / ({_EIG.format('+')}) AS lo, {_EIG.format('+')} AS hi FROM g")
_add("mat_solve", _small(lambda g: linalg.solve(g, [1.0, 2.0]), ["x", "y"]), f"{_G} SELECT (c - 2 * b) / (a * c - b * b) AS x, (2 * a - b) / (a * c - b * b) AS y FROM g")
_add("mat_lu", _small(lambda g: linalg.lu(g)[0].ravel(), ["p", "q", "r", "s"]), f"{_G} SELECT a AS p, b AS q, b / a AS r, c - b * b / a AS s FROM g")
_add("mat_dot", lambda t: linalg.dot(t("lineitem"), "l_quantity", "l_tax"), "SELECT SUM(l_quantity * l_tax) AS dot FROM lineitem")
_add("mat_vector_norm", lambda t: linalg.vector_norm(t("lineitem"), "l_extendedprice"), "SELECT SQRT(SUM(l_extendedprice * l_extendedprice)) AS norm FROM lineitem")
_add("mat_vcat", lambda t: linalg.vcat(t("region"), t("region")), "SELECT * FROM region UNION ALL SELECT * FROM region")
_add("mat_hcat", lambda t: linalg.hcat(t("part").select("p_partkey", "p_size"), t("part").select("p_partkey", "p_retailprice"), "p_partkey"), "SELECT p_partkey, p_size, p_retailprice FROM part")


def _tall_svd(t):
    df = t("lineitem")
    s, _ = linalg.tall_svd(df, ["l_quantity", "l_tax"])
    return df.sparkSession.createDataFrame([(float(s[0] ** 2 / df.count()),)], "hi double")


_add("mat_tall_svd", _tall_svd, f"{_G} SELECT {_EIG.format('+')} AS hi FROM g")


def queries() -> dict[str, Query]:
    from tessera.plans import catalogue_extra, catalogue_more

    return _queries | catalogue_more.queries() | catalogue_extra.queries()


def oracle_sql() -> dict[str, str]:
    from tessera.plans import catalogue_extra, catalogue_more

    return _oracles | catalogue_more.oracle_sql() | catalogue_extra.oracle_sql()
