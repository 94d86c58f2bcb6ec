"""Queries over frames, small matrices, densities, gradients and models, with closed-form oracles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import autodiff as ad
from tessera.functions import distributions, ieee, special
from tessera.functions.rng import Rng
from tessera.operators import forecast, frame, linalg, models, ranges

_queries: dict = {}
_oracles: dict[str, str] = {}


def _add(name: str, build, sql: str | None = None) -> None:
    def query(spark, sf_dir: str) -> DataFrame:
        return build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    _queries[name] = query
    if sql:
        _oracles[name] = sql


def _rows(t, rows, schema: str) -> DataFrame:
    return t("region").sparkSession.createDataFrame(rows, schema)


# --- frames ----------------------------------------------------------------------------------


def _new_frame(t):
    df = frame.empty(t("region").sparkSession, 3).select(F.monotonically_increasing_id().alias("i"))
    df = frame.add_column(frame.add_column(df, "x", [1.0, 2.5, -3.0], "i"), "s", ["a", "b", ""], "i")
    return df.select("x", "s")


_add("frame_new", _new_frame, "SELECT x::DOUBLE AS x, s FROM (VALUES (1.0, 'a'), (2.5, 'b'), (-3.0, '')) t(x, s)")
_add(
    "frame_row_names",
    lambda t: frame.set_row_names(t("region").select("r_regionkey"), F.concat(F.lit("row"), F.col("r_regionkey"))).toDF("r_regionkey", "name"),
    "SELECT r_regionkey, 'row' || r_regionkey AS name FROM region",
)
_add("frame_numeric", lambda t: frame.numeric(t("part"), "p_retailprice"), "SELECT p_retailprice FROM part")
_add("frame_string", lambda t: frame.string(t("part"), "p_brand"), "SELECT p_brand FROM part")
_add(
    "frame_types",
    lambda t: _rows(t, [(c, frame.column_type(t("nation"), c)) for c in t("nation").columns], "name string, kind string"),
    "SELECT * FROM (VALUES ('n_nationkey', 'NUM'), ('n_name', 'STR'), ('n_regionkey', 'NUM')) t(name, kind)",
)
_add("model_names", lambda t: _rows(t, [(n,) for n in forecast.model_names(t("supplier").select("s_suppkey", "s_acctbal"))], "name string"), "SELECT * FROM (VALUES ('s_suppkey'), ('s_acctbal')) t(name)")
_add(
    "predicates",
    lambda t: t("lineitem").select("l_orderkey", "l_linenumber", ieee.is_inf(ieee.divide(F.col("l_quantity"), F.col("l_tax"))).alias("inf"), F.isnan(ieee.divide(F.col("l_tax"), F.col("l_tax"))).alias("nan")),
    "SELECT l_orderkey, l_linenumber, l_tax = 0 AS inf, l_tax = 0 AS nan FROM lineitem",
)

# --- matrices --------------------------------------------------------------------------------

_G = """WITH g AS (SELECT SUM(l_quantity * l_quantity) / COUNT(*) AS a, SUM(l_quantity * l_tax) / COUNT(*) AS b, SUM(l_tax * l_tax) / COUNT(*) AS c FROM lineitem)"""


def _small(make, fields: list[str]):
    def build(t):
        df = t("lineitem")
        g = linalg.gram(df, ["l_quantity", "l_tax"]) / df.count()
        return _rows(t, [tuple(float(v) for v in make(g))], ", ".join(f"{f} double" for f in fields))

    return build


def _solutions(name: str, make) -> None:
    _add(name, _small(lambda g: np.ravel(make(g, [1.0, 2.0])), ["x", "y"]), f"{_G} SELECT (c - 2 * b) / (a * c - b * b) AS x, (2 * a - b) / (a * c - b * b) AS y FROM g")


_add("mat_qr", _small(lambda g: np.abs(np.diag(linalg.qr(g)[1])), ["p", "q"]), f"{_G} SELECT SQRT(a * a + b * b) AS p, ABS(a * c - b * b) / SQRT(a * a + b * b) AS q FROM g")
_add("mat_rank", _small(lambda g: (linalg.rank(g), linalg.rank([[1, 2], [2, 4]])), ["full", "poor"]), "SELECT 2.0::DOUBLE AS full, 1.0::DOUBLE AS poor")
_add(
    "mat_cond",
    _small(lambda g: (linalg.cond(g),), ["k"]),
    f"{_G} SELECT ((a + c) / 2 + SQRT((a - c) * (a - c) / 4 + b * b)) * ((a + c) / 2 + SQRT((a - c) * (a - c) / 4 + b * b)) / (a * c - b * b) AS k FROM g",
)
_solutions("vec_solve_sym", linalg.solve_symmetric)
_solutions("vec_lu_solve", lambda g, b: linalg.lu_solve(linalg.lu(g), b))
_solutions("vec_chol_solve", lambda g, b: linalg.chol_solve(linalg.cholesky(g), b))
_add("vec_triangular_solve", _small(lambda g: linalg.triangular_solve(g, [1.0, 2.0]), ["x", "y"]), f"{_G} SELECT 1 / a AS x, (2 - b / a) / c AS y FROM g")
_add("mat_transpose", _small(lambda g: linalg.transpose([[g[0, 0], 2.0], [3.0, 4.0]]).ravel(), ["p", "q", "r", "s"]), f"{_G} SELECT a AS p, 3.0::DOUBLE AS q, 2.0::DOUBLE AS r, 4.0::DOUBLE AS s FROM g")
_add("mat_integer_power", _small(lambda g: linalg.integer_power(g, 2)[[0, 0, 1], [0, 1, 1]], ["x", "y", "z"]), f"{_G} SELECT a * a AS x, b * b AS y, c * c AS z FROM g")
_add(
    "mat_eig_complex",
    _small(lambda g: (abs(linalg.eig([[0.0, -g[0, 0]], [g[0, 0], 0.0]])[1][0]), linalg.eig([[0.0, -g[0, 0]], [g[0, 0], 0.0]])[0][0]), ["im", "re"]),
    f"{_G} SELECT a AS im, 0.0::DOUBLE AS re FROM g",
)
_add(
    "mat_lu_pivot",
    _small(lambda g: linalg.lu([[g[0, 1], 1.0], [g[0, 0], 2.0]])[0].ravel(), ["p", "q", "r", "s"]),
    f"{_G} SELECT a AS p, 2.0::DOUBLE AS q, b / a AS r, 1 - 2 * b / a AS s FROM g",
)


def _part(t, price: str):
    return t("part").select("p_partkey", F.col("p_size").alias("x"), F.col(price).alias("y"))


for _name, _sign in {"add": "+", "sub": "-", "emul": "*", "ediv": "/"}.items():
    _add(
        f"mat_{_name}",
        lambda t, k=_name: linalg.combine(_part(t, "p_retailprice"), _part(t, "p_size"), "p_partkey", ["x", "y"], k),
        f"SELECT p_partkey, p_size::DOUBLE {_sign} p_size AS x, p_retailprice {_sign} p_size AS y FROM part",
    )
_add("mat_scale", lambda t: linalg.scale(t("part"), ["p_size", "p_retailprice"], 2.5, ["p_partkey"]), "SELECT p_partkey, p_size * 2.5::DOUBLE AS p_size, p_retailprice * 2.5::DOUBLE AS p_retailprice FROM part")
_add(
    "mat_slice",
    lambda t: linalg.slice_rows(t("part").select("p_partkey", "p_size"), "p_partkey", 10, 200),
    "SELECT p_partkey, p_size FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY p_partkey) - 1 AS i FROM part) WHERE i >= 10 AND i < 200",
)
_add(
    "mat_reshape",
    lambda t: linalg.reshape(t("part"), "p_partkey", ["p_size", "p_retailprice"], 4),
    """WITH c AS (SELECT 2 * (ROW_NUMBER() OVER (ORDER BY p_partkey) - 1) AS i, p_size::DOUBLE AS v FROM part UNION ALL SELECT 2 * (ROW_NUMBER() OVER (ORDER BY p_partkey) - 1) + 1, p_retailprice FROM part)
    SELECT i // 4 AS "row", MAX(CASE WHEN i % 4 = 0 THEN v END) AS col0, MAX(CASE WHEN i % 4 = 1 THEN v END) AS col1, MAX(CASE WHEN i % 4 = 2 THEN v END) AS col2, MAX(CASE WHEN i % 4 = 3 THEN v END) AS col3 FROM c GROUP BY 1""",
)
_add(
    "mat_mul_tall",
    lambda t: linalg.multiply_cells(
        t("lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("v")),
        t("part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("j"), F.col("p_retailprice").alias("v")),
    ),
    "SELECT l_suppkey AS i, p_size AS j, SUM(l_quantity * p_retailprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
)

# --- densities, special functions, random numbers ----------------------------------------------

_DET = "(200 * 0.01::DOUBLE - 0.1::DOUBLE * 0.1)"
_Q = f"((0.01::DOUBLE * x * x - 0.2::DOUBLE * x * y + 200 * y * y) / {_DET})"
_XY = "(SELECT l_orderkey, l_linenumber, l_quantity - 25 AS x, l_discount - 0.05::DOUBLE AS y FROM lineitem)"


def _mv(t, nu: float) -> DataFrame:
    return distributions.mv_logpdf(t("lineitem"), ["l_quantity", "l_discount"], [[25.0, 0.05]], [[200.0, 0.1], [0.1, 0.01]], nu, keep=["l_orderkey", "l_linenumber"])


_add("mvstudent_logpdf", lambda t: _mv(t, 5.0), f"SELECT l_orderkey, l_linenumber, LGAMMA(3.5::DOUBLE) - LGAMMA(2.5::DOUBLE) - LN(5 * PI()) - 0.5 * LN({_DET}) - 3.5 * LN(1 + {_Q} / 5) AS logpdf FROM {_XY}")
_add(
    "special_digamma",
    lambda t: t("part").select("p_partkey", special.digamma_column(F.col("p_size")).alias("psi")),
    "SELECT p_partkey, COALESCE(list_sum(list_transform(range(1, p_size), lambda k: 1.0::DOUBLE / k)), 0) - 0.57721566490153286::DOUBLE AS psi FROM part",
)
#: The distribution function as a series of positive terms.
_PHI = """0.5 + SIGN({0}) * EXP(-{0} * {0} / 2) / SQRT(2 * PI()) * CASE WHEN {0} = 0 THEN 0 ELSE
  list_sum(list_transform(range(0, 80), lambda k: EXP((2 * k + 1) * LN(GREATEST(ABS({0}), 1e-300)) - LGAMMA((2 * k + 2)::DOUBLE) + k * LN(2.0::DOUBLE) + LGAMMA((k + 1)::DOUBLE)))) END"""
_add(
    "special_norm_cdf",
    lambda t: t("part").select("p_partkey", special.norm_cdf_column((F.col("p_size") - 25) / 10).alias("phi")),
    f"SELECT p_partkey, {_PHI.format('z')} AS phi FROM (SELECT p_partkey, (p_size - 25) / 10.0::DOUBLE AS z FROM part)",
)


def _matgauss(t):
    r = t("lineitem").agg(F.avg("l_quantity"), F.avg("l_tax"), F.avg("l_discount")).first()
    x = [[float(r[0]), float(r[1])], [float(r[2]), 1.0]]
    return _rows(t, [(distributions.matgauss_logpdf(x, [[20.0, 0.0], [0.0, 0.0]], [[2.0, 0.0], [0.0, 3.0]], [[1.0, 0.0], [0.0, 4.0]]),)], "logpdf double")


_add(
    "matgauss_logpdf",
    _matgauss,
    """WITH a AS (SELECT AVG(l_quantity) - 20 AS p, AVG(l_tax) AS q, AVG(l_discount) AS r FROM lineitem)
    SELECT -0.5 * (p * p / 2 + q * q / 8 + r * r / 3 + 1.0 / 12 + LN(2.0::DOUBLE) + LN(8.0::DOUBLE) + LN(3.0::DOUBLE) + LN(12.0::DOUBLE) + 4 * LN(2 * PI())) AS logpdf FROM a""",
)


def _rng(t):
    """Equal seeds and streams agree, others do not, and moments are near those of the distributions."""
    take = lambda seed, stream: [Rng(seed, stream).u64()] + [Rng(seed, stream).below(10)]
    a, n = Rng(42, 0), 20_000
    uniform, normal, gamma = ([f() for _ in range(n)] for f in (a.uniform, a.normal, lambda: a.gamma(3.0)))
    near = lambda x, mean, var: abs(np.mean(x) - mean) < 0.05 and abs(np.var(x) - var) < 0.15
    rows = [("same", take(42, 0) == take(42, 0)), ("stream", take(42, 0) != take(42, 1)), ("seed", take(42, 0) != take(43, 0))]
    rows += [("uniform", near(uniform, 0.5, 1 / 12) and 0 <= min(uniform) and max(uniform) < 1), ("normal", near(normal, 0.0, 1.0)), ("gamma", near(gamma, 3.0, 3.0))]
    return _rows(t, [(k, bool(v)) for k, v in rows], "property string, holds boolean")


_add("rng_streams", _rng, "SELECT *, TRUE AS holds FROM (VALUES ('same'), ('stream'), ('seed'), ('uniform'), ('normal'), ('gamma')) t(property)")

# --- gradients, optimiser, network -------------------------------------------------------------


def _gradients(t, build):
    """Gradient of a scalar by the balance of each supplier (a bounded table)."""
    rows = t("supplier").select("s_suppkey", (F.col("s_acctbal") / 5000).alias("x")).orderBy("s_suppkey").collect()
    tape = ad.Tape()
    x = tape.leaf([[r.x] for r in rows])
    tape.backward(build(tape, x))
    return _rows(t, [(r.s_suppkey, float(g)) for r, g in zip(rows, x.grad[:, 0])], "s_suppkey long, gradient double")


def _target(tape, x):
    return tape.leaf(np.full(x.shape, 0.25))


_S = "(SELECT s_suppkey, s_acctbal / 5000 AS x FROM supplier)"
for _name, (_build, _text) in {
    "tanh": (lambda tape, x: ad.total(ad.tanh(ad.scale(x, 2.0))), "2 * (1 - TANH(2 * x) * TANH(2 * x))"),
    "exp": (lambda tape, x: ad.total(ad.emul(x, ad.exp(x))), "(1 + x) * EXP(x)"),
    "power": (lambda tape, x: ad.total(ad.power(x, 3.0)), "3 * x * x"),
    "swish": (lambda tape, x: ad.total(ad.swish(x)), "1 / (1 + EXP(-x)) + x * EXP(-x) / ((1 + EXP(-x)) * (1 + EXP(-x)))"),
    "squared": (lambda tape, x: ad.squared_error(x, _target(tape, x)), "2 * (x - 0.25::DOUBLE)"),
    "huber": (lambda tape, x: ad.huber_error(x, _target(tape, x), 0.5), "GREATEST(-0.5::DOUBLE, LEAST(0.5::DOUBLE, x - 0.25::DOUBLE))"),
    "logcosh": (lambda tape, x: ad.logcosh_error(x, _target(tape, x)), "TANH(x - 0.25::DOUBLE)"),
    "matmul": (lambda tape, x: ad.total(ad.matmul(tape.leaf(np.full((3, x.shape[0]), 2.0)), x)), "6.0::DOUBLE"),
    "dot": (lambda tape, x: ad.dot(x, x), "2 * x"),
    "reshape": (lambda tape, x: ad.total(ad.power(ad.reshape(x, 1, x.shape[0]), 2.0)), "2 * x"),
}.items():
    _add(f"ad_{_name}", lambda t, f=_build: _gradients(t, f), f"SELECT s_suppkey, {_text} AS gradient FROM {_S}")


def _matrix_gradient(build):
    def make(g):
        tape = ad.Tape()
        a = tape.leaf(g)
        tape.backward(build(tape, a))
        return a.grad.ravel()

    return _small(make, ["p", "q", "r", "s"])


_add("ad_det", _matrix_gradient(lambda tape, a: ad.det(a)), f"{_G} SELECT c AS p, -b AS q, -b AS r, a AS s FROM g")
_add(
    "ad_quadform",
    _matrix_gradient(lambda tape, a: ad.chol_quadform(a, tape.leaf([[1.0], [2.0]]))),
    f"{_G}, x AS (SELECT (c - 2 * b) / (a * c - b * b) AS u, (2 * a - b) / (a * c - b * b) AS v FROM g) SELECT -u * u AS p, -u * v AS q, -u * v AS r, -v * v AS s FROM x",
)


def _adam(t):
    rows = t("supplier").select("s_suppkey", (F.col("s_acctbal") / 5000).alias("x")).orderBy("s_suppkey").collect()
    x, step = np.array([r.x for r in rows]), models.Adam(rate=0.1)
    for _ in range(2):
        step.step(x, np.array([r.x for r in rows]) + 0.5)
    return _rows(t, [(r.s_suppkey, float(v)) for r, v in zip(rows, x)], "s_suppkey long, x double")


# A constant gradient g gives bias-corrected moments g and g * g, so every step is rate * g / (|g| + epsilon).
_add("adam_steps", _adam, f"SELECT s_suppkey, x - 0.2::DOUBLE * (x + 0.5::DOUBLE) / (ABS(x + 0.5::DOUBLE) + 1e-8::DOUBLE) AS x FROM {_S}")


def _network(t):
    model = models.MLP.from_json('{"sizes":[2,2,1],"layers":[{"W":[[1,-2],[0.5,0.25]],"b":[0.1,-0.1]},{"W":[[2,-1]],"b":[0.3]}]}')
    model = models.MLP.from_json(model.to_json())
    c = t("customer").select("c_custkey", (F.col("c_acctbal") / 10000).alias("a"), (F.col("c_nationkey") / 25).alias("b"))
    return models.forecast_frame(c, model, ["a", "b"], ["y"], ["c_custkey"])


_add(
    "mlp_forward",
    _network,
    """SELECT c_custkey, 2 * TANH(a - 2 * b + 0.1::DOUBLE) - TANH(0.5::DOUBLE * a + 0.25::DOUBLE * b - 0.1::DOUBLE) + 0.3::DOUBLE AS y
    FROM (SELECT c_custkey, c_acctbal / 10000 AS a, c_nationkey / 25.0::DOUBLE AS b FROM customer)""",
)


def _stream(t):
    """Results of a range map, handed over in order of their ranges."""
    seen: list[tuple[int, float, int]] = []
    spark = t("region").sparkSession
    out = ranges.map_ranges(spark, lambda lo, x, shared: np.arange(lo, lo + x.shape[1], dtype=float)[None, :] * 2, 1000, 1)
    n = ranges.stream_ranges(out, lambda first, block: seen.append((first, float(block.sum()), block.shape[1])))
    return _rows(t, [(n, sum(s[1] for s in seen), sum(s[2] for s in seen))], "n long, total double, seen long")


_add("cluster_stream", _stream, "SELECT 1000::BIGINT AS n, 999000.0::DOUBLE AS total, 1000::BIGINT AS seen")


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
