"""Queries over distributions, models, sources, streams and the range map."""

from __future__ import annotations

import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import distributions, special
from tessera.functions.rng import Rng
from tessera.operators import models, ranges
from tessera.plans.lowering import sql
from tessera.sources import jsonio, npy, text
from tessera.streaming import queries as streams


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/tessera/{uuid.uuid4().hex}" if shared else f"file://{tempfile.mkdtemp(prefix='tessera-')}/x"


def gauss_logpdf(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    x = F.col("c_acctbal")
    by_loc, by_scale = distributions.gauss_score_columns(x, 4500.0, 3000.0)
    return c.select("c_custkey", distributions.gauss_logpdf_column(x, 4500.0, 3000.0).alias("logpdf"), by_loc.alias("by_loc"), by_scale.alias("by_scale"))


def student_logpdf(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    return c.select("c_custkey", distributions.student_logpdf_column(F.col("c_acctbal"), 4500.0, 3000.0, 3.0).alias("logpdf"))


def mvgauss_logpdf(spark, sf_dir):
    c = _table(spark, sf_dir, "lineitem")
    return distributions.mv_logpdf(c, ["l_quantity", "l_discount"], [[25.0, 0.05]], [[200.0, 0.1], [0.1, 0.01]], keep=["l_orderkey", "l_linenumber"])


def special_functions(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    return p.select("p_partkey", special.digamma_column(F.col("p_size") + 1).alias("psi"), special.norm_cdf_column((F.col("p_size") - 25) / 10).alias("phi"))


def cluster_map(spark, sf_dir):
    def task(lo: int, x: np.ndarray, shared) -> np.ndarray:
        return np.stack([x[0] * x[0] + shared, np.arange(lo, lo + x.shape[1], dtype=float)])

    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return ranges.map_ranges(spark, task, p.count(), 2, p, ["p_size"], shared=1.0)


def csv_roundtrip(spark, sf_dir):
    path = _folder(spark)
    text.write_csv(_table(spark, sf_dir, "nation"), path)
    return text.read_csv(spark, path)


def txt_roundtrip(spark, sf_dir):
    path = _folder(spark)
    text.write_txt(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_tax"), path)
    return text.read_txt(spark, path).toDF("l_orderkey", "l_quantity", "l_tax")


def npy_roundtrip(spark, sf_dir):
    path = _folder(spark)
    local = path.removeprefix("file://")  # the format is one local file, written by the driver
    os.makedirs(local)
    npy.write_npy(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), f"{local}/x.npy", "s_suppkey")
    return npy.read_npy(spark, path).toDF("s_suppkey", "s_acctbal")


def json_roundtrip(spark, sf_dir):
    e = _table(spark, sf_dir, "nation").select("n_nationkey", jsonio.write_column(F.struct("n_name", "n_regionkey")).alias("doc"))
    parsed = jsonio.parse_column(F.col("doc"), "n_name string, n_regionkey int")
    return e.select("n_nationkey", parsed["n_name"].alias("n_name"), parsed["n_regionkey"].alias("n_regionkey"), jsonio.get_column(F.col("doc"), "$.n_name").alias("again"))


def mlp_forecast(spark, sf_dir):
    model = models.MLP.init(Rng(1, 0), [2, 4, 1])
    c = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 10000).alias("a"), (F.col("c_nationkey") / 25).alias("b"))
    return models.forecast_frame(c, model, ["a", "b"], ["y"], ["c_custkey"])


def mlp_fit(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") / 25).alias("x"), (F.col("n_regionkey") / 5).alias("y"), (F.col("n_nationkey") % 2).alias("g"))
    fitted = models.fit_groups(n, ["g"], ["x"], ["y"], "n_nationkey", [1, 3, 1], epochs=20)
    return fitted.select("g", (F.col("loss") > 0).alias("positive"), F.get_json_object("model", "$.sizes").alias("sizes"))


def _streamed(spark, sf_dir, name, build, mode):
    source = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    out, check = _folder(spark), _folder(spark)
    query = build(source).writeStream.format("parquet").outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.parquet(out)


def stream_filter(spark, sf_dir):
    return _streamed(spark, sf_dir, "filter", lambda s: streams.stream_sql(s, "SELECT event_id, value * 2 AS twice FROM events WHERE value > 50 AND event_type != 'view'"), "append")


def _batch_windows(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return streams.windowed(e, "ts", "1 day", "1 hour", ["event_type"], n=("COUNT", "value"), total=("SUM", "value"))


def sql_try(spark, sf_dir):
    """Kind of error of a few wrong queries."""
    from tessera.plans.lowering import try_sql

    n = _table(spark, sf_dir, "nation")
    texts = ["SELCT n_name FROM t", "SELECT nope FROM t", "SELECT n_name FROM t WHERE n_name > 5", "SELECT n_name FROM t"]
    return spark.createDataFrame([(i, try_sql(n, t).error or "OK") for i, t in enumerate(texts)], "i int, kind string")


def sql_nested(spark, sf_dir):
    first = sql(_table(spark, sf_dir, "lineitem"), "SELECT l_suppkey, SUM(l_quantity) AS q FROM l GROUP BY l_suppkey")
    return sql(first, "SELECT AVG(q) AS a, MAX(q) AS m FROM t")


def queries() -> dict:
    return {
        "gauss_logpdf": gauss_logpdf,
        "student_logpdf": student_logpdf,
        "mvgauss_logpdf": mvgauss_logpdf,
        "special_functions": special_functions,
        "cluster_map": cluster_map,
        "csv_roundtrip": csv_roundtrip,
        "txt_roundtrip": txt_roundtrip,
        "npy_roundtrip": npy_roundtrip,
        "json_roundtrip": json_roundtrip,
        "mlp_forecast": mlp_forecast,
        "mlp_fit": mlp_fit,
        "stream_filter": stream_filter,
        "event_windows": _batch_windows,
        "sql_try": sql_try,
        "sql_nested": sql_nested,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "gauss_logpdf": """SELECT c_custkey, -0.5 * ((c_acctbal - 4500) / 3000) * ((c_acctbal - 4500) / 3000) - LN(3000.0::DOUBLE) - 0.5 * LN(2 * PI()) AS logpdf,
          (c_acctbal - 4500) / 3000 / 3000 AS by_loc, (((c_acctbal - 4500) / 3000) * ((c_acctbal - 4500) / 3000) - 1) / 3000 AS by_scale FROM customer""",
        "cluster_map": "SELECT p_partkey AS id, p_size::DOUBLE * p_size + 1 AS out0, p_partkey::DOUBLE AS out1 FROM part",
        "csv_roundtrip": "SELECT n_nationkey::DOUBLE AS n_nationkey, n_name, n_regionkey::DOUBLE AS n_regionkey FROM nation",
        "txt_roundtrip": "SELECT l_orderkey::DOUBLE AS l_orderkey, l_quantity, l_tax FROM lineitem",
        "npy_roundtrip": "SELECT s_suppkey::DOUBLE AS s_suppkey, s_acctbal FROM supplier",
        "json_roundtrip": "SELECT n_nationkey, n_name, n_regionkey, n_name AS again FROM nation",
        "stream_filter": "SELECT event_id, value * 2 AS twice FROM events WHERE value > 50 AND event_type <> 'view'",
        "event_windows": "SELECT date_trunc('day', ts) AS window_start, event_type, COUNT(*) AS n, SUM(value) AS total FROM events GROUP BY 1, 2",
        "sql_try": "SELECT * FROM (VALUES (0, 'SYNTAX'), (1, 'DATA'), (2, 'DATA'), (3, 'OK')) t(i, kind)",
        "sql_nested": "SELECT AVG(q) AS a, MAX(q) AS m FROM (SELECT SUM(l_quantity) AS q FROM lineitem GROUP BY l_suppkey)",
        "student_logpdf": """SELECT c_custkey, LGAMMA(2.0::DOUBLE) - LGAMMA(1.5::DOUBLE) - 0.5 * LN(3 * PI()) - LN(3000.0::DOUBLE)
          - 2 * LN(1 + ((c_acctbal - 4500) / 3000) * ((c_acctbal - 4500) / 3000) / 3) AS logpdf FROM customer""",
        "mvgauss_logpdf": """WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS x, l_discount - 0.05::DOUBLE AS y, 200 * 0.01::DOUBLE - 0.1::DOUBLE * 0.1 AS det FROM lineitem)
          SELECT l_orderkey, l_linenumber, -0.5 * (0.01::DOUBLE * x * x - 0.2::DOUBLE * x * y + 200 * y * y) / det - 0.5 * LN(det) - LN(2 * PI()) AS logpdf FROM d""",
    }
