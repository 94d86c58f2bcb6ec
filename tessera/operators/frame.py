"""Frames: building, typed access, printing.

A frame is a Spark DataFrame of number and text columns.  Row names are an ordinary hidden
column, ``__row_name``, which queries over named columns do not show.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.lowering import NUM, STR, kind_of
from tessera.plans.sqltext import SqlDataError

ROW_NAME = "__row_name"


def empty(spark: SparkSession, rows: int) -> DataFrame:
    """Rows without columns."""
    return spark.range(rows).select()


def from_matrix(spark: SparkSession, matrix, names: Sequence[str] | None = None) -> DataFrame:
    m = np.atleast_2d(np.asarray(matrix, float))
    names = list(names or [f"col{i}" for i in range(m.shape[1])])
    return spark.createDataFrame([tuple(map(float, r)) for r in m], ", ".join(f"`{n}` double" for n in names))


def _same_length(df: DataFrame, n: int) -> None:
    if df.count() != n:
        raise SqlDataError("the column has another length than the frame")


def add_column(df: DataFrame, name: str, values: Column | Sequence, order_by: str | None = None) -> DataFrame:
    """A column expression, or as many values as there are rows, in the order of ``order_by``."""
    if isinstance(values, Column):
        return df.withColumn(name, values)
    if order_by is None:
        raise ValueError("values need order_by, since rows have no order of their own")
    from tessera.operators.stats import positions

    _same_length(df, len(values))
    text = bool(values) and isinstance(values[0], str)
    data = df.sparkSession.createDataFrame([(i, v if text else float(v)) for i, v in enumerate(values)], f"__at long, `{name}` {'string' if text else 'double'}")
    return positions(df, order_by, "__pos").join(data, F.col("__pos") == F.col("__at")).drop("__pos", "__at")


def set_row_names(df: DataFrame, names: Column | Sequence[str], order_by: str | None = None) -> DataFrame:
    return add_column(df.drop(ROW_NAME), ROW_NAME, names, order_by)


def column_type(df: DataFrame, name: str) -> str:
    if name not in df.columns:
        raise SqlDataError(f"unknown column {name!r}")
    return kind_of(df.schema[name].dataType)


def _typed(df: DataFrame, name: str, kind: str) -> DataFrame:
    if column_type(df, name) != kind:
        raise SqlDataError(f"column {name!r} is not {kind}")
    return df.select(name)


def numeric(df: DataFrame, name: str) -> DataFrame:
    return _typed(df, name, NUM)


def string(df: DataFrame, name: str) -> DataFrame:
    return _typed(df, name, STR)


def show(df: DataFrame, rows: int = 20) -> str:
    """Text of the first rows: row names first, numbers with four decimals."""
    names = [c for c in df.columns if c != ROW_NAME]
    out = [" ".join([" " * 12] * (ROW_NAME in df.columns) + [f"{n:>12}" for n in names])]
    for r in df.limit(rows).collect():
        cells = [f"{r[ROW_NAME]:>12}"] if ROW_NAME in df.columns else []
        cells += [f"{float(r[n]):>12.4f}" if isinstance(r[n], (int, float)) else f"{r[n]!s:>12}" for n in names]
        out.append(" ".join(cells))
    return "\n".join(out) + "\n"


def make_folder(path: str) -> None:
    os.makedirs(path, exist_ok=True)
