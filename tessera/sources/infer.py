"""Column types from text: a column is a number only if every value is one, else all text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What C's strtod reads in full: blanks before but not after, hexadecimal, inf and nan.
NUMBER = r"^[ \t\n\x0B\f\r]*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN]|0[xX][0-9a-fA-F]+)$"


def is_number(c: Column) -> Column:
    return F.coalesce(c.rlike(NUMBER), F.lit(False))


def to_number(c: Column) -> Column:
    """Value of a text for which :func:`is_number` holds."""
    t = F.lower(F.trim(F.regexp_replace(c, r"[\t\n\x0B\f\r]", " ")))
    minus = t.startswith("-")
    bare = F.regexp_replace(t, r"^[+-]", "")
    size = (
        F.when(bare.startswith("inf"), F.lit(float("inf")))
        .when(bare == "nan", F.lit(float("nan")))
        .when(bare.startswith("0x"), F.conv(F.substring(bare, 3, 100), 16, 10).cast("double"))
        .otherwise(bare.try_cast("double"))
    )
    return F.when(minus, -size).otherwise(size)


def typed(texts: DataFrame) -> DataFrame:
    """Text columns to number or text columns; one aggregation decides for all of them."""
    names = texts.columns
    if not names:
        return texts
    plain = texts.toDF(*[f"c{i}" for i in range(len(names))])
    found = plain.agg(*[F.bool_and(is_number(F.col(f"c{i}"))).alias(f"n{i}") for i in range(len(names))]).first()
    numeric = [found[f"n{i}"] is not False for i in range(len(names))]  # no rows: a number
    return plain.select(*[to_number(F.col(f"c{i}")).alias(f"c{i}") if n else F.col(f"c{i}") for i, n in enumerate(numeric)]).toDF(*names)
