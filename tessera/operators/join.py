"""Equi-joins on one column of the same name, with sentinels for what is missing.

A side that has no partner shows NaN in numbers and the text ``NA`` in strings, never null.
A NaN key matches nothing.  Columns are the left's, then the right's without the key; a right
name that the left has too gets the suffix ``_right``.  RIGHT is LEFT with the sides swapped.
Both sides are plain DataFrame plans: Spark picks broadcast, sort-merge or shuffled hash, and
splits skewed keys at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ieee import NAN
from tessera.plans.lowering import NUM, STR, kind_of
from tessera.plans.sqltext import SqlDataError


def _filled(c: Column, kind: str, present: Column) -> Column:
    if kind == NUM:
        return F.when(present, c.cast("double")).otherwise(F.lit(NAN))
    return F.when(present, c).otherwise(F.lit("NA")) if kind == STR else c


def join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", order_by: tuple[str, str] | None = None) -> DataFrame:
    """INNER, LEFT or FULL join.  ``order_by``: a column of each side that gives its row order;
    the result is then in left order, right matches in right order, unmatched right rows last."""
    if how not in ("inner", "left", "full"):
        raise ValueError(f"how is inner, left or full, not {how!r}; for right, swap the sides and use left")
    kinds = []
    for side, df in (("left", left), ("right", right)):
        if on not in df.columns:
            raise SqlDataError(f"the {side} side has no column {on!r}")
        kinds.append(kind_of(df.schema[on].dataType))
    if kinds[0] != kinds[1]:
        raise SqlDataError(f"column {on!r} is {kinds[0]} on the left and {kinds[1]} on the right")
    a = left.toDF(*[f"l{i}" for i in range(len(left.columns))]).withColumn("l_here", F.lit(True))
    b = right.toDF(*[f"r{i}" for i in range(len(right.columns))]).withColumn("r_here", F.lit(True))
    lk, rk = F.col(f"l{left.columns.index(on)}"), F.col(f"r{right.columns.index(on)}")
    match = lk == rk
    if kinds[0] == NUM and "double" in (left.schema[on].dataType.typeName(), right.schema[on].dataType.typeName()):
        match = (lk.cast("double") == rk.cast("double")) & ~F.isnan(lk.cast("double"))
    both = a.join(b, match, how)
    if order_by is not None:
        lo, ro = F.col(f"l{left.columns.index(order_by[0])}"), F.col(f"r{right.columns.index(order_by[1])}")
        both = both.orderBy(lo.asc_nulls_last(), ro.asc_nulls_last())
    l_here, r_here = F.coalesce("l_here", F.lit(False)), F.coalesce("r_here", F.lit(False))
    out, names = [], list(left.columns)
    for i, f in enumerate(left.schema.fields):
        c, kind = F.col(f"l{i}"), kind_of(f.dataType)
        if f.name == on:
            out.append(F.when(l_here, c).otherwise(rk) if how == "full" else c)
        else:
            out.append(_filled(c, kind, l_here) if how == "full" else c)
    for i, f in enumerate(right.schema.fields):
        if f.name == on:
            continue
        c, kind = F.col(f"r{i}"), kind_of(f.dataType)
        out.append(_filled(c, kind, r_here) if how in ("left", "full") else c)
        names.append(f"{f.name}_right" if f.name in left.columns else f.name)
    return both.select(*[c.alias(f"o{i}") for i, c in enumerate(out)]).toDF(*names)
