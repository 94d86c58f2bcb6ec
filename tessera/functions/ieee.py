"""Column expressions with IEEE-754 results whether or not Spark's ANSI mode is on.

Spark orders NaN above every number and equal to itself; the dialect of this library follows
IEEE: every comparison with NaN is false, except ``!=``.  Guards are written as conjuncts of
their own, so the plain comparison still reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def num(c: Column) -> Column:
    """Any numeric or boolean column as a double."""
    return c.cast("double")


def divide(a: Column, b: Column) -> Column:
    """x/0 is a signed infinity and 0/0 is NaN; never an error."""
    a, b = num(a), num(b)
    return F.when(b != 0, F.try_divide(a, b)).otherwise(a * F.pow(b, F.lit(-1.0)))


def compare(op: str, a: Column, b: Column, a_literal: bool = False, b_literal: bool = False) -> Column:
    """Numeric comparison; ``*_literal`` says that a side is a finite constant."""
    if op == "=":
        return (a == b) if a_literal or b_literal else (a == b) & ~F.isnan(a)
    if op in ("!=", "<>"):
        return (a != b) if a_literal or b_literal else (a != b) | F.isnan(a)
    if op in (">", ">="):
        test = a > b if op == ">" else a >= b
        return test if a_literal else test & ~F.isnan(a)
    test = a < b if op == "<" else a <= b
    return test if b_literal else test & ~F.isnan(b)


def truthy(c: Column) -> Column:
    """A number as a condition: anything but zero (NaN too)."""
    return c != 0


def sum0(c: Column) -> Column:
    """Sum with 0 for no rows."""
    return F.coalesce(F.sum(num(c)), F.lit(0.0))


def avg_nan(c: Column) -> Column:
    """Mean with NaN for no rows."""
    return F.coalesce(F.avg(num(c)), F.lit(NAN))


def min_nan(c: Column) -> Column:
    """Least value; NaN if any value is NaN or there is none."""
    c = num(c)
    return F.when(F.coalesce(F.bool_or(F.isnan(c)), F.lit(True)), F.lit(NAN)).otherwise(F.min(c))


def max_nan(c: Column) -> Column:
    """Greatest value; NaN if any value is NaN or there is none (Spark's max does the first)."""
    return F.coalesce(F.max(num(c)), F.lit(NAN))


def ln(c: Column) -> Column:
    """Natural logarithm: -Infinity at 0, NaN below (Spark: null)."""
    c = num(c)
    return F.when(c > 0, F.ln(c)).when(c == 0, F.lit(float("-inf"))).otherwise(F.lit(NAN))


def is_inf(c: Column) -> Column:
    return F.abs(num(c)) == F.lit(float("inf"))


def power(c: Column, exponent: float) -> Column:
    """x ** n with 0 ** 0 = 1."""
    return F.pow(num(c), F.lit(float(exponent)))


def elementwise(name: str, c: Column) -> Column:
    """exp, log, abs, sqrt, tanh of a column."""
    table = {"exp": lambda x: F.exp(num(x)), "log": ln, "abs": lambda x: F.abs(num(x)), "sqrt": lambda x: F.sqrt(num(x)), "tanh": lambda x: F.tanh(num(x))}
    return table[name](c)
