"""From a parsed query to a DataFrame plan: kinds are checked first, then columns are built.

Columns have one of three kinds: NUM (numbers and booleans), STR, and OTHER (dates and nested
types: allowed to be selected, grouped and ordered by, not to be computed with).  After the
check every step is a DataFrame operation, so pruning, pushdown, partial aggregation and the
choice of physical operators are Catalyst's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import ieee
from tessera.plans.sqltext import COMPARISONS, Expr, Query, SqlDataError, SqlError, SqlSyntaxError, parse

NUM, STR, OTHER = "NUM", "STR", "OTHER"


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return NUM
    return STR if isinstance(data_type, T.StringType) else OTHER


@dataclass(frozen=True)
class _Scope:
    """Names of a frame, by exact spelling; of repeated names the first counts."""

    kinds: dict[str, str]
    places: dict[str, int]

    @classmethod
    def of(cls, df: DataFrame) -> _Scope:
        kinds: dict[str, str] = {}
        places: dict[str, int] = {}
        for i, f in enumerate(df.schema.fields):
            if f.name not in kinds:
                kinds[f.name], places[f.name] = kind_of(f.dataType), i
        return cls(kinds, places)

    def kind(self, name: str) -> str:
        if name not in self.kinds:
            raise SqlDataError(f"unknown column {name!r}")
        return self.kinds[name]


def _check(e: Expr, scope: _Scope, inside: bool = False) -> str:
    """Kind of an expression, or :class:`SqlDataError`."""
    if e.kind == "num":
        return NUM
    if e.kind == "str":
        return STR
    if e.kind == "col":
        return scope.kind(str(e.value))
    if e.kind == "agg":
        if inside:
            raise SqlDataError("an aggregate inside an aggregate")
        if e.args and _check(e.args[0], scope, True) != NUM and e.value != "COUNT":
            raise SqlDataError(f"{e.value} needs a number")
        return NUM
    kinds = [_check(a, scope, inside) for a in e.args]
    if e.kind == "bin" and e.value in COMPARISONS and STR in kinds:
        if kinds != [STR, STR]:
            raise SqlDataError("a text is compared with a number")
        if e.value not in ("=", "!=", "<>"):
            raise SqlDataError("texts can only be compared by = and !=")
        return NUM
    if any(k != NUM for k in kinds):
        raise SqlDataError(f"{e.value or e.kind} needs numbers")
    return NUM


def _check_grouped(e: Expr, groups: tuple[str, ...]) -> None:
    """Columns outside aggregates must be group columns."""
    if e.kind == "col" and e.value not in groups:
        raise SqlDataError(f"column {e.value!r} is neither grouped nor aggregated")
    if e.kind != "agg":
        for a in e.args:
            _check_grouped(a, groups)


def validate(q: Query, scope: _Scope) -> bool:
    """Check a query against a frame; True if it is grouped."""
    if q.where is not None and _check(q.where, scope) != NUM:
        raise SqlDataError("WHERE needs a condition")
    for name in q.group_by:
        scope.kind(name)
    grouped = bool(q.group_by) or any(i.expr.has_aggregate() for i in q.items)
    if q.star and grouped:
        raise SqlDataError("SELECT * cannot be grouped")
    for item in q.items:
        _check(item.expr, scope)
        if grouped:
            _check_grouped(item.expr, q.group_by)
    out = {i.name for i in q.items}
    for name, _ in q.order_by:
        if not (name in out or (not grouped and name in scope.kinds)):
            raise SqlDataError(f"unknown ORDER BY column {name!r}")
    return grouped


class _Lower:
    """Expressions to columns.  A condition stays boolean until a number is needed."""

    def __init__(self, column) -> None:
        self.column = column
        self.aggregates: dict[Expr, Column] | None = None

    def number(self, e: Expr) -> Column:
        c, kind = self.value(e)
        return c.cast("double") if kind == "bool" or e.kind in ("col", "agg") else c

    def condition(self, e: Expr) -> Column:
        c, kind = self.value(e)
        return c if kind == "bool" else ieee.truthy(ieee.num(c))

    def value(self, e: Expr) -> tuple[Column, str]:
        """Column and its kind: num, str, bool or any (a bare column as it is stored)."""
        if e.kind == "num":
            return F.lit(float(e.value)), "num"
        if e.kind == "str":
            return F.lit(str(e.value)), "str"
        if e.kind == "col":
            return self.column(str(e.value)), "any"
        if e.kind == "agg":
            return self.aggregate(e), "num"
        if e.kind == "neg":
            return -self.number(e.args[0]), "num"
        if e.kind == "not":
            return ~self.condition(e.args[0]), "bool"
        a, b = e.args
        if e.value == "AND":
            return self.condition(a) & self.condition(b), "bool"
        if e.value == "OR":
            return self.condition(a) | self.condition(b), "bool"
        if e.value in COMPARISONS:
            if self.is_text(a):
                x, y = self.value(a)[0], self.value(b)[0]
                return (x == y if e.value == "=" else x != y), "bool"
            literal = [x.kind == "num" or (x.kind == "neg" and x.args[0].kind == "num") for x in (a, b)]
            return ieee.compare(str(e.value), self.number(a), self.number(b), *literal), "bool"
        x, y = self.number(a), self.number(b)
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: ieee.divide(x, y)}[str(e.value)](), "num"

    def is_text(self, e: Expr) -> bool:
        return e.kind == "str" or (e.kind == "col" and self.text(str(e.value)))

    text = staticmethod(lambda name: False)

    def aggregate(self, e: Expr) -> Column:
        if self.aggregates is not None:
            return self.aggregates[e]
        if e.value == "COUNT":
            return F.count(F.lit(1))
        of = {"SUM": ieee.sum0, "AVG": ieee.avg_nan, "MIN": ieee.min_nan, "MAX": ieee.max_nan}
        return of[str(e.value)](self.number(e.args[0]))


def _aggregates(e: Expr) -> list[Expr]:
    return [e] if e.kind == "agg" else [x for a in e.args for x in _aggregates(a)]


def lower(df: DataFrame, q: Query, order_column: str | None = None) -> DataFrame:
    """The plan of a valid query.  ``order_column`` breaks ties of ORDER BY (a stable sort)."""
    scope = _Scope.of(df)
    grouped = validate(q, scope)
    width = len(df.columns)
    plain = df.toDF(*[f"c{i}" for i in range(width)])  # positions: names may repeat or differ in case only
    to = _Lower(lambda name: F.col(f"c{scope.places[name]}"))
    to.text = lambda name: scope.kinds[name] == STR
    if q.where is not None:
        inner = list(dict.fromkeys(_aggregates(q.where)))
        if inner:  # aggregates in WHERE are those of the whole frame: one row, joined to all
            totals = plain.agg(*[to.aggregate(x).alias(f"w{k}") for k, x in enumerate(inner)])
            to.aggregates = {x: F.col(f"w{k}") for k, x in enumerate(inner)}
            plain = plain.crossJoin(F.broadcast(totals)).where(to.condition(q.where)).drop(*[f"w{k}" for k in range(len(inner))])
            to.aggregates = None
        else:
            plain = plain.where(to.condition(q.where))

    def out(e: Expr) -> Column:
        c, kind = to.value(e)
        return c.cast("double") if kind == "bool" else c

    if grouped:
        items = [out(i.expr).alias(f"o{k}") for k, i in enumerate(q.items)]
        keys = [F.col(f"c{scope.places[name]}") for name in dict.fromkeys(q.group_by)]
        result = plain.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[x for x, i in zip(items, q.items) if i.expr.has_aggregate()])
        # Group columns and constants are added after the aggregation, so the select keeps its order.
        named = [F.col(f"o{k}") if i.expr.has_aggregate() else out(i.expr).alias(f"o{k}") for k, i in enumerate(q.items)]
        result = result.select(*named)
        where = {i.name: f"o{k}" for k, i in reversed(list(enumerate(q.items)))}
        sort = [F.col(where[n]).asc() if up else F.col(where[n]).desc() for n, up in q.order_by]
        if sort:
            result = result.orderBy(*sort)
        return result.toDF(*[i.name for i in q.items])
    names = list(df.columns) if q.star else [i.name for i in q.items]
    items = [F.col(f"c{i}").alias(f"o{i}") for i in range(width)] if q.star else [out(i.expr).alias(f"o{k}") for k, i in enumerate(q.items)]
    if q.order_by:
        alias = {i.name: i.expr for i in reversed(q.items)}
        by = [F.col(f"c{scope.places[n]}") if n in scope.places else out(alias[n]) for n, _ in q.order_by]
        sort = [c.asc() if up else c.desc() for c, (_, up) in zip(by, q.order_by)]
        if order_column is not None:
            sort.append(F.col(f"c{scope.places[order_column]}").asc())
        plain = plain.orderBy(*sort)
    return plain.select(*items).toDF(*names)


def sql(df: DataFrame, text: str, order_column: str | None = None) -> DataFrame:
    """Run a query of the dialect on a frame; raises SqlSyntaxError or SqlDataError."""
    return lower(df, parse(text), order_column)


@dataclass(frozen=True)
class SqlResult:
    """Outcome of :func:`try_sql`: a frame, or the kind (SYNTAX or DATA) and text of an error."""

    frame: DataFrame | None
    error: str | None = None
    message: str = ""

    @property
    def ok(self) -> bool:
        return self.frame is not None


def try_sql(df: DataFrame, text: str, order_column: str | None = None) -> SqlResult:
    """As :func:`sql`, but an error is returned instead of raised."""
    try:
        return SqlResult(sql(df, text, order_column))
    except SqlSyntaxError as x:
        return SqlResult(None, "SYNTAX", str(x))
    except SqlError as x:
        return SqlResult(None, "DATA", str(x))
