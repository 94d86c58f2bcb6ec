"""A plain-Python evaluator of the dialect's expressions: the oracle for NaN and infinity."""

import math


def _divide(a, b):
    if b != 0:
        return a / b
    return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)


def value(e, row):
    if e.kind in ("num", "str"):
        return e.value
    if e.kind == "col":
        v = row[e.value]
        return v if isinstance(v, str) else float(v)
    args = [value(a, row) for a in e.args]
    if e.kind == "neg":
        return -args[0]
    if e.kind == "not":
        return float(args[0] == 0)
    a, b = args
    if e.value == "AND":
        return float(a != 0 and b != 0)
    if e.value == "OR":
        return float(a != 0 or b != 0)
    table = {"=": a == b, "!=": a != b, "<>": a != b}
    if e.value in table:
        return float(table[e.value])
    if e.value in ("<", "<=", ">", ">="):
        return float({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[e.value])
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: _divide(a, b)}[e.value]()
