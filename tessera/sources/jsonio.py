"""JSON: trees in Python, and columns of JSON text in frames.

One value a text; what follows it is an error; of a repeated key the last value counts; all
numbers are doubles; writing is compact, in the order of insertion, 17 digits, with control
characters as \\u00xx.  Column functions stay in the JVM.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


class JsonError(ValueError):
    """The text is not JSON, or a value has another type than was asked for."""


def parse(text: str):
    try:
        return json.loads(text, parse_int=float)
    except (ValueError, RecursionError) as x:
        raise JsonError(str(x)) from x


def parse_file(path: str):
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def _number(v: float) -> str:
    if math.isnan(v) or math.isinf(v):
        raise JsonError("JSON has no NaN or infinity")
    return f"{v:.17g}"


def write(value) -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, (int, float)):
        return _number(float(value))
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(write, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(str(k), ensure_ascii=False)}:{write(v)}" for k, v in value.items()) + "}"
    raise JsonError(f"{type(value).__name__} is not a JSON type")


def write_file(value, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(write(value))


def get(tree, key: str):
    """Value of a key, None if it is missing."""
    if not isinstance(tree, dict):
        raise JsonError("not an object")
    return tree.get(key)


def push(tree, value) -> None:
    if not isinstance(tree, list):
        raise JsonError("not an array")
    tree.append(value)


def put(tree, key: str, value) -> None:
    if not isinstance(tree, dict):
        raise JsonError("not an object")
    tree[key] = value


def _typed(tree, kind, name: str):
    if not isinstance(tree, kind) or (kind is float and isinstance(tree, bool)):
        raise JsonError(f"not {name}")
    return tree


def as_number(tree) -> float:
    return _typed(tree, float, "a number")


def as_string(tree) -> str:
    return _typed(tree, str, "a string")


def as_bool(tree) -> bool:
    return _typed(tree, bool, "a boolean")


def array_len(tree) -> int:
    return len(_typed(tree, list, "an array"))


def array_get(tree, i: int):
    return _typed(tree, list, "an array")[i]


def parse_column(c: Column, schema: str) -> Column:
    """A column of JSON text by a schema (of repeated keys the last counts)."""
    return F.from_json(c, schema)


def get_column(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def write_column(c: Column) -> Column:
    return F.to_json(c)
