"""The dialect over streams: projections and filters as they are, grouping by event time.

The batch lowering is used unchanged for stateless queries, so a streaming frame has the same
semantics.  Grouping needs a watermark and a window, which the text of the dialect has no
words for; they are arguments here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import ieee
from tessera.plans.lowering import lower
from tessera.plans.sqltext import SqlDataError, parse

_AGGREGATES = {"SUM": ieee.sum0, "AVG": ieee.avg_nan, "MIN": ieee.min_nan, "MAX": ieee.max_nan}


def stream_sql(df: DataFrame, text: str) -> DataFrame:
    """A stateless query (SELECT, WHERE) over a streaming frame."""
    q = parse(text)
    if q.group_by or q.order_by or any(i.expr.has_aggregate() for i in q.items) or (q.where and q.where.has_aggregate()):
        raise SqlDataError("a stream takes projections and filters; use windowed for groups")
    return lower(df, q)


def windowed(df: DataFrame, time: str, width: str, delay: str, keys: list[str], **aggregates: tuple[str, str]) -> DataFrame:
    """Groups by event-time window and keys, late rows beyond ``delay`` dropped by the watermark.
    ``aggregates``: name=(SUM|AVG|MIN|MAX|COUNT, column)."""
    out = [
        (F.count(F.lit(1)) if kind.upper() == "COUNT" else _AGGREGATES[kind.upper()](F.col(column))).alias(name) for name, (kind, column) in aggregates.items()
    ]
    grouped = df.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys).agg(*out)
    return grouped.select(F.col("w.start").alias("window_start"), *keys, *aggregates)
