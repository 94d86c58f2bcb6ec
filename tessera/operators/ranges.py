"""A task over the integers 0 .. n - 1, by ranges, on the cluster.

The task gets the first index of its range, the range's inputs (d_in x k, or None) and what
is shared, and returns d_out x k results.  Each index is worked on once in the result: Spark
runs a lost or failed range again and keeps the output of one run only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Task = Callable[[int, np.ndarray | None, object], np.ndarray]


def _runs(ids: np.ndarray, chunk: int) -> Iterator[slice]:
    """Slices of consecutive ids, none longer than ``chunk``."""
    at = 0
    while at < len(ids):
        end = at + 1
        while end < len(ids) and end - at < chunk and ids[end] == ids[end - 1] + 1:
            end += 1
        yield slice(at, end)
        at = end


def map_ranges(spark: SparkSession, task: Task, n: int, d_out: int, inputs: DataFrame | None = None, columns: Sequence[str] = (), shared: object = None, chunk: int | None = None, index: str = "id") -> DataFrame:
    """Frame (id, out0 .. out{d_out-1}).  ``inputs`` has the column ``index`` and ``columns``."""
    parts = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
    size = chunk or max(1, -(-n // parts))
    sent, names = spark.sparkContext.broadcast(shared), [f"out{j}" for j in range(d_out)]
    if inputs is None:
        source = spark.range(0, n, 1, parts)
    else:
        source = inputs.select(F.col(index).cast("long").alias("id"), *[F.col(c).cast("double").alias(f"in{i}") for i, c in enumerate(columns)])
        source = source.repartitionByRange(parts, "id").sortWithinPartitions("id")
    fed = [f"in{i}" for i in range(len(columns))] if inputs is not None else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            for s in _runs(ids, size):
                x = batch[fed].to_numpy(float)[s].T if fed else None
                out = np.asarray(task(int(ids[s][0]), x, sent.value) if fed else task(int(ids[s][0]), np.empty((0, s.stop - s.start)), sent.value), float)
                if out.shape != (d_out, s.stop - s.start):
                    raise ValueError(f"the task returned {out.shape}, not {(d_out, s.stop - s.start)}")
                frame = pd.DataFrame(out.T, columns=names)
                frame.insert(0, "id", ids[s])
                yield frame

    return source.mapInPandas(run, ", ".join(["id long", *[f"{x} double" for x in names]]))


def stream_ranges(results: DataFrame, callback: Callable[[int, np.ndarray], None]) -> int:
    """Hand results to ``callback`` (first index, d_out x k) partition by partition; the number of rows."""
    names, rows, held = [c for c in results.columns if c != "id"], 0, []

    def flush() -> None:
        if held:
            callback(held[0][0], np.array([r[1:] for r in held], float).T)
            held.clear()

    for r in results.select("id", *names).toLocalIterator(prefetchPartitions=True):
        if held and r[0] != held[-1][0] + 1:
            flush()
        held.append(tuple(r))
        rows += 1
        if len(held) >= 10_000:
            flush()
    flush()
    return rows
