"""NumPy array files: 1-D or 2-D, little-endian float64 or float32, C order, as frames.

Reading goes through Spark's binary file source, so any store works; a file is cut into row
ranges that executors convert.  Writing gathers the frame, within a stated bound.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.lowering import NUM, kind_of
from tessera.sources.text import FormatError

MOST_CELLS = 100_000_000


def _array(data: bytes) -> np.ndarray:
    try:
        f = io.BytesIO(data)
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(f)
    except ValueError as x:
        raise FormatError(f"not an npy file: {x}") from x
    if dtype.str not in ("<f8", "<f4") or fortran or len(shape) not in (1, 2):
        raise FormatError(f"an npy of dtype {dtype.str}, shape {shape}, Fortran order {fortran} is not supported")
    need = int(np.prod(shape)) * dtype.itemsize
    body = data[f.tell() :]
    if len(body) < need:
        raise FormatError("the npy file is truncated")
    return np.frombuffer(body[:need], dtype).reshape(shape if len(shape) == 2 else (-1, 1)).astype(float)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Columns col0, col1, ...; the row order of the file is the order of the column-free frame."""
    files = spark.read.format("binaryFile").load(path).select("content")
    head = files.first()
    if head is None:
        raise FormatError(f"{path} is missing")
    width = _array(bytes(head.content)).shape[1]
    names = [f"col{i}" for i in range(width)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                a = _array(bytes(content))
                for at in range(0, len(a), 65_536):
                    yield pd.DataFrame(a[at : at + 65_536], columns=names)

    return files.mapInPandas(run, ", ".join(f"{n} double" for n in names))


def write_npy(df: DataFrame, path: str, order_by: str | None = None) -> None:
    for f in df.schema.fields:
        if kind_of(f.dataType) != NUM:
            raise FormatError(f"column {f.name!r} is not a number")
    rows = df.count()
    if rows * max(1, len(df.columns)) > MOST_CELLS:
        raise FormatError(f"{rows} rows are above the {MOST_CELLS} cells that an npy file is written from")
    df = df.orderBy(order_by) if order_by else df
    table = df.select(*[F.col(c).cast("double") for c in df.columns]).toPandas()
    np.save(path, np.ascontiguousarray(table.to_numpy(np.float64)))
