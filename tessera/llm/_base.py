"""Helpers that the training-data operators share.

Every intermediate table goes to the folder that ``spark.checkpoint.dir`` names, because
that is the one place a cluster's driver and executors both see.  Only where the setting
is missing (unit tests) does this module choose a folder itself.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised kernel looks at in one go; bounds its temporaries.
SLICE_BYTES = 2_000_000

#: ASCII white space as the contracts write it: ``[\x20\x09-\x0D]``.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, else one made for this process."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own_dir


#: Paths of written tables, a list for each open ``scratch``.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end, but for those it keeps.

    What leaves the block must read kept tables only: they are written when the block ends, so
    no lost executor asks for a deleted one.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def materialize(df: DataFrame, label: str, codec: str = "zstd", level: int = 3, keep: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    This cuts the lineage: what follows survives the loss of any executor, since the
    Parquet files do not belong to one.  The table outlives the ``keep``
    innermost blocks of ``scratch``.
    """
    path = f"{shared_dir(df.sparkSession)}/tessera/{label}-{uuid.uuid4().hex}"
    scopes = _scopes[: len(_scopes) - keep] if keep < len(_scopes) else []
    if scopes:
        scopes[-1].append(path)
    (df.write.option("compression", codec).option("parquet.compression.codec.zstd.level", str(level)).parquet(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text):
    """Column with A-Z lowered and every other character untouched."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words_of(text):
    """Column: the words of a text (maximal runs without ASCII white space), null text as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != F.lit(""))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (length n + 1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row comes alone and whole."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last
