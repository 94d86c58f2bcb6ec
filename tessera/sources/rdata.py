"""R workspaces (RDX2 and RDX3, plain or gzip) as Python values and frames.

The decoder follows R's documented serialization format (XDR).  Lists, logicals, integers,
doubles, strings and their attributes are read, and the compact integer and real sequences of
RDX3; other kinds are an error.  Data frames give number and text columns: factors their
labels, missing texts ``NA``, missing logicals and integers NaN.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessera.sources.text import FormatError

# Type codes of R's serialization format.
SYM, LIST, CHAR, LGL, INT, REAL, STR, VEC = 1, 2, 9, 10, 13, 14, 16, 19
REF, NILVALUE, ALTREP, GLOBALENV, EMPTYENV, BASEENV = 255, 254, 238, 253, 242, 241
_NA_INT = -(2**31)


@dataclass
class RValue:
    """kind: null, logical, integer, double, string or list."""

    kind: str
    data: object = None
    attributes: dict[str, RValue] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return list(self.attributes["names"].data) if "names" in self.attributes else []

    @property
    def dim(self) -> list[int]:
        return [int(v) for v in self.attributes["dim"].data] if "dim" in self.attributes else []

    @property
    def classes(self) -> list[str]:
        return list(self.attributes["class"].data) if "class" in self.attributes else []


class _Decoder:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.refs = data, 0, []

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise FormatError("the R file is truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def int(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def length(self) -> int:
        n = self.int()
        return self.int() << 32 | (self.int() & 0xFFFFFFFF) if n == -1 else n

    def numbers(self, kind: str, n: int) -> np.ndarray:
        return np.frombuffer(self.take(n * np.dtype(kind).itemsize), kind)

    def header(self) -> None:
        if self.take(2) != b"X\n":
            raise FormatError("only the binary (XDR) form of R files is read")
        version = self.int()
        self.take(8)
        if version == 3:
            self.take(self.int())
        elif version != 2:
            raise FormatError(f"serialization version {version} is not supported")

    def value(self) -> RValue | str | None:
        flags = self.int()
        code, has_attributes, has_tag = flags & 0xFF, bool(flags & 0x200), bool(flags & 0x400)
        if code in (NILVALUE, GLOBALENV, EMPTYENV, BASEENV):
            return RValue("null")
        if code == REF:
            packed = flags >> 8
            return self.refs[(packed or self.int()) - 1]
        if code == SYM:
            name = self.value()
            self.refs.append(name)
            return name
        if code == CHAR:
            n = self.int()
            return None if n == -1 else self.take(n).decode("utf-8", "replace")
        if code == ALTREP:
            return self.altrep()
        if code == LIST:
            return self.pairs(flags)
        if has_tag:
            raise FormatError(f"type {code} with a tag is not supported")
        if code in (LGL, INT):
            out = RValue("logical" if code == LGL else "integer", self.numbers(">i4", self.length()).astype(np.int64))
        elif code == REAL:
            out = RValue("double", self.numbers(">f8", self.length()).astype(float))
        elif code == STR:
            out = RValue("string", [self.value() for _ in range(self.length())])
        elif code == VEC:
            out = RValue("list", [self.value() for _ in range(self.length())])
        else:
            raise FormatError(f"R type {code} is not supported")
        if has_attributes:
            out.attributes = self.attributes()
        return out

    def attributes(self) -> dict[str, RValue]:
        found = self.value()
        return dict(found.data) if isinstance(found, RValue) and found.kind == "pairs" else {}

    def pairs(self, flags: int) -> RValue:
        """A pairlist as (tag, value) items, read in a loop however long it is."""
        items = []
        while True:
            if flags & 0x200:
                self.value()
            tag = self.value() if flags & 0x400 else ""
            items.append((str(tag), self.value()))
            flags = self.int()
            if flags & 0xFF == NILVALUE:
                return RValue("pairs", items)
            if flags & 0xFF != LIST:
                raise FormatError("a pairlist with an unexpected end")

    def altrep(self) -> RValue:
        info = self.value()
        name = info.data[0][1] if isinstance(info, RValue) and info.kind == "pairs" else None
        state, attributes = self.value(), self.value()
        if name not in ("compact_intseq", "compact_realseq"):
            raise FormatError(f"ALTREP class {name!r} is not supported")
        n, start, step = (float(v) for v in state.data)
        values = start + step * np.arange(int(n))
        out = RValue("integer", values.astype(np.int64)) if name == "compact_intseq" else RValue("double", values)
        if isinstance(attributes, RValue) and attributes.kind == "pairs":
            out.attributes = dict(attributes.data)
        return out


def inflate(data: bytes) -> bytes:
    """Contents of a gzip member (its checksum is verified), or the data if it is none."""
    if data[:2] != b"\x1f\x8b":
        return data
    try:
        return zlib.decompress(data, 31)
    except zlib.error as x:
        raise FormatError(f"damaged gzip data: {x}") from x


def read_workspace(data: bytes) -> dict[str, RValue]:
    """Named values of a workspace, in order."""
    data = inflate(data)
    if data[:5] not in (b"RDX2\n", b"RDX3\n"):
        raise FormatError("not an R workspace (RDX2 or RDX3)")
    decoder = _Decoder(data[5:])
    decoder.header()
    found = decoder.value()
    return dict(found.data) if isinstance(found, RValue) and found.kind == "pairs" else {}


def _column(v: RValue):
    if v.kind == "integer" and "levels" in v.attributes:
        labels = v.attributes["levels"].data
        return [labels[c - 1] if 1 <= c <= len(labels) and labels[c - 1] is not None else "NA" for c in v.data.tolist()]
    if v.kind == "string":
        return ["NA" if s is None else s for s in v.data]
    if v.kind in ("logical", "integer"):
        return np.where(v.data == _NA_INT, np.nan, v.data.astype(float))
    if v.kind == "double":
        return v.data
    raise FormatError(f"a column of kind {v.kind} is not supported")


def to_matrix(v: RValue) -> np.ndarray:
    """A numeric vector or matrix; R's column-major order is turned."""
    if v.kind not in ("logical", "integer", "double") or len(v.dim) > 2:
        raise FormatError("not a numeric vector or matrix")
    values = np.asarray(_column(v), float)
    return values.reshape(v.dim, order="F") if len(v.dim) == 2 else values.reshape(-1, 1)


def to_pandas(v: RValue, slice_at: int | None = None) -> pd.DataFrame:
    if slice_at is not None:
        if len(v.dim) != 3 or not 0 <= slice_at < v.dim[2]:
            raise FormatError("a slice needs a 3-D array and an index within it")
        cube = np.asarray(_column(RValue(v.kind, v.data)), float).reshape(v.dim, order="F")
        frame = pd.DataFrame(cube[:, :, slice_at].T)
        names = v.attributes.get("dimnames")
        labels = names.data[0] if names is not None else None
        frame.columns = list(labels.data) if isinstance(labels, RValue) and labels.kind == "string" else [f"col{i}" for i in range(v.dim[0])]
        return frame
    if "data.frame" in v.classes:
        return pd.DataFrame({i: pd.Series(_column(c), dtype=object if c.kind == "string" or "levels" in c.attributes else float) for i, c in enumerate(v.data)}).set_axis(v.names, axis=1)
    matrix = to_matrix(v)
    names = v.attributes.get("dimnames")
    labels = names.data[1] if names is not None and len(names.data) > 1 else None
    columns = list(labels.data) if isinstance(labels, RValue) and labels.kind == "string" else [f"col{i}" for i in range(matrix.shape[1])]
    return pd.DataFrame(matrix, columns=columns)


def read_rdata(spark: SparkSession, path: str, name: str | None = None, slice_at: int | None = None) -> DataFrame:
    """One object of a workspace as a frame; its name may be left out if it is the only one."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise FormatError(f"{path} is missing")
    space = read_workspace(bytes(row.content))
    if name is None:
        if len(space) != 1:
            raise FormatError(f"the workspace has {len(space)} objects; name one of {sorted(space)}")
        name = next(iter(space))
    if name not in space:
        raise FormatError(f"no object {name!r} in the workspace")
    frame = to_pandas(space[name], slice_at)
    kinds = ["string" if frame.iloc[:, i].dtype == object else "double" for i in range(frame.shape[1])]
    names = list(frame.columns)
    plain = frame.set_axis([f"c{i}" for i in range(len(names))], axis=1)
    return spark.createDataFrame(plain, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))).toDF(*names)
