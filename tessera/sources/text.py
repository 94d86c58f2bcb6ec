"""CSV and white-space separated text, read and written.

CSV: quotes only at the start of a field, "" for a quote, line breaks inside quotes, blank
lines skipped, ragged rows and empty files are errors; columns of a file without a header are
col0, col1, ...  Text: runs of blanks and tabs between numbers, no quotes, no header unless
asked for.  Both: types by :func:`tessera.sources.infer.typed`.  The writers come as Spark's
(a directory) and as a single file written row by row without gathering the frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.lowering import NUM, STR, kind_of
from tessera.sources.infer import typed


class FormatError(ValueError):
    """The file is not of the format."""


def _first_line_fields(spark: SparkSession, path: str, delimiter: str) -> list[str]:
    head = spark.read.option("header", False).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", True).option("emptyValue", "").csv(path)
    row = head.first() if head.columns else None
    if row is None:
        raise FormatError(f"{path} is empty")
    return [v if v is not None else "" for v in row]


def read_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",") -> DataFrame:
    fields = _first_line_fields(spark, path, delimiter)
    names = fields if header else [f"col{i}" for i in range(len(fields))]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {"header": header, "sep": delimiter, "quote": '"', "escape": '"', "multiLine": True, "mode": "FAILFAST", "emptyValue": "", "enforceSchema": True}
    texts = spark.read.schema(schema).options(**options).csv(path)
    return typed(texts.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in texts.columns])).toDF(*names)


def number_text(c: Column) -> Column:
    """Shortest text that reads back as the same double; whole numbers without ``.0``."""
    d = c.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return (
        F.when(F.isnan(d), F.lit("nan"))
        .when(d == float("inf"), F.lit("inf"))
        .when(d == float("-inf"), F.lit("-inf"))
        .when(whole, d.cast("long").cast("string"))
        .otherwise(d.cast("string"))
    )


def _fields(df: DataFrame, delimiter: str | None) -> list[Column]:
    out = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"c{i}")
        if kind_of(f.dataType) == NUM:
            out.append(number_text(c))
        elif delimiter is None:
            raise FormatError(f"column {f.name!r} is not a number")
        else:
            text = F.coalesce(c.cast("string"), F.lit(""))
            quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
            special = text.contains('"') | text.contains(delimiter) | text.contains("\n") | text.contains("\r")
            out.append(F.when(special, quoted).otherwise(text))
    return out


def _lines(df: DataFrame, delimiter: str | None) -> DataFrame:
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(F.concat_ws(delimiter or " ", *_fields(df, delimiter)).alias("value"))


def _quoted(name: str, delimiter: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(x in name for x in ('"', delimiter, "\n", "\r")) else name


def write_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",") -> None:
    """A directory of part files, written by the executors."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = plain.select(*[c.alias(f"o{i}") for i, c in enumerate(_plain_fields(df))]).toDF(*df.columns)
    out.write.option("header", header).option("sep", delimiter).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _plain_fields(df: DataFrame) -> list[Column]:
    return [number_text(F.col(f"c{i}")) if kind_of(f.dataType) == NUM else F.col(f"c{i}") for i, f in enumerate(df.schema.fields)]


def _stream(lines: DataFrame, path: str, first: str | None) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        if first is not None:
            f.write(first + "\n")
        for row in lines.toLocalIterator(prefetchPartitions=True):  # one partition at a time
            f.write(row.value + "\n")


def write_csv_single(df: DataFrame, path: str, header: bool = True, delimiter: str = ",") -> None:
    """One local file, with quotes only where they are needed."""
    _stream(_lines(df, delimiter), path, delimiter.join(_quoted(n, delimiter) for n in df.columns) if header else None)


def read_txt(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Header: the first line that is not blank (of a single file)."""
    value = F.regexp_replace(F.col("value"), r"^[ \t\r]+|[ \t\r]+$", "")
    lines = spark.read.text(path).select(value.alias("value")).where(F.col("value") != "")
    first = lines.first()
    if first is None:
        raise FormatError(f"{path} is empty")
    top = first.value.replace("\t", " ").split()
    width = len(top)
    if header:
        numbered = lines.withColumn("__id", F.monotonically_increasing_id())
        start = numbered.agg(F.min("__id").alias("m")).first().m
        lines = numbered.where(F.col("__id") != start).select("value")
    parts = F.split("value", r"[ \t]+")
    ragged = F.raise_error(F.concat(F.lit("ragged row: "), F.col("value"))).cast("array<string>")
    checked = lines.select(F.when(F.size(parts) == width, parts).otherwise(ragged).alias("p"))
    return typed(checked.select(*[F.col("p")[i].alias(f"c{i}") for i in range(width)])).toDF(*(top if header else [f"col{i}" for i in range(width)]))


def write_txt(df: DataFrame, path: str) -> None:
    """Numbers separated by blanks, as a directory of part files."""
    _lines(df, None).write.text(path)


def write_txt_single(df: DataFrame, path: str, header: bool = False) -> None:
    _stream(_lines(df, None), path, " ".join(df.columns) if header else None)


__all__ = ["STR", "FormatError", "number_text", "read_csv", "read_txt", "write_csv", "write_csv_single", "write_txt", "write_txt_single"]
