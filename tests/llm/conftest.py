import pytest
from pyspark.sql import functions as F

DIRTY = [(1, None, "a"), (2, "", None), (3, "one", "a"), (3, "one", "a"), (None, "no id here at all", "b"), (4, "x " * 30_000, None), (5, "a\tb\n\nc  d", "b"), (6, "é" * 40, "a")]


@pytest.fixture(scope="session")
def dirty(spark):
    """Nulls, empty and long texts, repeats, and extra columns with clashing names."""
    df = spark.createDataFrame(DIRTY, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(1) for c in ("score", "size", "key", "cls", "cid", "words", "taken", "hash", "media", "pos")})


@pytest.fixture(scope="session")
def none(dirty):
    return dirty.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
