"""The corpus pipeline: documents to token shards in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next one's documents.  All but the last return the columns of
documents: the quality classifier drops what it rejects, near-duplicates are cut to one
document a group, documents that hold a benchmark item go, the mix repeats, keeps or drops
documents by its targets, and the last stage encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import _base, decontaminate, mixing, near_dup, quality, tokens


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Earlier stages leave the executor's heap grown, so the table of known pieces is smaller here.
    return tokens.encode_documents(docs, tokens.Config(cache_bytes=96 << 20))


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token output", token_stage),
]

#: The trained classifier and the tokenizer are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.documents(spark, sf_dir)
    with _base.scratch(spark):
        for k, (name, stage) in enumerate(STAGES, 1):
            with _base.scratch(spark):  # a stage's own tables go when its result is written
                docs = _base.materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), keep=2 if k == len(STAGES) else 1)
    return docs
