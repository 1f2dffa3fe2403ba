"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stagelens.llm.common import prepare
from stagelens.llm.mixing import mixed_rows
from stagelens.llm.packing import pack
from stagelens.llm.pii import mask_personal_data
from stagelens.llm.quality_rules import keep_quality
from stagelens.llm.queries import tokenizer
from stagelens.llm.simhash import keep_one
from stagelens.session import step, write_scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Rows that a Python worker gets at once: its memory has to do for all stages.
ROWS = 500


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    prepare(spark, ROWS)
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays."""
    prepare(spark, ROWS)
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; documents without any stay as they are."""
    prepare(spark, ROWS)
    return mask_personal_data(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them, shard by shard in random order."""
    prepare(spark, ROWS)
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a training sequence; a document drawn twice is packed twice."""
    prepare(spark, ROWS)
    return pack(docs, tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("personal data", personal_data),
    ("mixing to target weights", mixing),
    ("best-fit packing", packing),
]

# Compression, fingerprints, a fitted model and tokens are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again by the next."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with step(spark):  # what a stage writes on its way goes when its result is written
            path = write_scratch(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        docs = spark.read.parquet(path)
    return docs
