"""From raw documents to packed training windows, in five stages.

Each stage takes the documents that its predecessor kept, written as Parquet and read again, and all but
the last return documents with the columns they came with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bagwise.llm import exact_dedup, mixing, near_dedup, packing, quality_classifier
from bagwise.llm.common import Tables, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of equal texts, that with the smallest id."""
    return exact_dedup.keep_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each component of near duplicates, that with the smallest id."""
    return near_dedup.keep_distinct(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's budget says."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows, piece by piece."""
    return packing.packed_digests(docs, packing.production_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Not in SQL: the classifier, the search for near duplicates and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage was given goes once its own result is written."""
    tables, docs = Tables(spark), table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES[:-1]):
        docs = tables.keep(name, stage(spark, docs, sf_dir))
        if at:
            tables.drop(STAGES[at - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
