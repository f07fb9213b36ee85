"""The corpus pipeline: language, exact copies, near copies, personal data, packing.

Each stage takes what the one before it kept and returns the columns of
``documents``; the last returns packed pieces. The rows of the result depend on a
trained model, so there is no SQL for them.

Defined cases: documents with a null, empty or letterless text go in the first stage.
Rows without ``doc_id`` are judged like others; of equal and near copies they are the
last that stay. Rows repeated whole stay once. Other columns are carried to the last
stage, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracekiln.llm import exact_dedup, jaccard_join, language_id, packing, pii
from tracekiln.llm.common import freed, small_batches, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a clear language go."""
    small_batches(spark)
    return language_id.identified(docs, language_id.learned(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest original stays."""
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles, the smallest ``doc_id`` stays."""
    small_batches(spark)
    return jaccard_join.thinned(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced in the texts."""
    small_batches(spark)
    return pii.redacted(docs)


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("pii", personal_data),
    ("packing", packs),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            freed(spark, before)
        before = docs
    return docs
