"""The queries that apply the corpus operators to whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from tracekiln.llm.bpe import encoded
from tracekiln.llm.chat_format import neighbours, preferences
from tracekiln.llm.common import table
from tracekiln.llm.exact_dedup import exact_groups
from tracekiln.llm.jaccard_join import similar
from tracekiln.llm.language_id import learned, predicted
from tracekiln.llm.license_scan import licenses
from tracekiln.llm.oracles import ORACLES
from tracekiln.llm.packing import packed
from tracekiln.llm.pii import personal
from tracekiln.llm.quality_rules import quality
from tracekiln.llm.secret_scan import secrets


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("keep_locator")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, learned(docs))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences(neighbours(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_packing,
            op2_exact_dedup,
            op3_secret_scan,
            op4_pii,
            op5_jaccard_join,
            op6_license_scan,
            op7_byte_bpe,
            op8_language_id,
            op9_quality_rules,
            op10_preference_format,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
