"""Counts and figures about problems, selections and pools, as frames that a console can show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_counts(df: DataFrame, column: str = "category_type", bar: int = 50) -> DataFrame:
    """Counts by topic with a bar, largest first; a missing topic is ``unknown``."""
    counts = df.groupBy(F.coalesce(column, F.lit("unknown")).alias("category_type")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("bar", F.repeat(F.lit("█"), F.least("n", F.lit(bar)).cast("int"))).orderBy(F.desc("n"), "category_type")


def preprocess_stats(problems: DataFrame) -> DataFrame:
    """Sums and means of computations and steps."""
    return problems.agg(
        F.count(F.lit(1)).alias("n_problems"),
        F.coalesce(F.sum("n_computations"), F.lit(0)).alias("computations"),
        F.coalesce(F.sum("expected_steps"), F.lit(0)).alias("steps"),
        F.coalesce(F.round(F.avg("n_computations"), 4), F.lit(0.0)).alias("avg_computations"),
        F.coalesce(F.round(F.avg("expected_steps"), 4), F.lit(0.0)).alias("avg_steps"),
        F.count("clean_answer").alias("n_answers"),
    )


def total_examples(chosen: DataFrame) -> DataFrame:
    return chosen.agg(F.count(F.lit(1)).alias("n_total"), F.count_distinct("original_index").alias("n_distinct"))


def first_row(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    return df.orderBy(ordinal).limit(1)
