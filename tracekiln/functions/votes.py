"""Majority vote over candidate answers, as columns on arrays and as an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def majority_vote(answers: Column) -> Column:
    """The most frequent answer that is not null; on a tie the one seen first."""
    given = F.filter(answers, lambda a: a.isNotNull())
    counted = F.transform(F.array_distinct(given), lambda a: F.struct(F.size(F.filter(given, lambda x: x == a)).alias("n"), a.alias("a")))
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("a"))
    return F.aggregate(counted, start, lambda best, c: F.when(c["n"] > best["n"], c).otherwise(best), lambda best: best["a"])


def representative(traces: Column, answers: Column, vote: Column) -> Column:
    """The first trace whose answer is the vote (null equals null), else the first trace."""
    zipped = F.arrays_zip(traces.alias("t"), answers.alias("a"))
    return F.coalesce(F.try_element_at(F.filter(zipped, lambda z: z["a"].eqNullSafe(vote)), F.lit(1))["t"], F.try_element_at(traces, F.lit(1)))


def vote_by(df: DataFrame, key: str, answer: str, place: str) -> DataFrame:
    """key, vote, n_votes from one row a candidate; counts are added up before the shuffle."""
    counts = df.groupBy(key, answer).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    best = F.max_by(F.struct(F.col(answer).alias("vote"), F.col("n")), F.when(F.col(answer).isNotNull(), F.struct("n", (-F.col("first")).alias("first"))))
    return counts.groupBy(key).agg(best.alias("best")).select(key, F.col("best.vote").alias("vote"), F.coalesce(F.col("best.n"), F.lit(0)).cast("long").alias("n_votes"))
