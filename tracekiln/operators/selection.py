"""Ranking of candidates in their topics, and the quota of each strategy without a loop.

Strategies are served in order of need, and each takes the best candidates that
none before it took. Those before it always took the front of the ranking, so a
strategy owns an interval of ranks; where the topic is too short, the missing ones
are filled from the front again. That is a join of ranks with at most 16 intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracekiln.functions.classify import CATEGORIES
from tracekiln.operators.records import bounded
from tracekiln.plans.dims import categories, strategies, strategy_rows

#: No strategy looks past this rank.
DEEPEST = max(end for *_, end in strategy_rows())


def ranked(scored: DataFrame, keep: int | None = None) -> DataFrame:
    """Adds ``rank`` in the topic by richness, earlier rows first on a tie; up to ``keep`` a topic.

    With ``keep`` the ranking is cut on the map side, so that a large topic sends a few rows a task.
    """
    order = W.partitionBy("category_type").orderBy(F.desc("richness_score"), "original_index")
    out = scored.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= keep) if keep else out


def allocated(front: DataFrame) -> DataFrame:
    """strategy_id, position, rank, is_reuse and the candidate's columns, from rows ranked to DEEPEST."""
    sizes = front.groupBy("category_type").agg(F.max("rank").alias("size"))
    spans = F.broadcast(strategies(front.sparkSession).where("n_per_cat > 0"))  # 11 rows
    fresh = (F.col("rank") >= F.col("rank_start")) & (F.col("rank") <= F.col("rank_end"))
    filled = F.greatest(F.lit(0), F.least("size", "rank_end") - F.col("rank_start") + 1)
    again = (F.col("rank") < F.col("rank_start")) & (F.col("rank") <= F.col("n_per_cat") - filled)
    pairs = front.join(F.broadcast(sizes), "category_type").join(spans, fresh | again)  # sizes: one row a topic
    order = W.partitionBy("strategy_id").orderBy("cat_ord", "is_reuse", "rank")
    placed = pairs.withColumn("is_reuse", ~fresh).join(F.broadcast(categories(front.sparkSession)), "category_type")
    return placed.withColumn("position", F.row_number().over(order) - 1).drop("size", "n_per_cat", "rank_start", "rank_end", "cat_ord", "strategy_name")


def selected(scored: DataFrame, pool_size: int | None = None) -> DataFrame:
    """The examples of each strategy, out of the first ``pool_size`` rows if it is given. Positions are over at most 40 rows a strategy."""
    return allocated(ranked(bounded(scored, pool_size, "original_index"), DEEPEST))


def remaining(scored: DataFrame, chosen: DataFrame) -> DataFrame:
    """Candidates that no strategy took; the chosen are 280 rows at most."""
    taken = chosen.select("original_index").distinct()
    return scored.join(F.broadcast(taken), "original_index", "left_anti")


def selection_summary(chosen: DataFrame) -> DataFrame:
    """Counts by strategy and topic, one column a topic."""
    counts = [F.count_if(F.col("category_type") == c).alias(c) for c in CATEGORIES]
    return chosen.groupBy("strategy_id").agg(*counts, F.count(F.lit(1)).alias("total"))


def sufficiency(chosen: DataFrame) -> DataFrame:
    """Whether each strategy has its need in all topics."""
    have = chosen.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("have"))
    need = strategies(chosen.sparkSession).select("strategy_id", "strategy_name", (F.col("n_per_cat") * len(CATEGORIES)).cast("long").alias("need"))
    out = need.join(F.broadcast(have), "strategy_id", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long")))
    return out.withColumn("sufficient", (F.col("need") == 0) | (F.col("have") >= F.col("need")))


def overlap(chosen: DataFrame, rest: DataFrame) -> DataFrame:
    """How many of the rest ask a question that was chosen; the chosen side is 280 rows at most."""
    asked = chosen.select("question").distinct()
    return rest.join(F.broadcast(asked), "question", "left_semi").agg(F.count(F.lit(1)).alias("n_overlap"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for the same seed however the rows are dealt."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
