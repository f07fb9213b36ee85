"""The strategy and topic dimensions, and the ranks that each strategy's quota takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracekiln.functions.classify import CATEGORIES

# Strategies in order of their number, with examples wanted a topic.
STRATEGIES = (
    ("zero_shot", 0),
    ("zero_shot_cot", 0),
    ("few_shot", 5),
    ("few_shot_dynamic", 3),
    ("self_consistency", 0),
    ("temp_low", 0),
    ("temp_high", 0),
    ("explicit_steps", 3),
    ("scratchpad", 3),
    ("math_first", 3),
    ("category_context", 2),
    ("worked_example", 2),
    ("reversed_qa", 1),
    ("cot_few_shot", 5),
    ("cot_self_consistency", 3),
    ("full_pipeline", 5),
)


def strategy_rows() -> list[tuple[int, str, int, int, int]]:
    """(strategy_id, strategy_name, n_per_cat, rank_start, rank_end): the largest needs take the first ranks."""
    start, spans = 1, {}
    for sid in sorted(range(len(STRATEGIES)), key=lambda s: -STRATEGIES[s][1]):
        need = STRATEGIES[sid][1]
        spans[sid] = (start, start + need - 1)
        start += need
    return [(sid, name, need, *spans[sid]) for sid, (name, need) in enumerate(STRATEGIES)]


def strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(strategy_rows(), "strategy_id int, strategy_name string, n_per_cat int, rank_start int, rank_end int")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(CATEGORIES)], "category_type string, cat_ord int")
