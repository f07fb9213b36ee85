"""Deferred retries of the medium and bad pools against a frozen good pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracekiln.operators.records import categorized, evaluated, first_present, preprocessed, settled
from tracekiln.plans.generation import Backend, generated, prompted

#: Which strategy a pool is retried with, and which labels count as recovered.
RULES = {"medium": (2, ("good",)), "bad": (15, ("good", "medium"))}
RATED = ("trace", "pred_answer", "gold_answer", "rex_score", "validity", "execution", "redundancy", "is_correct", "num_steps", "n_gold_ops", "category", "strategy_id", "strategy_name")


def retried(rows: DataFrame, pool: str | None, backend: Backend, manual: DataFrame | None = None, near: DataFrame | None = None, strategy_id: int | None = None) -> DataFrame:
    """Rows of one pool with the outcome of a retry: ``recovered`` and the new values in a struct ``new``.

    Without a name, each row's ``pool`` is that column, and all are tried in one pass.
    A row without a question or an answer is tried with empty ones. A problem that
    the backend returned nothing for, or raised for, is not recovered and stays.
    """
    names = list(RULES) if pool is None else [pool]
    of = lambda value: F.coalesce(*[F.when(F.col("__row.pool") == n, value(*RULES[n])) for n in names]) if pool is None else value(*RULES[pool])
    base = rows.withColumn("__row", F.struct(*rows.columns))
    asked = base.select(
        "__row",
        first_present(rows, "question", "problem").alias("question"),
        first_present(rows, "ground_truth", "raw_answer", "answer").alias("answer"),
        *([F.col("original_index")] if "original_index" in rows.columns else []),
    )
    ready = categorized(preprocessed(asked))
    # What the rating and the prompts need; nothing else is made and sent through the backend.
    needed = [c for c in ready.columns if c in ("__row", "original_index", "question", "category_type", "complexity", "clean_answer", "computations")]
    ready = ready.select(*needed, of(lambda sid, _: F.lit(sid if strategy_id is None else strategy_id)).alias("__sid"))
    rated = evaluated(generated(prompted(ready, "__sid", manual, near), backend, skip_failures=True))
    won = of(lambda _, enough: F.coalesce(F.col("category").isin(*enough), F.lit(False))) & F.col("trace").isNotNull()
    done = settled(rated.select("__row", F.struct(*[F.col(c) for c in RATED]).alias("new"), won.alias("__won")), recovered=F.col("__won"))
    return done.select("__row.*", "new", "recovered")


def recovered(outcome: DataFrame, pool: str) -> DataFrame:
    """Recovered rows, widened with their new values."""
    keep = [c for c in outcome.columns if c not in (*RATED, "new", "recovered", "retry", "recovered_from")]
    return outcome.where("recovered").select(*keep, "new.*", F.lit(True).alias("retry"), F.lit(pool).alias("recovered_from"))


def left_over(outcome: DataFrame) -> DataFrame:
    """Rows that stay where they were, as they were."""
    return outcome.where(~F.col("recovered")).drop("new", "recovered")


def recovery_rate(outcome: DataFrame) -> DataFrame:
    n, won = F.count(F.lit(1)), F.count_if("recovered")
    return outcome.agg(won.alias("recovered"), n.alias("total"), F.round(100 * won / F.greatest(n, F.lit(1)), 1).alias("rate_pct"))


def recovery_rates(outcome: DataFrame, pools: tuple[str, ...] = tuple(RULES)) -> DataFrame:
    """The rate of each of these pools, from one pass; a pool without rows has a rate of zero."""
    of = lambda p: F.col("pool") == p
    counts = outcome.agg(*[c for p in pools for c in (F.count_if(of(p) & F.col("recovered")).alias(f"{p}_won"), F.count_if(of(p)).alias(f"{p}_n"))])
    rates = [
        F.struct(
            F.col(f"{p}_won").alias("recovered"),
            F.col(f"{p}_n").alias("total"),
            F.round(100 * F.col(f"{p}_won") / F.greatest(F.col(f"{p}_n"), F.lit(1)), 1).alias("rate_pct"),
            F.lit(p).alias("pool"),
        )
        for p in pools
    ]
    return counts.select(F.inline(F.array(*rates)))
