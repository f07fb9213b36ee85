"""Row-wise operators: preprocessing, classification and evaluation of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracekiln.functions import classify, quality, text


def bounded(df: DataFrame, most: int | None = None, ordinal: str = "ordinal") -> DataFrame:
    """The first rows by ordinal; no limit when it is None or 0. The filter reaches the scan."""
    return df.where(F.col(ordinal) < most) if most else df


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns, last, whose values the optimizer takes as they are.

    It moves a filter below a projection by writing the column's whole expression into
    the filter, often as it is named there, and again for the rows that are left. It does not
    do so with what a generator made, here of one row for each.
    """
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], made)


def preprocessed(problems: DataFrame, question: str = "question", answer: str = "answer") -> DataFrame:
    """Adds raw_answer, clean_answer, steps, computations and their counts; a missing answer is empty."""
    raw = F.coalesce(F.col(answer), F.lit(""))
    kept = [c for c in problems.columns if c not in (question, answer)]
    parsed = problems.select(
        *kept,
        F.coalesce(F.col(question), F.lit("")).alias("question"),
        raw.alias("raw_answer"),
        text.extract_answer(raw).alias("clean_answer"),
        text.solution_steps(raw).alias("steps"),
        text.extract_computations(raw).alias("computations"),
    )
    return parsed.select("*", F.size("steps").alias("expected_steps"), F.size("computations").alias("n_computations"))


def categorized(df: DataFrame, question: str = "question", solution: str | None = None) -> DataFrame:
    """Adds the classification; ``solution`` names the column with a worked solution, if there is one."""
    return df.withColumns(classify.categorized(F.col(question), F.col(solution) if solution else None))


def scored(problems: DataFrame, ordinal: str = "ordinal", truth: str = "raw_answer") -> DataFrame:
    """Problems as candidates for selection: index, question, truth, richness, and the class of the question alone."""
    base = problems.select(
        F.col(ordinal).alias("original_index"), "question", F.col(truth).alias("ground_truth"), classify.richness(F.col("question")).alias("richness_score")
    )
    return categorized(base)


def evaluated(df: DataFrame, trace: str = "trace", gold_answer: str = "clean_answer", computations: str = "computations") -> DataFrame:
    """Adds the evaluation of a trace against its problem.

    Numbers, steps and equations of the trace are made once and shared by the scores.
    """
    t = F.coalesce(F.col(trace), F.lit(""))
    parts = df.withColumns(
        {
            "__numbers": text.number_set(t),
            "__steps": text.trace_steps(t),
            "__equations": quality.equations(t),
            "__gold": quality.gold_numbers(F.coalesce(F.col(computations), F.array().cast("array<struct<expr: string, result: string>>"))),
            "pred_answer": text.extract_answer(t),
            "gold_answer": F.col(gold_answer),
        }
    )
    rated = parts.withColumns(
        {
            "__v": quality.validity(F.col("__equations"), F.col("__gold"), F.col("__numbers")),
            "__e": quality.execution(F.col("__gold"), F.col("__numbers")),
            "__r": quality.redundancy(F.col("__steps")),
            "is_correct": text.answers_match(F.col("pred_answer"), F.col("gold_answer")),
            "num_steps": F.size("__steps"),
            "n_gold_ops": F.coalesce(F.size(F.col(computations)), F.lit(0)),
        }
    ).withColumn("__rex", quality.rex(F.col("__v"), F.col("__e"), F.col("__r")))
    double = lambda c: F.col(c).cast("double")
    done = rated.withColumns(
        {
            "rex_score": double("__rex"),
            "validity": double("__v"),
            "execution": double("__e"),
            "redundancy": double("__r"),
            "ops_covered": double("__e"),
            "category": quality.label(F.col("is_correct"), F.col("__rex")),
        }
    )
    return done.drop("__numbers", "__steps", "__equations", "__gold", "__v", "__e", "__r", "__rex")


def first_present(df: DataFrame, *names: str, default: str = "") -> Column:
    """The first of these columns that the frame has and that is not null."""
    return F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(default))
