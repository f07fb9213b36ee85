"""Scores of a reasoning trace: validity V, execution E, redundancy R, and the label they give.

Ratios are rounded to four places; the weighted sum is computed on decimals, so
that thresholds are met exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracekiln.functions.text import U, all_of, let, normalize_number

# An equation `a op b = c`, weights, thresholds and neutral scores.
EQUATION = r"(-?[\d,]+(?:\.\d+)?)\s*([+\-\*/×÷])\s*(-?[\d,]+(?:\.\d+)?)\s*=\s*(-?[\d,]+(?:\.\d+)?)"
WEIGHTS = ("0.40", "0.35", "0.25")
GOOD, MEDIUM = "0.65", "0.35"
# Fixed value: two steps are compared by words when one is longer.
BY_WORDS = 200
NEUTRAL_V, NEUTRAL_E, NEUTRAL_R = "0.40", "0.50", "0.80"


def _rounded(value: Column) -> Column:
    return F.round(value, 4).cast("decimal(5,4)")


def _ratio(part: Column, whole: Column) -> Column:
    return part.cast("decimal(18,10)") / whole.cast("decimal(10,0)")


def equations(trace: Column) -> Column:
    """array<struct<a, op, b, c>> of the equations in a trace."""
    parts = F.arrays_zip(*[all_of(trace, EQUATION, k).alias(n) for k, n in enumerate(("a", "op", "b", "c"), 1)])
    return F.transform(parts, lambda p: F.struct(*[p[n].alias(n) for n in ("a", "op", "b", "c")]))


def equation_holds(e: Column) -> Column:
    """Whether c is a op b to a part in 10,000; a division by zero counts as right, for its tolerance has no bound."""
    number = lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")

    def holds(x: Column) -> Column:
        a, b, c, op = x["a"], x["b"], x["c"], x["op"]
        expected = F.when(op == "+", a + b).when(op == "-", a - b).when(op.isin("*", "×"), a * b).when(b != 0, a / F.when(b != 0, b).otherwise(F.lit(1.0)))
        close = let(expected, lambda e: F.abs(c - e) <= F.greatest(F.lit(1e-6), F.abs(e) * 1e-4))
        return F.coalesce(F.when(op.isin("/", "÷") & (b == 0) & a.isNotNull() & c.isNotNull(), F.lit(True)).otherwise(close), F.lit(False))

    return let(F.struct(number(e["a"]).alias("a"), number(e["b"]).alias("b"), number(e["c"]).alias("c"), e["op"].alias("op")), holds)


def gold_numbers(computations: Column) -> Column:
    """Canonical results of the gold computations, as often as they stand there."""
    return F.filter(F.transform(computations, lambda c: normalize_number(c["result"])), lambda x: x.isNotNull())


def validity(found: Column, gold: Column, numbers: Column) -> Column:
    """V from a trace's equations, the gold numbers and the numbers of the trace."""
    own = let(found, lambda f: F.when(F.size(f) > 0, _ratio(F.size(F.filter(f, equation_holds)), F.greatest(F.size(f), F.lit(1)))))
    covered = let(F.array_distinct(gold), lambda w: F.when(F.size(w) > 0, _ratio(F.size(F.array_intersect(w, numbers)), F.greatest(F.size(w), F.lit(1)))))

    def combined(x: Column) -> Column:
        both = F.lit("0.60").cast("decimal(3,2)") * x["own"] + F.lit("0.40").cast("decimal(3,2)") * x["covered"]
        return F.coalesce(_rounded(both), _rounded(x["own"]), _rounded(x["covered"]), F.lit(NEUTRAL_V).cast("decimal(5,4)"))

    return let(F.struct(own.alias("own"), covered.alias("covered")), combined)


def execution(gold: Column, numbers: Column) -> Column:
    """E: the part of the gold results that the trace mentions."""

    def told(x: Column) -> Column:
        hit = F.size(F.filter(x["gold"], lambda g: F.array_contains(x["numbers"], g)))
        return F.when(F.size(x["gold"]) > 0, _rounded(_ratio(hit, F.greatest(F.size(x["gold"]), F.lit(1))))).otherwise(F.lit(NEUTRAL_E).cast("decimal(5,4)"))

    return let(F.struct(gold.alias("gold"), numbers.alias("numbers")), told)


def step_words(steps: Column) -> Column:
    """array<struct<s, w>>: each step with its distinct lower-case words, made once a step, where a step is long enough to be compared by them."""
    words = lambda s: F.array_distinct(F.filter(F.split(F.lower(s), U + r"\s+", -1), lambda w: w != ""))
    both = lambda long: F.transform(steps, lambda s: F.struct(s.alias("s"), F.when(long & (F.length(s) > 0), words(s)).alias("w")))
    return let(F.exists(steps, lambda s: F.length(s) > BY_WORDS), both)


def edit_distance(x: Column, y: Column, wx: Column, wy: Column) -> Column:
    """Normalized edit distance; over the sets of words when a text is longer than 200."""
    longest = F.greatest(F.length(x), F.length(y))
    shared, either = F.size(F.array_intersect(wx, wy)), F.size(F.array_union(wx, wy))
    return (
        F.when(longest == 0, F.lit(0.0))
        .when(F.least(F.length(x), F.length(y)) == 0, F.lit(1.0))
        .when(longest > BY_WORDS, F.when(either == 0, F.lit(0.0)).otherwise(1 - shared / F.greatest(either, F.lit(1))))
        .otherwise(F.levenshtein(x, y) / F.greatest(longest, F.lit(1)))
    )


def near_duplicate(x: Column, y: Column) -> Column:
    """Whether the distance of two steps (struct<s, w>) is under 0.3, on whole numbers.

    Lengths that differ by three tenths or more rule it out without a comparison.
    """
    a, b = F.length(x["s"]), F.length(y["s"])
    longest, shortest = F.greatest(a, b), F.least(a, b)
    by_words = 10 * F.size(F.array_intersect(x["w"], y["w"])) > 7 * F.size(F.array_union(x["w"], y["w"]))
    by_edits = F.when(10 * (longest - shortest) < 3 * longest, 10 * F.levenshtein(x["s"], y["s"]) < 3 * longest).otherwise(F.lit(False))
    return F.when(longest > BY_WORDS, by_words).otherwise(by_edits)


def redundant_steps(steps: Column) -> Column:
    """How many steps repeat an earlier one."""
    return let(step_words(steps), lambda st: F.size(F.filter(st, lambda x, i: F.exists(F.slice(st, F.lit(1), i), lambda y: near_duplicate(x, y)))))


def redundancy(steps: Column) -> Column:
    """R: the part of the steps that repeat nothing before them."""

    def left(st: Column) -> Column:
        n = F.size(st)
        return F.when(n <= 1, F.lit(NEUTRAL_R).cast("decimal(5,4)")).otherwise(_rounded(_ratio(n - redundant_steps(st), F.greatest(n, F.lit(1)))))

    return let(steps, left)


def rex(v: Column, e: Column, r: Column) -> Column:
    a, b, c = (F.lit(w).cast("decimal(3,2)") for w in WEIGHTS)
    return F.round(a * v + b * e + c * r, 4).cast("decimal(5,4)")


def label(correct: Column, score: Column) -> Column:
    good, medium = F.lit(GOOD).cast("decimal(3,2)"), F.lit(MEDIUM).cast("decimal(3,2)")

    def named(x: Column) -> Column:
        return (
            F.when(x["ok"] & (x["s"] >= good), "good").when(x["ok"] & (x["s"] >= medium), "medium").when(~x["ok"] & (x["s"] >= good), "medium").otherwise("bad")
        )

    return let(F.struct(correct.alias("ok"), score.alias("s")), named)
