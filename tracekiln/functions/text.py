"""Numbers, answers, annotated computations and steps out of solution texts, as columns.

All patterns run with Unicode classes, so that digits and white space mean the
same on the JVM as in the regular expressions that the texts were made for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

U = "(?U)"

# The formats that solutions are written in.
COMPUTATION = r"<<([^<>]+)=([^<>]+)>>"
MARKER = r"####\s*([\d,\.\-]+)"
PHRASE = r"(?i)(?:the\s+)?(?:final\s+)?answer\s*(?:is|=|:|was|will\s+be)\s*([\d,\.\-]+)"
NUMBER = r"-?[\d,]+(?:\.\d+)?"
PLAIN_MARKER = r"####\s*([\d,]+(?:\.\d+)?)"
PLAIN_PHRASE = r"(?i)(?:the\s+)?answer\s*(?:is|=|:)\s*([\d,]+(?:\.\d+)?)"
PLAIN_NUMBER = r"[\d,]+(?:\.\d+)?"
CURRENCY = r"[\$£€¥₹]"
UNITS = (
    r"(?i)\s*(?:dollars?|cents?|euros?|pounds?|yuan|rupees?|hours?|minutes?|seconds?|days?|weeks?|months?|years?"
    r"|miles?|km|meters?|feet|inches?|cm|kg|grams?|pounds?|ounces?|liters?|gallons?|ml|percent|%"
    r"|items?|units?|pieces?|each|times?|students?|people|persons?|books?|apples?|oranges?|cars?|boxes?|bags?|pairs?"
    r"|tickets?|coins?|marbles?|balls?|flowers?|trees?)\b"
)
#: Whole numbers as most texts have them: without their commas, a long holds them.
WHOLE = r"^-?[0-9][0-9,]{0,14}$"
#: What a number may look like once units, currency and commas are gone.
NUMERIC = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once and named, however often it is used.

    Without it, an expression that is written out wherever it is used grows with every
    level, and again where the optimizer moves a filter below it.
    """
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, U + r"^\s+|\s+$", "")


def hits(text: Column, pattern: str) -> Column:
    return text.rlike(U + pattern)


def group(text: Column, pattern: str, k: int = 1) -> Column:
    return F.regexp_extract(text, U + pattern, k)


def all_of(text: Column, pattern: str, k: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(U + pattern), F.lit(k))


def normalize_number(text: Column) -> Column:
    """The canonical string of a number: no currency, unit, comma, trailing zero or point; null if it is none.

    Fractions have at most four places, rounded half away from zero on the decimal
    text. What no double can hold is null. A whole number is its integer, without a
    search for units.
    """
    whole = lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("bigint").cast("string")
    return let(text, lambda t: F.when(t.rlike(WHOLE), whole(t)).otherwise(_any_number(t)))


def _any_number(text: Column) -> Column:
    plain = strip(F.replace(F.regexp_replace(F.regexp_replace(strip(text), CURRENCY, ""), U + UNITS, ""), F.lit(","), F.lit("")))

    def canonical(plain: Column) -> Column:
        digits = F.replace(plain, F.lit("_"), F.lit(""))
        value = F.when(plain.rlike(NUMERIC), digits.try_cast("double"))
        exact = digits.try_cast("decimal(38,10)")
        short = F.regexp_replace(F.regexp_replace(F.round(exact, 4).cast("string"), r"0+$", ""), r"\.$", "")
        return F.when(value.isNull() | (F.abs(value) == float("inf")), None).when(exact.isNotNull(), short).otherwise(value.try_cast("decimal(38,0)").cast("string"))

    return let(plain, canonical)


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def extract_answer(text: Column) -> Column:
    """Answer of a trace: the first marker decides, else the first phrase, else the last number; no fall-through."""
    return normalize_number(
        F.when(hits(text, MARKER), group(text, MARKER)).when(hits(text, PHRASE), group(text, PHRASE)).otherwise(last(all_of(text, NUMBER)))
    )


def extract_final_answer(text: Column) -> Column:
    """Answer as the generator reads it: unsigned, commas removed, not canonical."""
    bare = lambda x: F.replace(x, F.lit(","), F.lit(""))
    return (
        F.when(hits(text, PLAIN_MARKER), bare(group(text, PLAIN_MARKER)))
        .when(hits(text, PLAIN_PHRASE), bare(group(text, PLAIN_PHRASE)))
        .otherwise(bare(last(all_of(text, PLAIN_NUMBER))))
    )


def answers_match(pred: Column, gold: Column, tolerance: float = 1e-9) -> Column:
    """Equal strings, numbers within the tolerance, or equal words whatever their case; null matches nothing."""

    def same(x: Column) -> Column:
        p, g = x["p"].try_cast("double"), x["g"].try_cast("double")
        words = F.lower(strip(x["p"])) == F.lower(strip(x["g"]))
        return F.coalesce((x["p"] == x["g"]) | F.when(p.isNotNull() & g.isNotNull(), F.abs(p - g) <= tolerance).otherwise(words), F.lit(False))

    return let(F.struct(pred.alias("p"), gold.alias("g")), same)


def extract_computations(text: Column) -> Column:
    """array<struct<expr, result>> of the annotations ``<<expr=result>>``."""
    pairs = F.arrays_zip(all_of(text, COMPUTATION, 1).alias("expr"), all_of(text, COMPUTATION, 2).alias("result"))
    return F.transform(pairs, lambda p: F.struct(p["expr"].alias("expr"), p["result"].alias("result")))


def solution_steps(text: Column) -> Column:
    """Trimmed lines with annotations as ``= result``; no empty ones, no answer line."""
    lines = F.filter(F.split(text, "\n", -1), lambda l: ~F.startswith(strip(l), F.lit("####")))
    return F.filter(F.transform(lines, lambda l: strip(F.regexp_replace(l, COMPUTATION, "= $2"))), lambda l: l != "")


def trace_steps(text: Column) -> Column:
    """Trimmed lines of a trace; no empty ones, no answer line."""
    lines = F.transform(F.split(text, "\n", -1), strip)
    return F.filter(lines, lambda l: (l != "") & ~F.startswith(l, F.lit("####")))


def number_set(text: Column) -> Column:
    """Distinct canonical numbers of a text."""
    return F.array_distinct(F.filter(F.transform(all_of(text, NUMBER), normalize_number), lambda x: x.isNotNull()))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, U + r"\s+", -1), lambda w: w != ""))
