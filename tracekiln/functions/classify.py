"""Question classes (topic, complexity, main operation) and richness, as columns."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracekiln.functions.text import U, let

# Topics from the lowest priority to the highest, with their keywords in order.
KEYWORDS = {
    "arithmetic": ("add", "subtract", "multiply", "divide", "sum of", "difference of", "product of"),
    "logic": ("if ", "then ", "must ", "either ", "unless", "condition", "at least", "at most", "exactly"),
    "ratio": ("ratio", "proportion", "compared to", "for every", "out of", "fraction of"),
    "counting": ("how many", "count", "number of", "total number", "altogether", "in all", "combined"),
    "rate": (" per ", "each", "rate", "speed", "mph", "km/h", "miles per", "km per", "per hour", "per day", "per week", "per item"),
    "time": ("hour", "minute", "second", "day", "week", "month", "year", "o'clock", "am", "pm", "morning", "evening", "duration"),
    "monetary": ("dollar", "$", "cent", "cost", "price", "pay", "charge", "fee", "earn", "wage", "salary", "discount", "spend", "budget", "afford"),
    "percentage": ("percent", "%", "percentage", "out of 100", "per cent", "discount", "tax", "tip", "interest"),
}
# The order of topics in a selection.
CATEGORIES = ("percentage", "monetary", "time", "rate", "counting", "ratio", "logic", "arithmetic")
# What counts as a mention of an operation.
OPERATIONS = {
    "addition": r"(?i)(?<!\w)[+](?!\w)|add(?:ition|ed|s)\b",
    "subtraction": r"(?i)(?<!\w)[-](?!\w)|subtract(?:ed|s|ion)?\b|minus\b|less\b",
    "multiplication": r"(?i)[*×]|multipl(?:y|ied|ies|ication)\b|times\b|product\b",
    "division": r"(?i)[÷/]|divid(?:e|es|ed|ing|sion)\b|per\b",
}
OPERATION_LINE = r"\d\s*[+\-*/×÷]\s*\d"
MENTION = r"\b\d+(?:\.\d+)?\b"
# Hints that a question takes several steps.
STEP_WORDS = ("then", "after", "also", "each", "total", "remaining", "left", "more", "less", "how many", "how much", "per")


def _present(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in words]), lambda w: w.isNotNull())


def category_type(question: Column) -> Column:
    """The topic of highest priority that has a keyword in the question."""

    def named(low: Column) -> Column:
        out = F.lit("arithmetic")
        for name, words in KEYWORDS.items():
            # A word with another of the topic in it adds nothing.
            least = [w for w in words if not any(o != w and o in w for o in words)]
            out = F.when(reduce(or_, [F.contains(low, F.lit(w)) for w in least]), F.lit(name)).otherwise(out)
        return out

    return let(F.lower(question), named)


def keyword_hits(question: Column) -> Column:
    """Keywords of the winning topic that stand in the question, in their order."""
    out = F.array().cast("array<string>")
    for words in KEYWORDS.values():
        found = _present(question, words)
        out = F.when(F.size(found) > 0, found).otherwise(out)
    return out


def number_mentions(question: Column) -> Column:
    return F.regexp_count(question, F.lit(U + MENTION))


def estimated_steps(question: Column, solution: Column | None = None) -> Column:
    """Lines with an operation in the solution, or half the numbers of the question where there is none."""
    guess = F.greatest(F.lit(1), F.floor(number_mentions(question) / 2).cast("int"))
    if solution is None:
        return guess
    worked = F.size(F.filter(F.split(solution, "\n", -1), lambda l: l.rlike(U + OPERATION_LINE)))
    return F.when(F.coalesce(F.length(solution), F.lit(0)) > 0, worked).otherwise(guess)


def complexity(steps: Column) -> Column:
    return F.when(steps <= 3, "simple").when(steps <= 5, "medium").otherwise("complex")


def main_operation(text: Column) -> Column:
    """The operation mentioned most; ``none`` without any, ``mixed`` on a tie."""
    counts = F.array(*[F.regexp_count(text, F.lit(U + p)) for p in OPERATIONS.values()])

    def named(c: Column) -> Column:
        most = F.array_max(c)
        ties = F.size(F.filter(c, lambda n: n == most))
        names = F.array(*[F.lit(n) for n in OPERATIONS])
        return F.when(most == 0, "none").when(ties > 1, "mixed").otherwise(F.get(names, (F.array_position(c, most) - 1).cast("int")))

    return let(counts, named)


def categorized(question: Column, solution: Column | None = None) -> dict[str, Column]:
    """All columns of a classification by name."""
    steps = estimated_steps(question, solution)
    text = F.concat(F.coalesce(solution, F.lit("")) if solution is not None else F.lit(""), F.lit(" "), question)
    return {
        "category_type": category_type(question),
        "complexity": complexity(steps),
        "main_operation": main_operation(text),
        "estimated_steps": steps,
        "keyword_hits": keyword_hits(question),
    }


def richness(question: Column) -> Column:
    """How much a question offers as an example, from length, numbers and hints of steps; decimal(5,4) as double.

    Computed on decimals, where a half is rounded up.
    """
    d = lambda x: F.lit(x).cast("decimal(10,6)")
    size = F.length(question)
    length = F.when(size < 40, d("0.3")).when(size <= 200, d("1")).when(size >= 500, d("0.4")).otherwise(((700 - size).cast("decimal(10,0)") * d("0.002")).cast("decimal(10,6)"))
    # 0.35 * n / 5 is 0.07 a number, five numbers at most.
    numbers = F.least(F.lit(5), number_mentions(question)).cast("decimal(10,0)") * d("0.07")
    low = F.lower(question)
    step_hits = sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in STEP_WORDS), F.lit(0))
    # 0.30 * hits / 3 is a tenth a hit, three hits at most.
    steps = F.least(F.lit(3), step_hits).cast("decimal(10,0)") * d("0.1")
    return F.round(d("0.35") * length + numbers + steps, 4).cast("double")
