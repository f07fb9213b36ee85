"""Prompts of the sixteen strategies as one expression over columns.

A strategy's layout is a list of parts: plain text, or a name in braces of a part
made from the row (the question, a block of examples, a hint).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracekiln.functions.text import extract_final_answer
from tracekiln.plans.dims import STRATEGIES

# The texts of the prompts.
HEADER = "You are an expert math tutor. Solve the following grade-school math problem carefully and end your answer with #### <number>.\n\n"
STEP_BY_STEP = ("Question: ", "{question}", "\nLet's think step by step.\n")
LAYOUTS: dict[int, tuple[str, ...]] = {
    0: ("Question: ", "{question}", "\nAnswer:"),
    1: STEP_BY_STEP,
    2: ("{manual5}", "Question: ", "{question}", "\nSolution:"),
    3: ("Here are similar problems:\n\n", "{near3}", "Now solve:\nQuestion: ", "{question}", "\nSolution:"),
    4: STEP_BY_STEP,
    5: STEP_BY_STEP,
    6: STEP_BY_STEP,
    7: ("{example}", "Use numbered steps.\nQuestion: ", "{question}", "\n\nStep 1:"),
    8: ("Question: ", "{question}", "\n\nScratch:\n"),
    9: ("Question: ", "{question}", "\n\nKey equation(s): "),
    10: ("{hint}", *STEP_BY_STEP),
    11: ("{worked}", "Question: ", "{question}", "\nFull solution:\n"),
    12: ("{reversed}", "Question: ", "{question}", "\nAnswer:"),
    13: ("Examples with step-by-step reasoning:\n\n", "{near3}", "Now solve step by step:\n", *STEP_BY_STEP),
    14: ("{near2}", *STEP_BY_STEP),
    15: ("{hint}", "Similar solved problems:\n\n", "{near3}", "Solve with numbered steps, end with #### <answer>:\n\nQuestion: ", "{question}", "\n\nStep 1:"),
}
# Sampling of strategies that differ from one sequence at the default temperature.
SAMPLING = {4: (0.9, 5), 5: (0.3, 1), 6: (1.0, 1), 14: (0.9, 3)}
TEMPERATURE = 0.7
#: Strategies that take their examples by similarity where there are any.
DYNAMIC = (3, 13, 14, 15)


def solution_of(example: Column, fields: tuple[str, ...]) -> Column:
    """The first of these fields that is not null, else the empty string."""
    return F.coalesce(*[example[f] for f in fields], F.lit(""))


def examples_block(examples: Column, n: int, fields: tuple[str, ...]) -> Column:
    one = lambda e, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\nQuestion: "), e["question"], F.lit("\nSolution: "), solution_of(e, fields), F.lit("\n\n"))
    return F.array_join(F.transform(F.slice(examples, 1, n), one), "")


def hint(category: Column, complexity: Column) -> Column:
    """What is known of the problem; nothing when neither is."""
    text = F.concat(F.lit("[Problem type: "), F.upper(F.coalesce(category, F.lit("?"))), F.lit(" | Complexity: "), F.coalesce(complexity, F.lit("?")), F.lit("]\n\n"))
    return F.when(category.isNull() & complexity.isNull(), F.lit("")).otherwise(text)


def prompt(
    strategy: Column, question: Column, manual: Column, near: Column, category: Column, complexity: Column, fields: tuple[str, ...] = ("trace", "raw_answer")
) -> Column:
    """struct<prompt, temperature, num_return_sequences>; an unknown strategy raises.

    ``manual`` and ``near`` are arrays of structs with the question and ``fields``;
    a null ``near`` means that nothing was retrieved, and the manual ones are used.
    """
    first = F.try_element_at(manual, F.lit(1))
    some = F.size(manual) > 0
    solved = solution_of(first, fields)
    dynamic = F.coalesce(near, manual)
    answer = F.coalesce(extract_final_answer(solved), F.lit("None"))
    named = {
        "question": question,
        "hint": hint(category, complexity),
        "manual5": examples_block(manual, 5, fields),
        "near3": examples_block(F.slice(dynamic, 1, 3), 3, fields),
        "near2": examples_block(F.slice(dynamic, 1, 2), 2, fields),
        "example": F.when(some, F.concat(F.lit("Example:\nQuestion: "), first["question"], F.lit("\nSolution: "), solved, F.lit("\n\n"))).otherwise(F.lit("")),
        "worked": F.when(some, F.concat(F.lit("Worked example:\nQuestion: "), first["question"], F.lit("\nFull solution:\n"), solved, F.lit("\n\nApply the same approach:\n\n"))).otherwise(F.lit("")),
        "reversed": F.when(some, F.concat(F.lit("[Example — answer is "), answer, F.lit(", question: "), first["question"], F.lit("]\n\n"))).otherwise(F.lit("")),
    }
    body = F.raise_error(F.concat(F.lit("unknown strategy: "), F.coalesce(strategy.cast("string"), F.lit("null")))).cast("string")
    temperature, sequences = F.lit(TEMPERATURE), F.lit(1)
    for sid, layout in LAYOUTS.items():
        parts = [named[p[1:-1]] if p.startswith("{") else F.lit(p) for p in layout]
        body = F.when(strategy == sid, F.concat(F.lit(HEADER), *parts)).otherwise(body)
        if sid in SAMPLING:
            temperature = F.when(strategy == sid, F.lit(SAMPLING[sid][0])).otherwise(temperature)
            sequences = F.when(strategy == sid, F.lit(SAMPLING[sid][1])).otherwise(sequences)
    return F.struct(body.alias("prompt"), temperature.alias("temperature"), sequences.alias("num_return_sequences"))


def strategy_name(strategy: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(n) for n, _ in STRATEGIES]), strategy + 1)
