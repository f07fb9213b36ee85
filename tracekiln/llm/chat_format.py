r"""Operator 10 [native]: preference formatting of chosen and rejected conversations.

Turns are laid side by side by their place in the conversation. The longest
prefix of equal turns (role and text) is rendered once as the prompt; the turns
after it become one completion for each side, with the spans of assistant
answers as the loss mask. Only rows of one pair and side meet, after they have
been rendered; the prefix is found from a single minimum a pair.

Defined cases: turns are ordered by ``turn``; turns repeated under one place are
taken by role, then text, one after the other. A null text is the empty text, a
null role the empty role. A pair of equal conversations has only a prompt and
two empty completions; a side without turns gives an empty prompt and an empty
completion. Turns without a conversation are ignored; an empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"


def neighbours(turns: DataFrame) -> DataFrame:
    """A row a turn with its pair and side: conversation 2k is chosen, 2k + 1 rejected."""
    return turns.where(turns["conv_id"].isNotNull()).select(
        F.shiftright(turns["conv_id"].cast("long"), 1).alias("pair_id"),
        (turns["conv_id"] % 2 != 0).alias("rejected"),
        turns["turn"].cast("long").alias("turn"),
        F.coalesce(turns["role"], F.lit("")).alias("role"),
        F.coalesce(turns["text"], F.lit("")).alias("text"),
    )


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def preferences(paired: DataFrame) -> DataFrame:
    """One row a pair from rows (pair_id, rejected, turn, role, text).

    Returns pair_id, n_prefix, prompt, chosen, rejected, chosen_mask and
    rejected_mask: masks are ``start:end`` code points of the completion, comma
    joined, one for each assistant answer with its closing mark.
    """
    place = F.row_number().over(W.partitionBy("pair_id", "rejected").orderBy("turn", "role", "text"))
    turns = paired.select("pair_id", "rejected", "role", "text", (place - 1).cast("long").alias("place"))
    both = turns.groupBy("pair_id", "place").agg(
        *[F.max(F.when(F.col("rejected") == side, F.struct("role", "text"))).alias(name) for side, name in ((F.lit(False), "c"), (F.lit(True), "r"))]
    )
    # The first place where the sides differ, or where one has ended.
    shape = both.withColumn("differs", ~F.coalesce((F.col("c.role") == F.col("r.role")) & (F.col("c.text") == F.col("r.text")), F.lit(False)))
    first = F.coalesce(F.min(F.when(F.col("differs"), F.col("place"))), F.count(F.lit(1)))
    pairs = shape.groupBy("pair_id").agg(first.alias("n_prefix"), F.array_sort(F.collect_list(F.struct("place", "c", "r"))).alias("turns"))

    def side(name: str) -> Column:
        return F.filter(F.slice("turns", (F.col("n_prefix") + 1).cast("int"), F.greatest(F.size("turns"), F.lit(1))), lambda t: t[name].isNotNull())

    def text(kept: Column, name: str) -> Column:
        return F.array_join(F.transform(kept, lambda t: rendered(t[name]["role"], t[name]["text"])), "")

    def mask(kept: Column, name: str) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans"))

        def step(a: Column, t: Column) -> Column:
            end = a["at"] + F.length(rendered(t[name]["role"], t[name]["text"]))
            begin = a["at"] + F.length(F.concat(F.lit(OPEN), t[name]["role"], F.lit(MIDDLE)))
            span = F.concat(F.when(a["spans"] == "", F.lit("")).otherwise(F.lit(",")), begin.cast("string"), F.lit(":"), end.cast("string"))
            return F.struct(end.cast("long").alias("at"), F.concat(a["spans"], F.when(t[name]["role"] == "assistant", span).otherwise(F.lit(""))).alias("spans"))

        return F.aggregate(kept, start, step, lambda a: a["spans"])

    prompt = F.array_join(F.transform(F.slice("turns", 1, F.col("n_prefix").cast("int")), lambda t: rendered(t["c"]["role"], t["c"]["text"])), "")
    return pairs.select(
        "pair_id",
        F.col("n_prefix").cast("long").alias("n_prefix"),
        prompt.alias("prompt"),
        text(side("c"), "c").alias("chosen"),
        text(side("r"), "r").alias("rejected"),
        mask(side("c"), "c").alias("chosen_mask"),
        mask(side("r"), "r").alias("rejected_mask"),
    )
