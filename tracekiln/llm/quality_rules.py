r"""Operator 9 [native]: line-first quality rules.

Each line that has a word is judged by rules on its punctuation, on navigation
and on boilerplate; lines that fail are removed, and a document is rejected when
too small a part of its words is left. The base figures are taken from the whole
text.

Defined cases: a null text has no words. Without words all counts are 0 and the
document fails (n_words < 50). Words are runs outside ``[\x20\x09-\x0D]``; lines
are split at ``\n``. Repeated rows are judged alike, and other columns are
ignored. Windows are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracekiln.llm.common import SPACE, text_or_empty

#: A line ends like a sentence, or opens a list or a quotation that goes on.
ENDING = r"[.!?:;,\x{2026}\x{3002}][\"')\x{201D}\x{00BB}\]]*[\x20\x09-\x0D]*$"
#: Separators of menus and bread crumbs, twice in a line at least.
NAVIGATION = r"(\x20[|>\x{00BB}\x{203A}\x{00B7}]\x20.*){2}|(?i:^[\x20\x09-\x0D]*(home|menu|next|previous|back to top|skip to content|sign in|log in|search)[\x20\x09-\x0D]*$)"
BOILERPLATE = r"(?i)all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|click here|subscribe to|lorem ipsum|licen[sc]ed under|is licensed|under the mit license"
#: A document stays if at least this part of its words is in lines that pass.
KEEP_PERCENT = 30

_WORDS = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"


def _bound(value: Column, use) -> Column:
    """``use`` applied to a value that is computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def repeat_words(hashes: str) -> Column:
    """Words that stand in a window found at least twice, from the windows' hashes in order."""

    def covered(at: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

    def few(twice: Column) -> Column:
        at = F.filter(F.transform(hashes, lambda x, i: F.when(F.array_contains(twice, x), i).otherwise(F.lit(-1))), lambda p: p >= 0)
        return covered(at)

    def many() -> Column:
        placed = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = lambda p, k: p["x"] == F.get(s, k)["x"]
            return F.filter(s, lambda p, k: F.coalesce(same(p, k - 1), F.lit(False)) | F.coalesce(same(p, k + 1), F.lit(False)))

        return _bound(placed, lambda s: covered(F.transform(marked(s), lambda p: p["i"])))

    return _bound(
        F.sort_array(hashes),
        lambda s: _bound(
            F.array_distinct(F.filter(s, lambda x, i: F.coalesce(x == F.get(s, i - 1), F.lit(False)))),
            lambda twice: F.when(F.size(twice) == 0, 0).when(F.size(twice) <= 64, few(twice)).otherwise(many()),
        ),
    )


def line_fails(line: Column) -> Column:
    return ~line.rlike(ENDING) | line.rlike(NAVIGATION) | line.rlike(BOILERPLATE)


def quality(docs: DataFrame) -> DataFrame:
    """One row a document: the base figures, what the line rules leave, and the verdict."""
    text = text_or_empty(docs["text"])
    word_lines = F.filter(F.split(text, "\n", -1), lambda l: F.length(F.btrim(l, F.lit(SPACE))) > 0)
    base = docs.select(
        docs["doc_id"],
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.split(F.btrim(text, F.lit(SPACE)), _WORDS, -1).alias("split_words"),
        word_lines.alias("lines"),
    )
    # Trimmed text splits into words alone, except that no word at all gives one empty string.
    base = base.select("*", F.when(F.col("word_chars") > 0, F.col("split_words")).otherwise(F.array().cast("array<string>")).alias("words"))
    some = base.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))).alias("hashes"),
        F.filter("lines", lambda l: ~line_fails(l)).alias("good"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    some = some.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeat_words("hashes").cast("long").alias("n_repeat_words"),
        F.when(F.size("good") == F.col("n_lines"), F.col("n_words")).otherwise(F.aggregate("good", F.lit(0).cast("long"), lambda a, l: a + F.regexp_count(l, F.lit(_WORD)))).alias("n_good_words"),
        "n_lines",
        F.size("good").cast("long").alias("n_good_lines"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return some.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (100 * F.col("n_good_words") >= KEEP_PERCENT * F.col("n_words"))).alias("kept"),
        "n_lines",
        "n_good_lines",
        "n_good_words",
    )


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents' texts without the lines that fail, other columns as they are."""
    lines = F.split(text_or_empty(docs["text"]), "\n", -1)
    return docs.withColumn("text", F.array_join(F.filter(lines, lambda l: (F.length(F.btrim(l, F.lit(SPACE))) == 0) | ~line_fails(l)), "\n"))
