r"""Operator 8: language identification, words first with back-off to characters.

Words and their languages are counted over all training documents. A word that is
known is scored by its log frequency in each language; an unseen word falls back
to character 4-grams, a 4-gram that is unseen to its 3-grams, and so on to single
letters. Scores of a document's words are added up and turned into a part of 1.

Every word and n-gram of the training rows is known, however rare it or its
language is; counts are sums over all rows. Words with at least ``1 / HELD_WORDS``
of all counted words are sent to the tasks, and n-grams with ``1 / HELD_GRAMS`` of
their length (all, up to ``HELD_WHOLE`` of them), so that what a task holds is
bounded. All others stand in a table
that the words of the documents are joined with. Log frequencies are whole
multiples of ``1 / UNIT``, so sums, and with them the results, are the same
whatever is held in the tasks.

Defined cases: training uses rows with non-null text and lang and with
``crc32(doc_id as text) mod 5 <> 0``; a null ``doc_id`` is never trained on and
not held out. A text that is null or has no letter is ``und`` with score 0, and so
is every text when nothing was learned. Ties go to the language first in
alphabetical order. Repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracekiln.llm.common import batches, freed, stored, trimmed

HELD_WORDS = 1 << 20
HELD_GRAMS = 1 << 18
#: So many words, and n-grams of a length, are all held.
HELD_WHOLE = 1 << 17
LENGTHS = (4, 3, 2, 1)
#: Log probability for what a language does not have, and how much less sure n-grams are than words.
FLOOR = -16.0
BACK_OFF = 0.4
UNIT = 1 << 32
#: Entries that a task counts before it sends them on, and unseen words that a worker holds.
HELD = 300_000
#: Digests of rejected texts that may be sent to every task.
SENT = 1 << 20
#: The pipeline keeps documents with at least this score.
LEAST_SCORE = 0.5

WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if len(padded) >= n else []


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over the training rows; each task adds up before anything is shuffled."""
    rows = docs.where(docs["doc_id"].isNotNull() & docs["text"].isNotNull() & docs["lang"].isNotNull() & ~held_out(docs["doc_id"])).select("lang", "text")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])
            counts.clear()

        for batch in batches(source, most_bytes=1_000_000):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > HELD:
                yield from flushed()
        yield from flushed()

    return rows.mapInArrow(trimmed(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> DataFrame:
    """lang, size, gram, n from counted words."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            lang, gram = zip(*counts, strict=True) if counts else ((), ())
            out = pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "gram", "n"])
            counts.clear()
            return out

        for batch in source:
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
                for size in LENGTHS:
                    for gram in grams_of(word, size):
                        counts[lang, gram] += n
            if len(counts) > HELD:
                yield flushed()
        yield flushed()

    # Counted words are few bytes for much work: they are dealt out over all tasks.
    dealt = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = dealt.mapInArrow(trimmed(run), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return counted.select("lang", F.length("gram").alias("size"), "gram", "n")


def _rows(counts: DataFrame, key: str, langs: list[str]) -> tuple[DataFrame, int]:
    """key, all, row: the log frequency in each language of every key, in units; and the sum of all counts."""
    sums = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    by_key = counts.groupBy(key).agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("lang") == x, F.col("n"))).alias(f"n_{i}") for i, x in enumerate(langs)])
    least = F.lit(FLOOR)
    logs = [F.greatest(F.coalesce(F.log(F.col(f"n_{i}") / F.lit(float(max(1, sums.get(x, 0))))), least), least) for i, x in enumerate(langs)]
    return by_key.select(key, "all", F.array(*[F.rint(v * F.lit(float(UNIT))).cast("long") for v in logs]).alias("row")), sum(sums.values())


Table = tuple[list[str], np.ndarray]


class Model:
    """Log frequencies by language for known words and for n-grams of each length.

    ``tables`` has the words that tasks hold under 0 and n-grams under their length;
    ``rest`` has frames (word, row) and (gram, row) of all others, if there are any.
    Rows of words stand in one matrix; words that are unseen get theirs from n-grams
    when they first turn up, and are held for the next texts, up to ``HELD``. A model is
    sent to the tasks as it is: a worker makes it once and drops it with the broadcast.
    """

    def __init__(self, langs: list[str], tables: dict[int, Table], rest: tuple[DataFrame, DataFrame] | None = None):
        self.langs, self.tables, self.rest = langs, tables, rest
        none: Table = ([], np.zeros((0, len(langs)), dtype=np.int64))
        held = [tables.get(n, none) for n in LENGTHS]
        self.gram = {g: i for i, g in enumerate(g for names, _ in held for g in names)}
        self.gram_rows = np.concatenate([rows for _, rows in held])
        self.words, self.known_rows = tables.get(0, none)
        self._forget()

    def __reduce__(self):
        return Model, (self.langs, self.tables)

    def _forget(self) -> None:
        self.index = {w: i for i, w in enumerate(self.words)}
        self.rows, self.used = self.known_rows, len(self.known_rows)

    def missing(self, word: str) -> set[str]:
        """N-grams of an unseen word that are not held and may be needed for its row."""
        padded = f" {word} "
        first = min(LENGTHS[0], len(padded))
        out: set[str] = set()
        parts = [padded[i : i + first] for i in range(len(padded) - first + 1)]
        while parts:
            gram = parts.pop()
            if gram not in self.gram and gram not in out:
                out.add(gram)
                if len(gram) > 1:
                    parts += [gram[:-1], gram[1:]]
        return out

    def unseen(self, words: list[str], more: dict[str, list[int]] | None = None) -> np.ndarray:
        """Rows of unseen words: the mean of their 4-grams, each replaced by its shorter parts while it is unseen.

        ``more`` has n-grams that are known but not held.
        """
        known, rows = self.gram, self.gram_rows
        if more:
            names = list(more)
            extra = {g: len(rows) + i for i, g in enumerate(names)}
            rows = np.concatenate([rows, np.array([more[g] for g in names], dtype=np.int64)])
        else:
            extra = {}
        at, share, begin = [], [], []
        for word in words:
            begin.append(len(at))
            padded = f" {word} "
            first = min(LENGTHS[0], len(padded))
            for i in range(len(padded) - first + 1):
                parts = [(padded[i : i + first], 1.0)]
                while parts:
                    gram, weight = parts.pop()
                    k = known.get(gram)
                    if k is None:
                        k = extra.get(gram)
                    if k is not None:
                        at.append(k)
                        share.append(weight)
                    elif len(gram) > 1:
                        parts += [(gram[:-1], weight * BACK_OFF), (gram[1:], weight * BACK_OFF)]
        sizes = np.diff([*begin, len(at)])
        new = np.zeros((len(words), len(self.langs)))
        some = np.flatnonzero(sizes)
        if len(some):
            weight = np.array(share)
            starts = np.array(begin)[some]
            new[some] = np.add.reduceat(rows[at] * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
        return np.rint(new).astype(np.int64)

    def _learn(self, words: list[str]) -> None:
        new = self.unseen(words)
        if self.used + len(new) > len(self.rows):
            room = np.zeros((max(len(new), len(self.rows), 1024), len(self.langs)), dtype=np.int64)
            self.rows = np.concatenate([self.rows[: self.used], room])
        self.rows[self.used : self.used + len(new)] = new
        self.used += len(new)

    def scored(self, total: np.ndarray, n: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) for sums of rows over ``n`` words each."""
        # Words of a text are not independent: the sum is tempered to a mean of a few words' worth.
        x = total / UNIT * (np.minimum(n, 20) / n)[:, None]
        p = np.exp(x - x.max(axis=1, keepdims=True))
        best = p.argmax(axis=1)
        score = p[np.arange(len(p)), best] / p.sum(axis=1)
        return [(self.langs[b], v) for b, v in zip(best.tolist(), score.tolist(), strict=True)]

    def held_sums(self, texts: list[str | None]) -> list[tuple[list[int], int, dict[str, int]]]:
        """For each text: the sum of its held words' rows, its number of words, and its other words with their counts."""
        index, at, times, begin, n, others = self.index, [], [], [], [], []
        for text in texts:
            counts = Counter(words_of(text or ""))
            other = {}
            begin.append(len(at))
            for w, k in counts.items():
                i = index.get(w)
                if i is None:
                    other[w] = k
                else:
                    at.append(i)
                    times.append(k)
            n.append(sum(counts.values()))
            others.append(other)
        # Sums up to each text's end, whose differences are exact in whole numbers.
        upto = np.zeros((len(at) + 1, len(self.langs)), dtype=np.int64)
        np.cumsum(self.rows[at] * np.array(times, dtype=np.int64)[:, None], axis=0, out=upto[1:])
        sums = upto[[*begin[1:], len(at)]] - upto[begin]
        return list(zip(sums.tolist(), n, others, strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text, for a model that is held whole."""
        if self.rest:
            raise ValueError("words of this model stand in a table: use predicted or identified")
        if len(self.index) > len(self.known_rows) + HELD:
            self._forget()
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.langs:
            return out
        index, used, unseen = self.index, self.used, []
        at, times, begin, which = [], [], [], []
        for k, text in enumerate(texts):
            if not text or not any(map(str.isalpha, text)):
                continue
            counts = Counter(words_of(text))
            if not counts:
                continue
            begin.append(len(at))
            which.append(k)
            for w in counts:
                i = index.get(w)
                if i is None:
                    i = index[w] = used + len(unseen)
                    unseen.append(w)
                at.append(i)
            times.extend(counts.values())
        if unseen:
            self._learn(unseen)
        if which:
            times = np.array(times, dtype=np.int64)
            total = np.add.reduceat(self.rows[at] * times[:, None], begin)
            for k, x in zip(which, self.scored(total, np.add.reduceat(times, begin)), strict=True):
                out[k] = x
        return out


def learned(docs: DataFrame) -> Model:
    """The model of all training rows of ``docs`` (doc_id, text, lang)."""
    spark = docs.sparkSession
    counts = stored(word_counts(docs), "language-words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        freed(spark, counts)
        return Model([], {})
    grams = stored(gram_counts(counts), "language-grams")
    tables: dict[int, Table] = {}
    others: dict[int, DataFrame] = {}
    kept = []
    for size in (0, *LENGTHS):
        key, share = ("gram", HELD_GRAMS) if size else ("word", HELD_WORDS)
        rows, total = _rows(grams.where(F.col("size") == size) if size else counts, key, langs)
        rows = stored(rows, f"language-rows-{size}")
        if rows.count() <= HELD_WHOLE:
            share = max(1, total)
        held = rows.where(F.col("all") * share >= total).select(key, "row")
        pairs = [(r[0], r[1]) for r in held.toLocalIterator()]
        tables[size] = ([k for k, _ in pairs], np.array([v for _, v in pairs], dtype=np.int64).reshape(len(pairs), len(langs)))
        rest = rows.where(F.col("all") * share < total).select(key, "row")
        if rest.isEmpty():
            kept.append(rows)
        else:
            others[size] = rest
    freed(spark, counts, grams, *kept)
    if not others:
        return Model(langs, tables)
    none = lambda key: spark.createDataFrame([], f"{key} string, row array<long>")
    return Model(langs, tables, (others.get(0, none("word")), reduce(DataFrame.unionAll, [others[n] for n in LENGTHS if n in others] or [none("gram")])))


def _unseen_rows(words: DataFrame, model: Model, sent) -> DataFrame:
    """word, row of distinct unseen words; n-grams that tasks do not hold come by a join."""

    def needed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in source:
            pairs = [(w, g) for w in batch.column("word").to_pylist() for g in own.missing(w)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([g for _, g in pairs], pa.string())], names=["word", "gram"])

    def made(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in source:
            found = batch.column("found").to_pylist()
            more = {x["gram"]: x["row"] for part in found for x in part or []}
            rows = own.unseen(batch.column("word").to_pylist(), more)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(rows.tolist(), pa.list_(pa.int64()))], names=["word", "row"])

    found = words.mapInArrow(trimmed(needed), "word string, gram string").join(model.rest[1], "gram").groupBy("word").agg(F.collect_list(F.struct("gram", "row")).alias("found"))
    return words.join(found, "word", "left").select("word", "found").mapInArrow(trimmed(made), "word string, row array<long>")


def _joined(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` but the text, lang_pred and score, for a model that tasks do not hold whole."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    other = [c for c in docs.columns if c != "text"]
    size = len(model.langs)

    def summed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches(source, most_bytes=1_000_000):
            sums, n, rare = zip(*own.held_sums(batch.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in other],
                    pa.array(sums, pa.list_(pa.int64())),
                    pa.array(n, pa.int64()),
                    pa.array([list(x) for x in rare], pa.list_(pa.string())),
                    pa.array([list(x.values()) for x in rare], pa.list_(pa.int64())),
                ],
                names=[*other, "held_sum", "n", "words", "times"],
            )

    def said(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in source:
            n = np.array(batch.column("n").to_pylist(), dtype=np.int64)
            out = [("und", 0.0)] * len(n)
            some = np.flatnonzero(n)
            if len(some):
                total = np.array(batch.column("total").to_pylist(), dtype=np.int64)
                for k, x in zip(some.tolist(), own.scored(total[some], n[some]), strict=True):
                    out[k] = x
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in other], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=[*other, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in other)
    parts = docs.mapInArrow(trimmed(summed), f"{fields}, held_sum array<long>, n long, words array<string>, times array<long>")
    parts = stored(parts.withColumn("row_key", F.monotonically_increasing_id()), "language-parts")
    pairs = parts.select("row_key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row_key", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    distinct = pairs.select("word").distinct()
    unseen = stored(distinct.join(model.rest[0], "word", "left_anti"), "language-unseen")
    known = model.rest[0].unionAll(_unseen_rows(unseen, model, sent))
    sums = pairs.join(known, "word").groupBy("row_key").agg(*[F.sum(F.col("times") * F.col("row")[i]).alias(f"s_{i}") for i in range(size)])
    total = F.array(*[F.col("held_sum")[i] + F.coalesce(F.col(f"s_{i}"), F.lit(0)) for i in range(size)]).alias("total")
    whole = parts.drop("words", "times").join(sums, "row_key", "left").select(*other, "n", total)
    return whole.mapInArrow(trimmed(said), f"{fields + ', ' if other else ''}lang_pred string, score double")


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score; only the text enters a prediction."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), "text")
    if model.rest:
        return _joined(rows, model)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches(source, most_bytes=1_000_000):
            out = own.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(trimmed(run), "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """``docs`` without those that have no letter or no clear language; columns as they are."""
    if model.rest:
        # The digest stands for the text, so that rows need no order and copies have one answer.
        digest = F.sha2(F.col("text").cast("binary"), 256)
        said = _joined(docs.select(digest.alias("digest"), "text"), model)
        kept = F.coalesce((F.col("lang_pred") != "und") & (F.col("score") >= least) & F.col("digest").isNotNull(), F.lit(False))
        goes = stored(said.where(~kept).select(F.coalesce("digest", F.lit("")).alias("goes")).distinct(), "language-goes")
        few = goes.count() <= SENT
        return docs.join(F.broadcast(goes) if few else goes, F.coalesce(digest, F.lit("")) == goes["goes"], "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches(source, most_bytes=1_000_000):
            out = own.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in out], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
