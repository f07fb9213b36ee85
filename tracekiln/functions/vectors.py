"""Similarity of unit vectors, as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracekiln.functions.text import let

# Fixed value: what the same category adds.
BOOST = 0.15


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two arrays of the same length, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def word_vector(text: Column, dims: int = 64) -> Column:
    """A unit vector of word counts: each lower-case word falls on one of ``dims`` places. Texts without words are zero."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    places = F.transform(words, lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(dims)).cast("int"))
    counts = let(places, lambda at: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.size(at) - F.size(F.array_remove(at, i))).cast("double")))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return let(counts, lambda v: let(F.greatest(norm(v), F.lit(1.0)), lambda n: F.transform(v, lambda x: x / n)))


def boosted(similarity: Column, same: Column, boost: float = BOOST) -> Column:
    """More for the same category, 1 at most; others are left as they are."""
    return F.when(same, F.least(F.lit(1.0), similarity + boost)).otherwise(similarity)
