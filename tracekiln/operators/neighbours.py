"""Exact nearest neighbours of many queries, and TF-IDF vectors of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tracekiln.functions.text import let
from tracekiln.functions.vectors import BOOST
from tracekiln.operators import search
from tracekiln.operators.records import settled

#: Queries that are sent to the tasks at once.
BLOCK = 1 << 16
#: Up to so many terms of a text are told apart in its row.
SHORT = 256


def _same(df: DataFrame, more: Sequence[str] = (), k: int | None = None) -> DataFrame:
    """Adds the place of a row among those of the same embedding and category by id, and the group: the first id and a hash.

    Up to ``k`` rows of a group stay, if it is given. What is asked of the place later does not
    change how they are made, so that all readers share them.
    """
    order = W.partitionBy("__k", "embedding", "category").orderBy("id")
    first = F.struct(F.col("id"), F.col("__k").alias("h"))
    # Sorted by the hash, which tells nearly all groups apart.
    rows = df.select("id", "embedding", "category", *more, F.xxhash64("embedding", F.lit(0), "category").alias("__k"))
    rows = rows.withColumn("__at", F.row_number().over(order)).withColumn("__g", F.first(first).over(order))
    return settled(rows.where(F.col("__at") <= k) if k else rows, __n=F.col("__at"))


def _packs(groups: DataFrame, name: str, more: Sequence[str] = ()) -> DataFrame:
    """One row for each pack of groups. It takes the columns that other readers of the groups take, and leaves them out."""
    firsts = groups.where("__n = 1").select("id", F.col("__g.h").alias("h"), "embedding", "category", *more)
    return firsts.mapInArrow(search.packed, "pack binary").withColumnRenamed("pack", name)


def nearest(queries: DataFrame, pool: DataFrame, k: int = 3, category: bool = True, block: int = BLOCK, more: Sequence[str] = ()) -> DataFrame:
    """query_id, rank, pool_id, similarity: the k most similar of the pool for each query; ``more`` names columns of the pool to be added.

    Both frames have (id, embedding, category). Similarity of the same category is
    boosted if ``category`` is set. Ties go to the smaller id. An empty pool gives no rows.
    A query is not kept out of its own candidates.

    Of rows with the same embedding and category, those of the k smallest ids stay, and
    the first stands for them in the search, on either side. Packs of rows are compared
    by matrix products; what may be among the best is summed in order. The pool is read
    once, and what a task holds does not depend on either frame. Queries are sent in
    blocks of about a fixed size.
    """
    spark = pool.sparkSession
    blocks = max(1, -(-queries.count() // block))
    asked = _same(queries)
    own = pool.select("id", "embedding", "category", *more)
    held = _same(own.mapInArrow(search.first_copies(k), own.schema), more, k)
    kinds = {"query_id": queries.schema["id"].dataType, "query_h": LongType(), "pool_id": pool.schema["id"].dataType, "pool_h": LongType(), "similarity": DoubleType()}
    schema = StructType([StructField(n, t) for n, t in kinds.items()])
    pair = search.best_pairs(k, category, BOOST, to_arrow_schema(schema))
    parts = max(32, 3 * spark.sparkContext.defaultParallelism)
    packs = _packs(held, "pack", more).repartition(parts)
    out = None
    for b in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("__g"), F.lit(blocks)) == b)
        part = packs.crossJoin(F.broadcast(_packs(some, "query_pack"))).mapInArrow(pair, schema)
        out = part if out is None else out.unionByName(part)
    order = lambda *key: W.partitionBy(*key).orderBy(F.desc("similarity"), "pool_id")
    near = out.withColumn("__r", F.row_number().over(order("query_id", "query_h"))).where(F.col("__r") <= k)
    # The k best groups have the k best rows.
    rows = held.select(F.col("__g.id").alias("__p"), F.col("__g.h").alias("__h"), F.col("id").alias("__id"), *more)
    full = near.join(rows, F.col("pool_id").eqNullSafe(F.col("__p")) & (F.col("pool_h") == F.col("__h")))
    full = full.select("query_id", "query_h", F.col("__id").alias("pool_id"), "similarity", *more)
    full = full.withColumn("__r", F.row_number().over(order("query_id", "query_h"))).where(F.col("__r") <= k)
    of = asked.select(F.col("id").alias("__q"), F.col("__g.id").alias("__f"), F.col("__g.h").alias("__h"))
    each = full.join(of, F.col("query_id").eqNullSafe(F.col("__f")) & (F.col("query_h") == F.col("__h")))
    each = each.select(F.col("__q").alias("query_id"), "pool_id", "similarity", *more)
    each = each.withColumn("rank", F.row_number().over(order("query_id"))).where(F.col("rank") <= k)
    return each.select("query_id", "rank", "pool_id", "similarity", *more)


def tf_idf(texts: DataFrame, key: str, text: str, features: int = 512) -> DataFrame:
    """key, term, weight: L2-normalized TF-IDF over the most frequent words and pairs of words.

    Words are runs of two word characters or more, lower case; idf is
    ln((1 + n) / (1 + df)) + 1. Among terms of equal count, the first by name enter.
    The vocabulary has at most ``features`` rows.

    Keys and texts are shuffled, terms only where a key has several texts or to be counted.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    several = F.count(F.lit(1)).over(W.partitionBy("key")) > 1
    base = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("several", several)
    pairs = lambda w: F.concat(w, F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1))))
    terms = settled(base.select("key", "several", let(words, pairs).alias("t")), terms=F.col("t")).drop("t")
    short = ~F.col("several") & (F.size("terms") <= SHORT)
    marked = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (F.array_position("terms", t) == i + 1).cast("long").alias("df")))
    counted = lambda rows: rows.select("key", F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
    alone = terms.where(short).select(F.inline(marked)).groupBy("term").agg(F.count(F.lit(1)).alias("tf"), F.sum("df").alias("df"))
    met = counted(terms.where(~short)).groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))
    vocabulary = alone.unionByName(met).groupBy("term").agg(F.sum("tf").alias("all"), F.sum("df").alias("df")).orderBy(F.desc("all"), "term").limit(features)
    n = texts.agg(F.count(F.lit(1)).alias("n_texts"))
    idf = (F.ln((1 + F.col("n_texts")) / (1 + F.col("df"))) + 1).alias("idf")
    known = vocabulary.crossJoin(F.broadcast(n)).select("term", idf).collect()  # at most ``features`` rows
    out = StructType([StructField(key, texts.schema[key].dataType), StructField("term", StringType()), StructField("weight", DoubleType())])
    one = terms.where(~F.col("several") & F.col("key").isNotNull()).select("key", "terms")
    one = one.mapInArrow(search.weights([r["term"] for r in known], [r["idf"] for r in known], to_arrow_schema(out)), out)
    scale = texts.sparkSession.createDataFrame([tuple(r) for r in known], "term string, idf double")
    weighed = counted(terms.where("several")).join(F.broadcast(scale), "term").select("key", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return one.unionByName(weighed.join(norm, "key").select(F.col("key").alias(key), "term", (F.col("w") / F.col("norm")).alias("weight")))
