"""One table of pools (good, medium, bad): adding, moving, retrieving, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracekiln.operators.records import settled

POOLS = ("good", "medium", "bad")


def pool_of(category: Column) -> Column:
    """good, medium, and bad for anything else."""
    return F.when(category.isin("good", "medium"), category).otherwise(F.lit("bad"))


def added(pool: DataFrame | None, rows: DataFrame, category: str = "category", seq: str = "seq") -> DataFrame:
    """The pool with more rows, each in the pool that its category names; columns that one side lacks are null.

    A filter on ``pool`` stays above the rows that it was made with, so that a category is worked out once.
    """
    new = settled(rows, pool=pool_of(F.col(category))).withColumn("seq", F.col(seq).cast("long"))
    return new if pool is None else pool.unionByName(new, allowMissingColumns=True)


def moved_to_good(pool: DataFrame, rows: DataFrame) -> DataFrame:
    """Appends rows to the good pool; where they came from is left as it is."""
    return pool.unionByName(rows.withColumn("pool", F.lit("good")), allowMissingColumns=True)


def view(pool: DataFrame, name: str) -> DataFrame:
    """One pool; on a table partitioned by pool this prunes the others."""
    return pool.where(F.col("pool") == name)


def replaced(pool: DataFrame, name: str, rows: DataFrame) -> DataFrame:
    """The pool table with one pool's rows exchanged. The good pool only grows."""
    if name == "good":
        raise ValueError("rows of the good pool are not exchanged")
    return pool.where(F.col("pool") != name).unionByName(rows.withColumn("pool", F.lit(name)), allowMissingColumns=True)


def score(pool: DataFrame, columns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.col(c).cast("double") for c in columns if c in pool.columns], F.lit(0.0))


def good(pool: DataFrame, k: int = 5, category_type: str | None = None, strategy: str = "top_score", by: tuple[str, ...] = ("rex_score",), seed: int = 42) -> DataFrame:
    """k examples of the good pool, with their place in the order (``position``, from 0).

    ``top_score``: by score, earlier rows first; ``diverse``: the best of each topic
    first; ``random``: a seeded sample. A given topic is preferred, not required. ``by``
    are the columns of the score, the first that is not null; ("hybrid_score",
    "quality_score") is the literal behaviour of pools whose rows carry those.
    """
    own = view(pool, "good")
    if strategy == "random":
        picked = own.withColumn("__h", F.md5(F.concat_ws("|", F.col("seq").cast("string"), F.lit(str(seed))))).orderBy("__h", "seq").limit(k)
        return picked.withColumn("position", F.row_number().over(W.orderBy("__h", "seq")) - 1).drop("__h")
    if strategy not in ("top_score", "diverse"):
        raise ValueError(f"no such strategy: {strategy}")
    keys = [F.desc(score(own, by)), F.col("seq").asc()]
    if category_type is not None:
        keys = [F.desc(F.coalesce(F.col("category_type") == category_type, F.lit(False))), *keys]
    if strategy == "diverse":
        # Only the best k of a topic can be among the first k.
        own = own.withColumn("__rn", F.row_number().over(W.partitionBy(F.coalesce("category_type", F.lit("other"))).orderBy(*keys))).where(F.col("__rn") <= k)
        keys = [(F.col("__rn") > 1).asc(), *keys]
    return own.orderBy(*keys).limit(k).withColumn("position", F.row_number().over(W.orderBy(*keys)) - 1).drop("__rn")


def stats(pool: DataFrame, by: tuple[str, ...] = ("rex_score",)) -> DataFrame:
    """One row: counts, percentages, the good pool's mean score and its counts by topic.

    The pool is read once, into a row for each pool and topic; these few are added up.
    """
    rows = pool.select("pool", F.coalesce("category_type", F.lit("unknown")).alias("category_type"), score(pool, by).alias("s"))
    each = rows.groupBy("pool", "category_type").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"))
    of = lambda p, c: F.coalesce(F.sum(F.when(F.col("pool") == p, F.col(c))), F.lit(0))
    n = {p: of(p, "n") for p in POOLS}
    total = F.coalesce(F.sum("n"), F.lit(0))
    pct = lambda c: F.when(total > 0, F.round(100 * c / F.greatest(total, F.lit(1)), 1)).otherwise(F.lit(0.0))
    mean = F.when(n["good"] > 0, of("good", "s") / F.greatest(n["good"], F.lit(1)))
    topics = F.collect_list(F.when(F.col("pool") == "good", F.struct("category_type", "n")))
    return each.agg(
        total.alias("total"),
        *[c.alias(p) for p, c in n.items()],
        *[pct(c).alias(f"{p}_pct") for p, c in n.items()],
        F.coalesce(F.round(mean, 4), F.lit(0.0)).alias("avg_good_score"),
        F.map_from_entries(F.array_sort(topics)).alias("good_by_category"),
    )


def good_by_category(pool: DataFrame) -> DataFrame:
    return view(pool, "good").groupBy(F.coalesce("category_type", F.lit("unknown")).alias("category_type")).agg(F.count(F.lit(1)).alias("n"))


def summary(pool: DataFrame) -> DataFrame:
    """Topics of the good pool by count, largest first."""
    return good_by_category(pool).orderBy(F.desc("n"), "category_type")
