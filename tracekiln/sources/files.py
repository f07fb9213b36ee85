"""Reading problems and pools, writing selections, samples, configurations and pools."""

from __future__ import annotations

import re
import warnings
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tracekiln import schemas
from tracekiln.functions.quality import GOOD, MEDIUM, WEIGHTS
from tracekiln.plans.dims import STRATEGIES, strategies

POOL_NAMES = ("good", "medium", "bad")


def read_problems(spark: SparkSession, path: str, kind: str = "parquet", multi_line: bool = False) -> DataFrame:
    """Raw problems with their ordinal (E1), from Parquet, JSON lines or an indented JSON array."""
    reader = spark.read.schema(schemas.RAW_PROBLEM)
    return reader.parquet(path) if kind == "parquet" else reader.option("multiLine", multi_line).json(path)


def write_json(df: DataFrame, path: str, files: int | None = None) -> None:
    """JSON lines; the folder is made or replaced."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_examples(chosen: DataFrame, path: str) -> None:
    """One document: a map of strategy number to its examples in order, with an empty list for those without."""
    columns = [c for c in chosen.columns if c not in ("strategy_id", "position", "rank", "is_reuse", "embedding")]
    lists = chosen.groupBy("strategy_id").agg(F.array_sort(F.collect_list(F.struct("position", *columns))).alias("items"))  # 280 rows at most
    every = strategies(chosen.sparkSession).select("strategy_id").join(lists, "strategy_id", "left")
    item = F.transform("items", lambda e: F.struct(*[e[c].alias(c) for c in columns]))
    entry = F.struct(F.col("strategy_id").cast("string").alias("key"), F.coalesce(item, F.array()).alias("value"))
    whole = every.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """The examples of ``write_examples``: strategy_id, position and the example's columns."""
    kind = f"map<string, array<struct<{_struct(schemas.SCORED)}>>>"
    maps = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    lists = maps.select(F.explode("m").alias("strategy_id", "items"))
    return lists.select(F.col("strategy_id").cast("int"), F.posexplode("items").alias("position", "e")).select("strategy_id", "position", "e.*")


def _struct(ddl: str) -> str:
    """Fields of a declared schema as they are written inside struct<...>."""
    return re.sub(r"(^|, )(\w+) (?=\w)", r"\1\2: ", ddl)


def run_config(spark: SparkSession, pool_size: int, pilot_size: int, total_remaining: int) -> DataFrame:
    """The configuration of a run as one row."""
    names = {str(i): n for i, (n, _) in enumerate(STRATEGIES)}
    needs = {str(i): k for i, (_, k) in enumerate(STRATEGIES)}
    row = (pool_size, pilot_size, total_remaining, len(STRATEGIES), names, needs, f"REx = {WEIGHTS[0]}·V + {WEIGHTS[1]}·E + {WEIGHTS[2]}·R", float(GOOD), float(MEDIUM))
    return spark.createDataFrame([row], schemas.RUN_CONFIG)


def run_tag(prefix: str = "", now: datetime | None = None) -> str:
    stamp = (now or datetime.now(UTC)).strftime("%Y%m%d_%H%M%S")
    return f"{prefix}_{stamp}" if prefix else stamp


def save_pool(pool: DataFrame, folder: str, prefix: str = "", now: datetime | None = None, kind: str = "parquet") -> str:
    """Writes the pool table partitioned by pool under a folder named by the run; its path."""
    path = f"{folder.rstrip('/')}/pool_{run_tag(prefix, now)}"
    pool.write.mode("overwrite").partitionBy("pool").format(kind).save(path)
    return path


def warn_if_missing(fault: AnalysisException, path: str) -> None:
    """Raises faults other than a missing path."""
    if fault.getCondition() != "PATH_NOT_FOUND":
        raise fault
    warnings.warn(f"no pool at {path}: it is taken for empty", stacklevel=3)


def load_pool(spark: SparkSession, path: str, kind: str = "parquet", pools: tuple[str, ...] = POOL_NAMES) -> DataFrame:
    """The pools of ``save_pool``; a missing path is an empty pool, with a warning. Other faults are raised."""
    try:
        rows = spark.read.schema(schemas.POOL).format(kind).load(path)
        rows.schema  # noqa: B018  the path is looked up here
    except AnalysisException as e:
        warn_if_missing(e, path)
        return spark.createDataFrame([], schemas.POOL)
    return rows.where(F.col("pool").isin(*pools))


def load_pool_arrays(spark: SparkSession, good: str, medium: str | None = None, bad: str | None = None) -> DataFrame:
    """Pools from three files that each hold an indented JSON array; the place in its file is ``seq``."""
    out = spark.createDataFrame([], schemas.POOL)
    for name, path in (("good", good), ("medium", medium), ("bad", bad)):
        if path is None:
            continue
        try:
            whole = spark.read.text(path, wholetext=True)
        except AnalysisException as e:
            warn_if_missing(e, path)
            continue
        body = ", ".join(p for p in _struct(schemas.POOL).split(", ") if not p.startswith(("pool:", "seq:")))
        rows = whole.select(F.posexplode(F.from_json("value", f"array<struct<{body}>>")).alias("seq", "e")).select(F.lit(name).alias("pool"), F.col("seq").cast("long"), "e.*")
        out = out.unionByName(rows, allowMissingColumns=True)
    return out
