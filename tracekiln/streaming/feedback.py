"""The adaptive loop as a stream: problems arrive, the good pool grows between batches.

Every micro-batch reads a snapshot of the good pool, generates with examples out of
it, scores and appends what it made. With one problem a batch this is the strictly
sequential loop; larger batches see the pool as it was when they began.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tracekiln import schemas
from tracekiln.operators.pools import added, good
from tracekiln.operators.records import categorized, evaluated, preprocessed
from tracekiln.plans.generation import Backend, generated, prompted

FIELDS = ("trace", "raw_answer")


def snapshot(spark: SparkSession, pool_path: str, before: int) -> DataFrame:
    """The pool as earlier batches left it; empty before the first."""
    try:
        rows = spark.read.schema(schemas.POOL + ", batch long").parquet(pool_path)
    except AnalysisException:
        return spark.createDataFrame([], schemas.POOL)
    return rows.where(F.col("batch") < before).drop("batch")


def one_batch(problems: DataFrame, pool: DataFrame, backend: Backend, strategies: int = 16, examples: int = 3) -> DataFrame:
    """Pool rows made of one batch of problems (ordinal, question, answer); strategies in turn by ordinal."""
    best = good(pool, k=examples).select("position", "question", "trace", F.col("ground_truth").alias("raw_answer"))
    near = best.agg(F.array_sort(F.collect_list(F.struct("position", "question", *FIELDS))).alias("n"))
    near = near.select(F.when(F.size("n") > 0, F.transform("n", lambda e: F.struct(e["question"].alias("question"), *[e[f].alias(f) for f in FIELDS]))).alias("near"))
    ready = categorized(preprocessed(problems)).withColumnRenamed("ordinal", "original_index").withColumn("sid", F.pmod("original_index", F.lit(strategies)).cast("int"))
    near = ready.select("original_index").crossJoin(F.broadcast(near))  # one row
    made = evaluated(generated(prompted(ready, "sid", None, near, FIELDS), backend))
    rows = added(None, made.withColumn("ground_truth", F.col("raw_answer")), seq="original_index")
    have = {f.name: f.dataType for f in spark_schema(problems.sparkSession)}
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in have.items()])


def spark_schema(spark: SparkSession):
    return spark.createDataFrame([], schemas.POOL).schema


def run(problems: DataFrame, pool_path: str, checkpoint: str, backend: Backend, available_now: bool = True) -> StreamingQuery:
    """Starts the loop over a stream of problems; a batch that is run again replaces what it wrote."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = one_batch(batch, snapshot(spark, pool_path, batch_id), backend)
        rows.write.mode("overwrite").parquet(f"{pool_path}/batch={batch_id}")

    writer = problems.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of problem files (JSON lines) in the order in which they arrived."""
    return spark.readStream.schema(schemas.RAW_PROBLEM).option("maxFilesPerTrigger", files_per_batch).json(folder)
