"""What the corpus operators share: table paths, the shared folder, Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A temporary folder is used only when the setting is absent and the master is
    a single local process, as in tests.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = getattr(context, "_tracekiln_shared", None)
    if folder is None:
        folder = context._tracekiln_shared = "file://" + tempfile.mkdtemp(prefix="tracekiln-")
        context.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tracekiln_path = path
    return out


def freed(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote for frames that nothing reads any more."""
    for df in frames:
        dropped_folder(spark, df._tracekiln_path)


def dropped_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Bytes of a batch that tasks send to Python workers. Rows alone, 10,000 by default, bound little where texts are long.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets the session's Arrow batches hold BATCH_BYTES; stays set. It bounds memory only, no result depends on it.

    A limit that is smaller, or written with a unit, was chosen by the user and stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")
    if now.lstrip("-").isdigit() and not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


Batches = Iterator[pa.RecordBatch]
#: Cached functions whose results are large.
_LARGE: list[Callable] = []


def large_cache(make: Callable) -> Callable:
    """``functools.cache`` whose entries a worker drops when it turns to a task that does not use them."""
    cached = functools.cache(make)
    _LARGE.append(cached)
    return cached


def _dropped(uses: tuple[Callable, ...]) -> None:
    for cached in _LARGE:
        if cached not in uses:
            cached.cache_clear()


def trimmed(run: Callable[[Batches], Batches], *uses: Callable) -> Callable[[Batches], Batches]:
    """``run``, before which large caches but ``uses`` are dropped, and after which unused memory goes back to the system.

    Workers outlive their tasks, and the allocators of Arrow and of C keep what was freed.
    """

    def whole(source: Batches) -> Batches:
        _dropped(uses)
        yield from run(source)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return whole


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def batches(source: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = 400_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about ``most_bytes`` bytes, one row at least."""
    for batch in source:
        if not batch.num_rows:
            continue
        sizes = batch.column(text).cast(pa.large_string()).cast(pa.large_binary())
        ends = np.cumsum([0 if x is None else x for x in pa.compute.binary_length(sizes).to_pylist()])
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
