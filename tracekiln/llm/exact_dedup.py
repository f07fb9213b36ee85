"""Operator 2 [native]: stateful streaming exact deduplication.

A narrow fingerprint log (digest, sizes, identifier, content locator) is written
to the shared folder and read as a stream. A streaming aggregation keyed by
digest, without watermark and so without expiry, keeps in a disk-backed state
store for each digest the identifier and locator of the row that stays and how
many rows were seen. Digests that were hit more than once then have their full
bytes compared; should two texts ever share a digest, their rows are decided by
the texts themselves.

Defined cases: a null text is the empty text, and all empty texts are equal. Of
equal texts the one with most code points stays, then the smallest ``doc_id``; a
null ``doc_id`` loses such a tie. Rows repeated with the same ``doc_id`` count
in ``group_size`` each, and exactly one row of a group has ``kept``. An empty
table gives no rows. Other columns of the input are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracekiln.llm.common import SPACE, dropped_folder, freed, shared_path, stored, text_or_empty

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each state store takes megabytes of disk in advance
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # else each partition's store stays open in its executor for a minute and more
    "spark.sql.streaming.metricsEnabled": "false",
}

#: Bits of the table that tells which digests were hit (8 MB).
BITS = 1 << 26
#: A group is large above HOT_LEAST rows, and above the HOT_MOST-th part of all rows: there are fewer than HOT_MOST such.
HOT_LEAST, HOT_MOST = 256, 10_000


def normalised(text: str | Column = "text") -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(text_or_empty(text), SPACE, "")


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def fingerprints(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One narrow row a document; ``row_id`` tells repeated rows apart once this is written."""
    norm = normalised(docs["text"])
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        digest(norm).alias("digest"),
        F.length(text_or_empty(docs["text"])).cast("long").alias("n_points"),
        F.monotonically_increasing_id().alias("row_id"),
        F.input_file_name().alias("locator"),
    )


def keyed_state(spark: SparkSession, log_path: str, log: DataFrame, state_path: str, out_path: str) -> DataFrame:
    """Streams the fingerprint log through the keyed state; the latest state of each digest.

    ``state_path`` may be kept and given again with more log files: groups then go on
    from where they were, since the state never expires.
    """
    own = spark.newSession()  # so that other queries of the session do not see these settings
    for k, v in {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"), **STATE}.items():
        own.conf.set(k, v)
    state = (
        own.readStream.schema(log.schema)
        .parquet(log_path)
        .groupBy("digest")
        .agg(
            # ~x falls as x rises and never overflows: the largest struct has the smallest identifier.
            F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("not_doc"), F.bitwise_not("row_id").alias("not_row"), "locator")).alias("best"),
            F.count(F.lit(1)).alias("group_size"),
        )
    )

    def save(part: DataFrame, batch: int) -> None:
        part.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out_path}/part={batch}")

    stream = state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", state_path).trigger(availableNow=True).start()
    stream.awaitTermination()
    kind = "digest string, best struct<n_points: bigint, not_doc: bigint, not_row: bigint, locator: string>, group_size bigint, batch bigint, part int"
    newest = spark.read.schema(kind).parquet(out_path).groupBy("digest").agg(F.max(F.struct("batch", "best", "group_size")).alias("last"))
    return newest.select(
        "digest",
        F.bitwise_not(F.col("last.best.not_doc")).alias("keep_id"),
        F.bitwise_not(F.col("last.best.not_row")).alias("keep_row"),
        F.col("last.best.locator").alias("keep_locator"),
        F.col("last.group_size").alias("group_size"),
    )


def hit_bits(groups: DataFrame) -> DataFrame:
    """The digests that were hit more than once, as a table of BITS bits: rows (bucket, bits) of 4 KB each.

    It has BITS / 32,768 rows at most, 8 MB, however many digests there are.
    """
    at = _bit(F.col("digest"))
    return groups.where("group_size > 1").groupBy(F.shiftright(at, 15).alias("bucket")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits"))


def _bit(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(BITS))


def colliding(docs: DataFrame, groups: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests that stand for more than one text, found on the full bytes of every hit.

    Texts that no other row can equal are left behind by a table of bits before
    anything is shuffled; where bits are shared, a text is compared in vain. Copies
    meet in the map-side half of the first aggregation, so a large group is one row
    a task when its texts are shuffled.
    """
    norm = normalised(docs["text"])
    texts = docs.select(digest(norm).alias("digest"), norm.alias("norm")).withColumn("at", _bit(F.col("digest")))
    texts = texts.withColumn("bucket", F.shiftright("at", 15)).join(F.broadcast(hit_bits(groups)), "bucket")  # 8 MB at most
    octet = F.conv(F.hex(F.substring("bits", F.shiftright(F.col("at").bitwiseAND(F.lit(32767)), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = octet.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("at").bitwiseAND(F.lit(7)).cast("int"))) != 0
    same = texts.where(hit).groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
    return same.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts")).where("n_texts > 1").select("digest")


def with_group(members: DataFrame, groups: DataFrame) -> DataFrame:
    """``members`` with what was decided for their digest.

    Groups above the limit, HOT_MOST at most by its choice, are sent to all tasks, so
    that their rows stay where they are; the others meet theirs by digest, and no
    digest brings more rows to a task than the limit.
    """
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    limit = max(HOT_LEAST, -(-total // HOT_MOST))
    large = F.broadcast(groups.where(F.col("group_size") > limit))
    rest = members.join(large.select("digest"), "digest", "left_anti")
    return members.join(large, "digest").unionByName(rest.join(groups.where(F.col("group_size") <= limit), "digest"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256, keep_locator."""
    spark = docs.sparkSession
    log_path, state_path, out_path = (shared_path(spark, f"dedup-{x}") for x in ("log", "state", "groups"))
    narrow = fingerprints(docs, digest)
    narrow.write.parquet(log_path)
    log = spark.read.schema(narrow.schema).parquet(log_path)
    if not spark.read.schema(narrow.schema).parquet(log_path).take(1):
        # A stream over no rows starts no batch.
        empty = log.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"), F.col("locator").alias("keep_locator"))
        return empty.where("false")
    groups = stored(keyed_state(spark, log_path, log, state_path, out_path), "dedup-latest")
    dropped_folder(spark, state_path)
    dropped_folder(spark, out_path)
    bad = stored(colliding(docs, groups, digest), "dedup-collisions")

    def rows(members: DataFrame, decided: DataFrame) -> DataFrame:
        return with_group(members, decided).select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("row_id") == F.col("keep_row")).alias("kept"),
            F.col("digest").alias("text_sha256"),
            "keep_locator",
        )

    if not bad.take(1):
        out = rows(log, groups)
        log._tracekiln_path = log_path
        out._tracekiln_sources = [log, groups, bad]
        return out
    # Different texts under one digest: these are decided by their bytes.
    by_text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), normalised(docs["text"]).alias("norm"), F.length(text_or_empty(docs["text"])).cast("long").alias("n_points"), F.input_file_name().alias("locator"))
    by_text = by_text.withColumn("digest", digest(F.col("norm"))).join(bad, "digest", "left_semi").withColumn("row_id", F.monotonically_increasing_id())
    by_text = stored(by_text, "dedup-by-text")
    decided = by_text.groupBy("norm").agg(F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("a"), F.bitwise_not("row_id").alias("b"), "locator")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    decided = decided.select("norm", F.bitwise_not(F.col("best.a")).alias("keep_id"), F.bitwise_not(F.col("best.b")).alias("keep_row"), F.col("best.locator").alias("keep_locator"), "group_size")
    split = by_text.join(decided, "norm").select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), sha256(F.col("norm")).alias("text_sha256"), "keep_locator")
    return rows(log.join(bad, "digest", "left_anti"), groups).unionByName(split)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; of rows repeated whole, one stays.

    Rows are matched by ``doc_id`` and digest, so that an identifier given to different
    texts does no harm.
    """
    groups = exact_groups(docs)
    found = stored(groups.select("doc_id", "text_sha256", "kept"), "dedup-members")
    sources = getattr(groups, "_tracekiln_sources", [])
    del groups
    freed(docs.sparkSession, *sources)
    key = sha256(normalised(docs["text"]))

    def of(rows: DataFrame, how: str) -> DataFrame:
        rows = rows.select(F.col("doc_id").alias("tracekiln_id"), F.col("text_sha256").alias("tracekiln_digest"))
        return docs.join(rows, docs["doc_id"].cast("long").eqNullSafe(rows["tracekiln_id"]) & (key == rows["tracekiln_digest"]), how)

    counts = found.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).where("kept")
    counts = stored(counts, "dedup-stays")
    freed(docs.sparkSession, found)
    once = of(counts.where("n = 1"), "left_semi")
    if not counts.where("n > 1").take(1):
        return once
    again = of(counts.where("n > 1"), "left_semi").withColumn("tracekiln_digest", sha256(normalised("text")))
    return once.unionByName(again.dropDuplicates(["doc_id", "tracekiln_digest"]).drop("tracekiln_digest"))
