"""Exact dedup as a stream with disk-backed keyed state, with DataFrame operations only."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.bitmap import marks, maybe
from shelfcast.llm.common import text_of, without_spaces
from shelfcast.session import pin, work_folder

#: State lives in RocksDB on the executors' disks, with changes logged to the shared folder, and never expires. Disk is
#: not reserved ahead, which would cost some MB for each of many small partitions.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def keyed(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """(digest, first, normal): the digest of the normalised text, what orders a group, and the normalised text.

    ``first`` is smallest for the row that stays: longest original text, smallest doc_id (null last), then the
    content locator (file and row number), which also tells repeated rows apart.
    """
    text = text_of()
    first = F.struct(
        (-F.length(text)).alias("shorter"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("doc_id"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"),
    )
    return rows.select(digest(without_spaces(text)).alias("digest"), first.alias("first"), without_spaces(text).alias("normal"))


def run_state(spark: SparkSession, path: str, state: str, digest: Callable[[Column], Column] = sha256, batch_bytes: int = 64 << 30) -> None:
    """Feed all files of ``path`` that the stream at ``state`` has not seen yet into its keyed state.

    The state holds one entry per digest: the row that stays so far (identifier and locator) and the number of rows.
    Copies are combined before the shuffle, so a digest with a third of all rows costs one entry per task. A run that
    dies resumes from the last batch.
    """
    own = spark.newSession()
    for k, v in (STATE | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}).items():
        own.conf.set(k, v)
    schema = spark.read.parquet(path).schema
    # A path with a pattern may be a file or a folder.
    pattern = re.sub(r"(.)$", r"[\1]", path.rstrip("/"))
    stream = own.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(pattern)
    entries = keyed(stream, digest).groupBy("digest").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
    query = (
        entries.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """The stream's state as a table: (digest, best, n)."""
    return spark.read.format("statestore").load(state).select(
        F.col("key.digest").alias("digest"), F.col("value.min").alias("best"), F.col("value.count").alias("n")
    )


def deduplicate(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """One row per document of the Parquet table at ``path``: (doc_id, keep_id, group_size, kept, digest).

    Texts are equal when they are the same bytes after white space is deleted. Of equal texts the row with the most
    code points in the original text stays, then the smallest doc_id, then the first in the files. A digest that occurs
    more than once is a hit: the full normalised bytes of every hit are compared with those of the row that stays; rows
    that only share the digest are grouped again by their bytes, so a weak digest costs time, not correctness.

    Null texts count as empty and are equal to each other. A null doc_id comes last in its group and may be the keep_id
    only of a group without any other. Repeated rows are copies like any others. An empty table gives no rows. Other
    columns are not read. ``state`` names the folder of a stream to go on with; without it a new one is made in the
    shared folder.
    """
    state = state or os.path.join(work_folder(spark), f"exact-{uuid.uuid4().hex}")
    schema_only = spark.read.parquet(path)
    if schema_only.isEmpty():
        empty = schema_only.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"))
        return empty.withColumn("digest", F.lit(""))
    run_state(spark, path, state, digest)
    entries = pin(read_state(spark, state), "exact-state")
    rows = keyed(schema_only, digest)

    # Only rows whose digest may occur more than once carry their bytes into the shuffle.
    several = entries.where("n > 1")
    known = marks(several.select(F.xxhash64("digest").alias("mark")), "mark")
    sifted = maybe(rows.withColumn("mark", F.xxhash64("digest")), "mark", known)
    hits = pin(sifted.join(several, "digest").select("digest", "first", "normal", "best"), "exact-hits")
    stays = hits.where(F.col("first") == F.col("best")).select("digest", F.col("normal").alias("stays"))
    differ = hits.join(stays, "digest").where(F.col("normal") != F.col("stays")).select("digest", "first", "normal")

    grouped = rows.select("digest", "first").join(entries, "digest")
    if not differ.isEmpty():
        differ = pin(differ, "exact-differ")
        again = differ.groupBy("digest", "normal").agg(F.min("first").alias("best2"), F.count(F.lit(1)).alias("n2"))
        moved = differ.join(again, ["digest", "normal"]).select("digest", "first", "best2", "n2")
        lost = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
        grouped = (
            grouped.join(lost, "digest", "left").join(moved, ["digest", "first"], "left")
            .withColumn("n", F.coalesce("n2", F.col("n") - F.coalesce("lost", F.lit(0)))).withColumn("best", F.coalesce("best2", "best"))
        )
    return grouped.select(
        F.col("first.doc_id").alias("doc_id"), F.col("best.doc_id").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
        (F.col("first") == F.col("best")).alias("kept"), "digest",
    )
