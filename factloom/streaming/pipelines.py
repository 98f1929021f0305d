"""Streams (R01-R05): uploads, subscriptions, audit windows, versions, activity.

Every stream here gives, once its input is drained, what the batch operator gives on the same
rows; the tests hold the two against each other.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.operators import lifecycle


def table_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Rows of a growing folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Counts per kind and window; events later than the watermark are dropped, in a stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = rows.groupBy("event_type", window.alias("w")).agg(F.count("*").alias("n"))
    return out.select("event_type", F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Stretches of a user's events without a longer pause."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy("user_id", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def activity(facts: DataFrame, size: str = "7 days", late: str = "30 days", time: str = "extracted_at") -> DataFrame:
    """How many facts were extracted in each stretch of time, and the last of them; later facts
    than the watermark are dropped, in a stream."""
    rows = facts.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = rows.groupBy(F.window(time, size).alias("w")).agg(F.count("*").alias("facts"), F.max(time).alias("last_extracted"))
    return out.select(F.col("w.start").alias("start"), "facts", "last_extracted")


def first_seen(uploads: DataFrame, late: str = "1 day", time: str = "ts", key: str = "doc_id") -> DataFrame:
    """Each document once while the watermark remembers it."""
    return uploads.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if uploads.isStreaming else uploads.dropDuplicates([key])


def new_hits(hits: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """A stream of (query, doc_id, at) against the subscriptions."""
    return hits.join(subscriptions, "query").filter(F.col("at") > F.col("last_seen")).select("user", "query", "doc_id", "at")


def _fs(spark: SparkSession, path: str):
    """(file system, Hadoop path) of a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, where = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that `upsert_into` has finished, oldest first: those with a list of parts."""
    return sorted(int(n[6:-5]) for n in _listed(spark, path) if n.startswith("parts-") and n.endswith(".json"))


def _parts_of(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """Bucket -> version of its last folder, as a version left them."""
    text = spark.read.text(f"{path}/parts-{version:012d}.json", wholetext=True).first().value
    return {int(bucket): v for bucket, v in json.loads(text).items()}


def _folder_of(path: str, bucket: int, version: int) -> str:
    return f"{path}/v={version}/bucket={bucket}"


def current_parts(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """Bucket -> folder of its last version (before a version, if one is given): one listing and one
    small file, however many versions there are."""
    known = [v for v in versions(spark, path) if before is None or v < before]
    return {b: _folder_of(path, b, v) for b, v in (_parts_of(spark, path, known[-1]) if known else {}).items()}


def _finish(spark: SparkSession, path: str, number: int, known: dict[int, int]) -> None:
    """Put the list of parts of a version in its place, whole or not at all."""
    made = {int(n[7:]): number for n in _listed(spark, f"{path}/v={number}") if n.startswith("bucket=")}
    fs, draft = _fs(spark, f"{path}/_parts-{number:012d}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(known | made).encode()))
    out.close()
    _, place = _fs(spark, f"{path}/parts-{number:012d}.json")
    fs.delete(place, False)
    fs.rename(draft, place)


def current(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The keyed table as it stands."""
    parts = sorted(current_parts(spark, path).values())
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def upsert_into(path: str, keys: list[str], order: list[str], buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that keeps a keyed table. Rows lie in buckets by their keys; a batch
    reads and writes the buckets that its keys fall into, as version `v=number`, and leaves the
    others where they are. A batch that runs again reads the versions before its own, so it writes
    what it wrote before. `superseded` tells which folders no reader needs any more."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        batch = batch.persist()
        try:
            touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]
            done = [v for v in versions(spark, path) if v < number]
            known = _parts_of(spark, path, done[-1]) if done else {}
            before = [_folder_of(path, b, known[b]) for b in touched if b in known]
            new = lifecycle.keep_last(batch, keys, order)
            if before:
                new = lifecycle.upserted(spark.read.schema(batch.schema).parquet(*before), batch, keys, order)
            new.withColumn("bucket", bucket).write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/v={number}")
            _finish(spark, path, number, known)
        finally:
            batch.unpersist()

    return write


def superseded(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Folders of buckets that a later version replaces, the last `keep` versions left alone: a
    batch may still be run again."""
    every = versions(spark, path)
    used = set(current_parts(spark, path).values())
    old = every[: len(every) - keep] if keep else every
    return [f"{path}/v={v}/{n}" for v in old for n in _listed(spark, f"{path}/v={v}") if n.startswith("bucket=") and f"{path}/v={v}/{n}" not in used]


def drain(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, name: str | None = None, mode: str = "append") -> None:
    """Run a stream over what is there, and stop."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    query = writer.foreachBatch(sink).start() if sink else writer.format("memory").queryName(name).start()
    query.awaitTermination()
