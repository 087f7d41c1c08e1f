"""Streaming forms of ingest, follow alerts, metering and idempotent requests.

What has been seen lies in Spark's state store, one key per content or request, on RocksDB: a batch reads its own rows
and the state of their keys, never what earlier batches wrote. Running counts are bounded by a watermark. Every
batch writes its own folder in overwrite mode, and a replayed batch starts from the state before it, so it changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators import matter as M
from ..sources import records as R


#: The state store that keeps its keys on disk.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, folder: str, file_name: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Files of one name pattern in a folder as a stream, so many a batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_name)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def new_contents(stream: DataFrame) -> DataFrame:
    """Arrivals (source, record_id, payload) whose content has not come before for the record."""
    return stream.withColumn("content_hash", T.sha256("payload")).dropDuplicates(["source", "record_id", "content_hash"])


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> StreamingQuery:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(each).start()
    )


def ingest_stream(stream: DataFrame, store: str, checkpoint: str, at: str = "ts") -> StreamingQuery:
    """Append snapshots not yet stored to `store`, one folder per batch."""
    keys = StructType().add("source", "string").add("record_id", "string").add("content_hash", "string")

    def each(batch: DataFrame, batch_id: int) -> None:
        nothing = batch.sparkSession.createDataFrame([], keys)
        fresh = R.snapshot(batch.withColumnRenamed(at, "arrival").drop("content_hash"), nothing)
        fresh.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return _start(new_contents(stream), each, checkpoint, "append")


def follow_alert_stream(items: DataFrame, follows: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """One alert per follow and batch of new items (follow_key, reference, ts)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        M.follow_alerts(batch, follows).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return _start(items, each, checkpoint, "append")


def usage_counts(calls: DataFrame, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Calls per (org, key, UTC day). Late calls inside the watermark still count."""
    daily = calls.withWatermark(at, delay).groupBy(F.window(at, "1 day"), "org_id", "key").agg(F.count(F.lit(1)).alias("used"))
    return daily.select(F.to_date("window.start").alias("day"), "org_id", "key", "used")


def usage_stream(calls: DataFrame, store: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Running counts; the newest batch of a key holds its current count."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return _start(usage_counts(calls, delay=delay), each, checkpoint, "update")


def current_usage(spark: SparkSession, store: str) -> DataFrame:
    rows = spark.read.parquet(store)
    return rows.groupBy("day", "org_id", "key").agg(F.max_by("used", "batch").alias("used"))


def first_request_stream(requests: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """First request of every (org, idempotency key); replays are dropped, however late they come."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return _start(requests.dropDuplicates(["org_id", "idempotency_key"]), each, checkpoint, "append")
