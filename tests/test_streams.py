"""Streams over several micro-batches, with a restart and replays, against the batch form."""

import datetime as dt

from pyspark.sql import functions as F

from lexweave.sources import records as R
from lexweave.streaming import jobs

ARRIVAL = "source string, record_id string, payload string, ts timestamp"


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def arrivals(n, shift):
    """Some contents of earlier files come again, some days late."""
    day = dt.datetime(2024, 1, 1)
    return [("s", f"r{i % 7}", f"text {(i * shift) % 11}", day + dt.timedelta(days=(i * 37 + shift) % 90)) for i in range(n)]


def test_ingest_over_batches_restart_and_replay(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "checkpoint"))
    schema = spark.createDataFrame([], ARRIVAL).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
        query = jobs.ingest_stream(stream, store, checkpoint)
        query.awaitTermination()
        return query.lastProgress["batchId"] if query.lastProgress else None

    def stored():
        return sorted(tuple(r) for r in spark.read.parquet(store).select("source", "record_id", "content_hash").collect())

    def batch():
        every = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(source).withColumnRenamed("ts", "arrival")
        nothing = spark.createDataFrame([], "source string, record_id string, content_hash string")
        return sorted(tuple(r) for r in R.snapshot(every, nothing).select("source", "record_id", "content_hash").collect())

    for k in (1, 2, 3):
        written(spark, source, f"f{k}", arrivals(40, k), ARRIVAL)
    run()
    assert stored() == batch() and spark.read.parquet(store).select("batch").distinct().count() > 1
    before = stored()
    run()
    assert stored() == before
    written(spark, source, "f4", arrivals(60, 5), ARRIVAL)
    run()
    assert stored() == batch() and len(stored()) > len(before)


def test_first_request_over_batches(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "checkpoint"))
    kind = "request_id long, org_id long, idempotency_key string, ts timestamp"
    day = dt.datetime(2024, 1, 1)
    for k in range(3):
        rows = [(100 * k + i, i % 2, f"k{i % 9}", day + dt.timedelta(days=i)) for i in range(18)]
        written(spark, source, f"f{k}", rows, kind)
        stream = spark.readStream.schema(spark.createDataFrame([], kind).schema).option("recursiveFileLookup", "true").parquet(source)
        jobs.first_request_stream(stream, store, checkpoint).awaitTermination()
    got = spark.read.parquet(store)
    assert got.count() == 18 and got.agg(F.max("request_id")).first()[0] < 100
