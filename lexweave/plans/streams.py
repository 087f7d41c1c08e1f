"""Streaming jobs over the events table, run until all data is read, then compared with the batch result."""

from pyspark.sql import functions as F

from ..session import fresh_folder
from ..sources import sinks
from ..streaming import jobs
from .base import Source, query
from .documents import day
from .quality import ranked
from ..operators import evaluate as E


def events(src: Source):
    stream = jobs.table_stream(src.spark, src.sf_dir, "events.parquet", src.events.schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(src: Source, name: str, start) -> str:
    store = fresh_folder(src.spark, name)
    start(store, f"{store}-checkpoint").awaitTermination()
    return store


@query("ingest_stream", """
SELECT DISTINCT event_type AS source, CAST(user_id AS STRING) AS record_id, sha256(props) AS content_hash FROM {events}""")
def ingest_stream(src):
    arrivals = events(src).select(
        F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("record_id"), F.col("props").alias("payload"), "ts"
    )
    store = finished(src, "ingest", lambda s, c: jobs.ingest_stream(arrivals, s, c))
    return src.spark.read.parquet(store).select("source", "record_id", "content_hash")


@query("follow_alert_stream", """
SELECT DISTINCT org_id, follow_key FROM {follows} JOIN {new_items} USING (follow_key)""")
def follow_alert_stream(src):
    items = events(src).select(
        F.concat(F.lit("k"), (F.col("event_id") % 500).cast("string")).alias("follow_key"),
        F.concat(F.lit("ref-"), F.col("event_id").cast("string")).alias("reference"), "ts",
    )
    store = finished(src, "alerts", lambda s, c: jobs.follow_alert_stream(items, src.follows, s, c))
    return src.spark.read.parquet(store).select("org_id", "follow_key").distinct()


@query("usage_stream", """
SELECT strftime(ts, '%Y-%m-%d') AS day, org_id, key, count(*) AS used FROM {calls} GROUP BY ALL""")
def usage_stream(src):
    kind = F.col("event_type")
    calls = events(src).select(
        (F.col("user_id") % 9).alias("org_id"),
        F.when(kind.isin("view", "click"), "search_per_day").when(kind == "error", "matters").otherwise("other").alias("key"), "ts",
    )
    store = finished(src, "usage", lambda s, c: jobs.usage_stream(calls, s, c))
    return jobs.current_usage(src.spark, store).withColumn("day", day("day"))


@query("first_request_stream", "SELECT DISTINCT org_id, idempotency_key FROM {requests}")
def first_request_stream(src):
    requests = events(src).select(
        F.col("event_id").alias("request_id"), (F.col("user_id") % 4).alias("org_id"),
        F.concat(F.lit("key-"), (F.col("event_id") % 700).cast("string")).alias("idempotency_key"), "ts",
    )
    store = finished(src, "requests", lambda s, c: jobs.first_request_stream(requests, s, c))
    return src.spark.read.parquet(store).select("org_id", "idempotency_key")


@query("write_report", """
SELECT 'baseline' AS run_stamp, query_id, mrr, true AS is_baseline FROM {metrics}
UNION ALL SELECT 'report-2', query_id, mrr, false FROM {metrics}""")
def write_report(src):
    folder = fresh_folder(src.spark, "reports")
    metrics = E.ranking_metrics(src.asked.select("query_id"), ranked(src), src.gold.filter("quality = 1")).select("query_id", "mrr")
    sinks.write_report(metrics, folder, "baseline")
    sinks.write_report(metrics, folder, "report-2")
    return sinks.read_reports(src.spark, folder).select("run_stamp", "query_id", "mrr", "is_baseline")


@query("write_audit", """
SELECT id, org_id, action, CAST(created_at AS DATE)::STRING AS created_at FROM {audit_events} WHERE org_id = 5 OR org_id IS NULL""")
def write_audit(src):
    from ..operators.governance import audit_export

    folder = fresh_folder(src.spark, "audit")
    sinks.write_audit(audit_export(src.audit_events, 5), folder, "csv")
    schema = "id long, org_id long, actor_user_id long, action string, resource_type string, resource_id long, created_at timestamp"
    out = src.spark.read.csv(folder, header=True, schema=schema)
    return out.select("id", "org_id", "action", day("created_at").alias("created_at"))
