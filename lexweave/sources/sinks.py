"""Files written for people: evaluation reports and audit exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Columns of the CSV export; the JSON export also has `detail`.
AUDIT_CSV = ["id", "org_id", "actor_user_id", "action", "resource_type", "resource_id", "created_at"]


def write_report(df: DataFrame, path: str, run: str) -> str:
    """Append one evaluation run as JSON under its stamp; the earliest run is the baseline."""
    target = f"{path}/run={run}"
    df.withColumn("run_stamp", F.lit(run)).write.mode("errorifexists").json(target)
    return target


def read_reports(spark, path: str) -> DataFrame:
    """All runs, with `is_baseline` on the earliest."""
    runs = spark.read.json(path)
    first = runs.agg(F.min("run_stamp")).scalar()
    return runs.withColumn("is_baseline", F.col("run_stamp") == first)


def write_audit(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Export in time order, as JSON with all columns or CSV without `detail`."""
    if fmt == "csv":
        df.select(*AUDIT_CSV).write.csv(path, header=True)
    else:
        df.write.json(path)
