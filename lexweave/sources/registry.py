"""Source registry: gates, seeding, dataset status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed

# What a missing registry field means, and the type of the known sources.
FLAGS = [
    "official_source", "primary_source", "commercial_reuse_allowed", "automated_access_allowed",
    "bulk_download_allowed", "api_available", "attribution_required", "adapter_enabled",
]
TEXTS = ["base_url", "licence", "licence_url", "notes"]
TYPE_BY_KEY = {
    "cyprus_open_data": "PORTAL", "cyprus_gazette": "GAZETTE", "cyprus_supreme_court": "JUDGMENT",
    "cylaw": "DATABASE", "eurlex": "LEGISLATION", "hudoc": "JUDGMENT",
}


def _true(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def source_gate(registry: DataFrame, commercial_mode: bool = False) -> DataFrame:
    """Adds `allowed` and the `reasons` against ingesting from each source."""
    approved = F.coalesce(F.col("reuse_status").isin(fixed.APPROVED_REUSE), F.lit(False))
    open_ = approved & _true("adapter_enabled") & (_true("bulk_download_allowed") | _true("api_available"))
    status = F.concat(
        F.lit("reuse_status="), F.coalesce("reuse_status", F.lit("UNKNOWN")), F.lit(", adapter_enabled="),
        _true("adapter_enabled").cast("string"),
    )
    clearance = F.lit("commercial_reuse_allowed=False (no recorded legal clearance for commercial resale)")
    reasons = F.array_compact(F.array(
        F.when(~open_, status),
        F.when(F.lit(commercial_mode) & ~_true("commercial_reuse_allowed"), clearance),
    ))
    return registry.withColumn("reasons", reasons).withColumn("allowed", F.size("reasons") == 0)


def merge_registry(current: DataFrame, seed: DataFrame) -> DataFrame:
    """Registry after seeding by name, with `outcome` created, updated, skipped or untouched per row.

    Null seed values take their defaults before they are compared. `seed` also holds `key`.
    """
    types = F.create_map(*[F.lit(x) for pair in TYPE_BY_KEY.items() for x in pair])
    filled = seed.select(
        F.trim("name").alias("name"),
        F.coalesce(F.nullif("source_type", F.lit("")), F.element_at(types, F.col("key")), F.lit("DATABASE")).alias("source_type"),
        F.coalesce("reuse_status", F.lit("UNKNOWN")).alias("reuse_status"),
        *[_true(c).alias(c) for c in FLAGS], *TEXTS,
    )
    fields = ["source_type", "reuse_status", *FLAGS, *TEXTS]
    new = filled.select("name", F.struct(*fields).alias("_new"))
    old = current.select("name", F.struct(*fields).alias("_old"))
    both = old.join(new, "name", "full_outer")
    outcome = (
        F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "untouched")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "skipped").otherwise("updated")
    )
    return both.select("name", outcome.alias("outcome"), F.coalesce("_new", "_old").alias("_r")).select("name", "outcome", "_r.*")


def merge_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("outcome").agg(F.count(F.lit(1)).alias("sources"))


def dataset_status(datasets: DataFrame, registry: DataFrame, records: DataFrame, commercial_mode: bool = False) -> DataFrame:
    """Status, reason and record count of each dataset.

    Datasets hold dataset_key, source, linked_on_external, commercial_reuse_allowed, download_url;
    records hold dataset_key and are counted before the join.
    """
    gate = source_gate(registry, commercial_mode).select(F.col("name").alias("source"), "allowed", "reasons")
    counts = records.groupBy("dataset_key").agg(F.count(F.lit(1)).alias("_n"))
    joined = datasets.join(gate, "source", "left").join(counts, "dataset_key", "left")
    external, cleared = _true("linked_on_external"), _true("commercial_reuse_allowed")
    no_url = F.coalesce(F.length("download_url"), F.lit(0)) == 0
    passed = F.coalesce("allowed", F.lit(False))
    status = (
        F.when(external, "BLOCKED_EXTERNAL").when(~cleared, "BLOCKED").when(no_url, "NOT_READY")
        .when(~passed, "BLOCKED").otherwise("INGESTED")
    )
    reason = (
        F.when(external, "substantive content lives on an external unverified host; metadata/link-out only")
        .when(~cleared, "commercial_reuse_allowed not confirmed")
        .when(no_url, "download_url not configured")
        .when(~passed, F.coalesce(F.array_join("reasons", "; "), F.lit("no source registry row")))
    )
    return joined.select(
        "dataset_key", status.alias("status"), reason.alias("reason"),
        F.when(status == "INGESTED", F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).alias("records"),
    )
