"""Entitlements, metering, tenancy, audit and idempotency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..scale import sequence_in_blocks


def entitlements(orgs: DataFrame, features: list[str] | None = None) -> DataFrame:
    """One row per organisation and feature with `entitled` from its plan; an unknown feature is open."""

    def allowed(name: str) -> Column:
        plans = fixed.FEATURES.get(name)
        ok = F.lit(True) if plans is None else F.coalesce(F.col("plan").isin(plans), F.lit(False))
        return F.struct(F.lit(name).alias("feature"), ok.alias("entitled"))

    names = list(fixed.FEATURES) if features is None else features
    return orgs.select("*", F.inline(F.array(*[allowed(n) for n in names])))


def plan_limit(plan: Column, key: Column) -> Column:
    """Daily limit of a usage key, null when the plan or the key has none."""
    limits = F.create_map(*[F.lit(x) for pair in fixed.FREE_LIMITS.items() for x in pair])
    paid = F.lower(F.coalesce(plan, F.lit("free"))).isin(fixed.UNLIMITED_PLANS)
    return F.when(~paid, F.element_at(limits, key))


def usage_metering(calls: DataFrame, plans: DataFrame) -> DataFrame:
    """Number of each call within its (org, key, UTC day), whether it is allowed, and what remains.

    Calls hold call_id, org_id, key, ts. Counting runs per minute block, so one busy organisation is no one-task day.
    """
    daily = calls.withColumn("day", F.to_date("ts"))
    minute = F.hour("ts") * 60 + F.minute("ts")
    numbered = sequence_in_blocks(daily, ["org_id", "key", "day"], ["ts", "call_id"], minute, number="n")
    joined = numbered.join(plans.select("org_id", "plan"), "org_id", "left")
    limit = plan_limit(F.col("plan"), F.col("key"))
    return joined.select(
        "call_id", "org_id", "key", "day", "n", (limit.isNull() | (F.col("n") <= limit)).alias("allowed"),
        F.greatest(F.lit(0).cast("bigint"), limit - F.col("n")).alias("_left"), limit.alias("_limit"),
    ).withColumn("remaining", F.when(F.col("_limit").isNotNull(), F.col("_left"))).drop("_left", "_limit")


def tenant_scope(df: DataFrame, memberships: DataFrame, user: str) -> DataFrame:
    """Rows of the organisations the user is a member of. Memberships hold user_id, org_id."""
    mine = memberships.filter(F.col("user_id") == user).select("org_id").distinct()
    return df.join(mine, "org_id", "left_semi")


def audit_export(events: DataFrame, org: str | int) -> DataFrame:
    """The organisation's events and the global ones, in time order."""
    return events.filter((F.col("org_id") == org) | F.col("org_id").isNull()).orderBy("created_at", "id")


def first_result_per_key(df: DataFrame) -> DataFrame:
    """Every request with the first stored result of its (org, idempotency key) and whether it is a replay."""
    first = df.groupBy("org_id", "idempotency_key").agg(
        F.min_by(F.struct(F.col("request_id").alias("first_request"), F.col("result").alias("first_result")),
                 F.struct("ts", "request_id")).alias("_f")
    )
    joined = df.join(first, ["org_id", "idempotency_key"])
    return joined.select(
        "request_id", "org_id", "idempotency_key", F.col("_f.first_result").alias("result"),
        (F.col("request_id") != F.col("_f.first_request")).alias("replay"),
    )
