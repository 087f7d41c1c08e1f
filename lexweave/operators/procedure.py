"""Procedural rules, deadlines and the business calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed, text as T
from ..scale import first_per_key

REVIEW_REQUIRED = "REVIEW_REQUIRED"


def rule_versions(rules: DataFrame, order: str) -> DataFrame:
    """Numbered versions per rule key; a repeat of the same parameters makes none."""

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    body = F.concat_ws(
        "|", "rule_key", "calculate_mode", shown("base_days"), shown("day_of_month"), "direction",
        F.initcap(F.coalesce("ambiguous", F.lit(False)).cast("string")), "limit_type",
    )
    hashed = rules.withColumn("content_hash", T.sha256(body))
    distinct = first_per_key(hashed, ["rule_key", "content_hash"], [order])
    # Parameter sets per key are few: they are distinct by content.
    return distinct.withColumn("version_number", F.row_number().over(W.partitionBy("rule_key").orderBy(order)))


def is_holiday(day: Column, holidays: list[tuple[int, int]]) -> Column:
    return (F.month(day) * 100 + F.dayofmonth(day)).isin([m * 100 + d for m, d in holidays])


def business_calendar(bounds: DataFrame, holidays: list[tuple[int, int]] = fixed.HOLIDAYS) -> DataFrame:
    """Every day of the span in `bounds` (one row: first, last) with is_business and the running number of business days.

    A calendar has 366 rows a year whatever the data, so one ordered window is enough.
    """
    days = bounds.select(F.explode(F.sequence("first", "last")).alias("day"))
    open_ = (F.weekday("day") < 5) & ~is_holiday(F.col("day"), holidays)
    flagged = days.withColumn("is_business", open_)
    upto = W.orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    return flagged.withColumn("business_no", F.sum(F.col("is_business").cast("bigint")).over(upto))


def _span(business_days: Column, holidays: list[tuple[int, int]]) -> Column:
    """Calendar days that hold so many business days wherever they begin: a holiday costs at most one day a year."""
    yearly = len(set(holidays))
    share = 5 / 7 - yearly / 365
    if share < 0.01:
        raise ValueError(f"{yearly} holidays a year leave no business days to count")
    return F.ceil((business_days + 2 * yearly + 10) / share).cast("int")


def deadline_schedule(triggers: DataFrame, rules: DataFrame, holidays: list[tuple[int, int]] = fixed.HOLIDAYS) -> DataFrame:
    """Deadline of every trigger (trigger_id, rule_key, trigger_date) under its rule, with certainty and reason.

    Modes: calendar_days, business_days, day_of_month, last_day_month; an ambiguous rule or another mode needs review.
    Business days are numbered once in a calendar, so adding any number of them is two equi-joins.
    """
    joined = triggers.join(rules, "rule_key")
    reach = F.max(F.abs(F.coalesce("base_days", F.lit(0))))
    bounds = joined.filter("calculate_mode = 'business_days'").agg(
        F.min("trigger_date").alias("lo"), F.max("trigger_date").alias("hi"), reach.alias("n")
    ).filter("lo IS NOT NULL").withColumn("_span", _span(F.col("n"), holidays)).select(
        F.date_sub("lo", F.col("_span")).alias("first"), F.date_add("hi", F.col("_span")).alias("last")
    )
    calendar = business_calendar(bounds, holidays)
    start = calendar.select(
        F.col("day").alias("trigger_date"), F.col("business_no").alias("_no"), F.col("is_business").cast("bigint").alias("_open")
    )
    target = calendar.filter("is_business").select(F.col("business_no").alias("_want"), F.col("day").alias("_business"))

    t, mode = F.col("trigger_date"), F.col("calculate_mode")
    after = F.col("direction") == "after"
    days = F.coalesce("base_days", F.lit(0)).cast("int")
    step = F.when(after, days).otherwise(-days)
    want = F.when(step > 0, F.col("_no") + step).when(step < 0, F.col("_no") - F.col("_open") + step + 1)
    want = F.when(mode == "business_days", want)
    dated = joined.join(start, "trigger_date", "left").withColumn("_want", want).join(target, "_want", "left")

    calendar_day = F.date_add(t, step)
    business_day = F.when(step == 0, t).otherwise(F.col("_business"))
    day_no = F.when(F.coalesce("day_of_month", F.lit(0)) == 0, 1).otherwise(F.col("day_of_month")).cast("int")
    month = F.trunc(t, "MM")
    in_month = F.date_add(month, day_no - 1)
    next_month = F.add_months(month, 1)
    in_next = F.date_add(next_month, F.least(day_no, F.dayofmonth(F.last_day(next_month))) - 1)
    moves = ((in_month < t) | after) & (in_month <= t)
    month_day = F.when(moves, in_next).otherwise(in_month)
    month_end = F.when(after, F.last_day(t)).otherwise(F.last_day(F.add_months(month, -1)))

    unsure = F.coalesce("ambiguous", F.lit(False))
    found = (
        F.when(mode == "calendar_days", calendar_day).when(mode == "business_days", business_day)
        .when(mode == "day_of_month", month_day).when(mode == "last_day_month", month_end)
    )
    deadline = F.when(~unsure, found)
    known = mode.isin("calendar_days", "business_days", "day_of_month", "last_day_month")
    reason = (
        F.when(unsure, "Rule is ambiguous; review required before computing a deadline.")
        .when(~known, F.concat(F.lit("Unsupported calculate_mode '"), mode, F.lit("'")))
        .when(deadline.isNull(), "Could not compute a deterministic deadline from trigger.")
    )
    return dated.select(
        "trigger_id", "rule_key", "trigger_date", deadline.alias("deadline"),
        F.when(deadline.isNull(), REVIEW_REQUIRED).otherwise("DETERMINED").alias("certainty"), reason.alias("reason"),
        F.when(unsure | deadline.isNotNull(), F.coalesce("source_note", "law_ref")).otherwise(F.col("source_note")).alias("source"), "limit_type",
    )
