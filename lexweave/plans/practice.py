"""Deadlines, entitlements, metering and audit."""

from pyspark.sql import functions as F

from ..operators import governance as V, procedure as P
from .base import INPUTS, ORACLE_PARTS, query
from .documents import day

# Rules: a part is a rule, its size the days or the day of the month.
INPUTS["rules"] = """
SELECT CAST(p_partkey AS STRING) AS rule_key, CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'calendar_days' WHEN 1 THEN 'business_days' WHEN 2 THEN 'day_of_month'
    WHEN 3 THEN 'last_day_month' ELSE 'lunar' END AS calculate_mode,
  p_size - 1 AS base_days, CASE WHEN p_size > 40 THEN NULL ELSE p_size % 32 END AS day_of_month, CASE WHEN p_size % 3 = 0 THEN 'before' ELSE 'after' END AS direction,
  p_size = 13 AS ambiguous, 'maximum' AS limit_type, CASE WHEN p_size % 2 = 0 THEN p_name ELSE NULL END AS source_note, concat('law-', p_brand) AS law_ref, p_partkey AS arrival
FROM {part}
"""
INPUTS["triggers"] = """
SELECT DISTINCT l_orderkey * 8 + l_linenumber AS trigger_id, CAST(l_partkey AS STRING) AS rule_key, CAST(l_shipdate AS DATE) AS trigger_date FROM {lineitem}
"""
INPUTS["rule_arrivals"] = """
SELECT p_brand AS rule_key, 'calendar_days' AS calculate_mode, p_size AS base_days, CASE WHEN p_size % 2 = 0 THEN NULL ELSE 5 END AS day_of_month, 'after' AS direction,
  p_size % 5 = 0 AS ambiguous, p_type AS limit_type, p_partkey AS arrival FROM {part}
"""


@query("rule_versions", """
SELECT rule_key, arrival, content_hash, row_number() OVER (PARTITION BY rule_key ORDER BY arrival) AS version_number FROM (
  SELECT rule_key, content_hash, min(arrival) AS arrival FROM (SELECT rule_key, arrival, sha256(concat(rule_key, '|calendar_days|', base_days, '|', coalesce(CAST(day_of_month AS STRING), 'None'), '|after|',
    CASE WHEN ambiguous THEN 'True' ELSE 'False' END, '|', limit_type)) AS content_hash FROM {rule_arrivals}) GROUP BY ALL)""")
def rule_versions(src):
    return P.rule_versions(src.rule_arrivals, "arrival").select("rule_key", "arrival", "content_hash", "version_number")


ORACLE_PARTS["calendar"] = """
SELECT day, open, sum(CASE WHEN open THEN 1 ELSE 0 END) OVER (ORDER BY day) AS no FROM (
  SELECT CAST(d AS DATE) AS day, isodow(d) < 6 AND strftime(d, '%m-%d') NOT IN ('01-01', '01-06', '03-25', '12-25', '12-26') AS open
  FROM generate_series(TIMESTAMP '1990-01-01', TIMESTAMP '2006-12-31', INTERVAL 1 DAY) t(d))
"""


@query("deadline_schedule", """
SELECT trigger_id, rule_key, CASE WHEN deadline IS NULL THEN 'REVIEW_REQUIRED' ELSE 'DETERMINED' END AS certainty, strftime(deadline, '%Y-%m-%d') AS deadline,
  CASE WHEN ambiguous THEN 'Rule is ambiguous; review required before computing a deadline.' WHEN calculate_mode = 'lunar' THEN 'Unsupported calculate_mode ''lunar''' END AS reason, CASE WHEN ambiguous OR deadline IS NOT NULL THEN coalesce(source_note, law_ref) ELSE source_note END AS source
FROM (SELECT x.*, CASE WHEN ambiguous THEN NULL WHEN calculate_mode = 'calendar_days' THEN t + step WHEN calculate_mode = 'business_days' THEN CASE WHEN step = 0 THEN t ELSE b.day END
    WHEN calculate_mode = 'day_of_month' THEN CASE WHEN (inm < t OR step >= 0 AND direction = 'after') AND inm <= t THEN CAST(nm + (least(dom, day(last_day(nm))) - 1)::INT AS DATE) ELSE inm END
    WHEN calculate_mode = 'last_day_month' THEN CASE WHEN direction = 'after' THEN last_day(t) ELSE last_day(CAST(t - INTERVAL 1 MONTH AS DATE)) END END AS deadline
  FROM (SELECT g.trigger_id, g.trigger_date AS t, r.*, CASE WHEN direction = 'after' THEN base_days ELSE -base_days END AS step, CASE WHEN coalesce(day_of_month, 0) = 0 THEN 1 ELSE day_of_month END AS dom,
      CAST(date_trunc('month', g.trigger_date) AS DATE) + (dom - 1)::INT AS inm, CAST(date_trunc('month', g.trigger_date) + INTERVAL 1 MONTH AS DATE) AS nm,
      c.no + CASE WHEN step > 0 THEN step ELSE step + 1 - CASE WHEN c.open THEN 1 ELSE 0 END END AS want
    FROM {triggers} g JOIN {rules} r USING (rule_key) JOIN {calendar} c ON c.day = g.trigger_date) x
  LEFT JOIN {calendar} b ON b.open AND b.no = x.want)""")
def deadline_schedule(src):
    out = P.deadline_schedule(src.triggers, src.rules)
    return out.select("trigger_id", "rule_key", "certainty", day("deadline").alias("deadline"), "reason", "source")


@query("business_calendar", """
SELECT strftime(day, '%Y-%m-%d') AS day, open AS is_business, CAST(no - (SELECT min(no) FROM {calendar} WHERE day = lo) + (SELECT CASE WHEN any_value(open) THEN 1 ELSE 0 END FROM {calendar} WHERE day = lo) AS BIGINT) AS business_no
FROM {calendar}, (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM {orders}) WHERE day BETWEEN lo AND hi""")
def business_calendar(src):
    span = src.orders.agg(F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last"))
    return P.business_calendar(span).withColumn("day", day("day"))


INPUTS["orgs"] = """
SELECT c_custkey AS org_id, CASE c_mktsegment WHEN 'MACHINERY' THEN 'pro' WHEN 'BUILDING' THEN 'standard' WHEN 'AUTOMOBILE' THEN 'enterprise' WHEN 'HOUSEHOLD' THEN 'free' ELSE 'demo' END AS plan FROM {customer}
"""


@query("entitlements", """
SELECT org_id, plan, feature, CASE WHEN feature = 'OTHER' THEN true WHEN feature IN ('FIRM_KNOWLEDGE', 'DRAFTING') THEN plan IN ('standard', 'pro', 'enterprise') ELSE plan IN ('pro', 'enterprise') END AS entitled
FROM {orgs} CROSS JOIN (SELECT unnest(['AI_REMOTE', 'SEMANTIC_SEARCH', 'FIRM_KNOWLEDGE', 'DRAFTING', 'ADVANCED_SEARCH', 'OTHER']) AS feature)""")
def entitlements(src):
    return V.entitlements(src.orgs, ["AI_REMOTE", "SEMANTIC_SEARCH", "FIRM_KNOWLEDGE", "DRAFTING", "ADVANCED_SEARCH", "OTHER"])


INPUTS["calls"] = """
SELECT event_id AS call_id, user_id % 9 AS org_id, CASE event_type WHEN 'view' THEN 'search_per_day' WHEN 'click' THEN 'search_per_day' WHEN 'error' THEN 'matters' ELSE 'other' END AS key, ts FROM {events}
"""


@query("usage_metering", """
SELECT call_id, org_id, key, strftime(ts, '%Y-%m-%d') AS day, n, lim IS NULL OR n <= lim AS allowed, CAST(CASE WHEN lim IS NULL THEN -1 ELSE greatest(0, lim - n) END AS BIGINT) AS remaining FROM (
  SELECT c.*, row_number() OVER (PARTITION BY org_id, key, CAST(ts AS DATE) ORDER BY ts, call_id) AS n,
    CASE WHEN plan IN ('pro', 'enterprise') THEN NULL WHEN key = 'search_per_day' THEN 25 WHEN key = 'matters' THEN 2 END AS lim FROM {calls} c LEFT JOIN {orgs} USING (org_id))""")
def usage_metering(src):
    out = V.usage_metering(src.calls, src.orgs)
    return out.withColumn("day", day("day")).withColumn("remaining", F.coalesce("remaining", F.lit(-1)))


INPUTS["memberships"] = "SELECT CAST(s_nationkey AS STRING) AS user_id, s_suppkey AS org_id FROM {supplier}"


@query("tenant_scope", """
SELECT event_id, user_id FROM {events} WHERE user_id IN (SELECT org_id FROM {memberships} WHERE user_id = '7')""")
def tenant_scope(src):
    rows = src.events.select("event_id", "user_id", F.col("user_id").alias("org_id"))
    return V.tenant_scope(rows, src.memberships, "7").drop("org_id")


INPUTS["audit_events"] = """
SELECT event_id AS id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id % 20 END AS org_id, user_id AS actor_user_id, event_type AS action, 'search' AS resource_type,
  event_id % 100 AS resource_id, props AS detail, ts AS created_at FROM {events}
"""


@query("audit_export", "SELECT id, action, detail FROM {audit_events} WHERE org_id = 5 OR org_id IS NULL")
def audit_export(src):
    return V.audit_export(src.audit_events, 5).select("id", "action", "detail")


INPUTS["requests"] = """
SELECT event_id AS request_id, user_id % 4 AS org_id, concat('key-', CAST(event_id % 700 AS STRING)) AS idempotency_key, concat('result ', CAST(event_id AS STRING)) AS result, ts FROM {events}
"""


@query("first_result_per_key", """
SELECT request_id, org_id, idempotency_key, first_value(result) OVER w AS result, request_id <> first_value(request_id) OVER w AS replay FROM {requests}
WINDOW w AS (PARTITION BY org_id, idempotency_key ORDER BY ts, request_id)""")
def first_result_per_key(src):
    return V.first_result_per_key(src.requests)
