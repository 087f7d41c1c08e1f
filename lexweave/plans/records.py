"""Sources, gates and content-addressed ingest."""

from pyspark.sql import functions as F

from ..functions import dates as D, text as T
from ..operators import structure as S
from ..sources import records as R, registry as G
from .base import INPUTS, ORACLE_PARTS, query
from .documents import chain, day, paragraphs

REGISTRY_FIELDS = """
  CASE CAST(s_suppkey % 5 AS INT) WHEN 0 THEN 'APPROVED_OPEN' WHEN 1 THEN 'APPROVED_WITH_ATTRIBUTION' WHEN 2 THEN 'APPROVED_API_ONLY'
    WHEN 3 THEN 'UNKNOWN' ELSE NULL END AS reuse_status,
  s_nationkey % 2 = 0 AS official_source, s_nationkey % 3 = 0 AS primary_source,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey % 2 = 0 END AS commercial_reuse_allowed,
  s_suppkey % 3 = 0 AS automated_access_allowed, s_suppkey % 4 = 0 AS bulk_download_allowed, s_suppkey % 3 = 1 AS api_available,
  true AS attribution_required, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_suppkey % 9 <> 0 END AS adapter_enabled
"""
INPUTS["registry"] = f"SELECT s_name AS name, 'DATABASE' AS source_type, {REGISTRY_FIELDS}, 'https://example.org' AS base_url, CAST(NULL AS STRING) AS licence, CAST(NULL AS STRING) AS licence_url, CAST(NULL AS STRING) AS notes FROM {{supplier}}"
INPUTS["registry_now"] = """
SELECT name, source_type, coalesce(reuse_status, 'UNKNOWN') AS reuse_status, official_source, primary_source,
  coalesce(commercial_reuse_allowed, false) AS commercial_reuse_allowed, automated_access_allowed, bulk_download_allowed, api_available,
  attribution_required, coalesce(adapter_enabled, false) AS adapter_enabled, base_url, licence, licence_url, notes
FROM {registry} WHERE name NOT LIKE '%3'
"""
INPUTS["registry_seed"] = """
SELECT CASE WHEN name LIKE '%1' THEN 'hudoc' ELSE 'other' END AS key, concat(' ', name) AS name, CAST(NULL AS STRING) AS source_type,
  reuse_status, official_source, primary_source, commercial_reuse_allowed, automated_access_allowed, bulk_download_allowed, api_available,
  attribution_required, adapter_enabled, CASE WHEN name LIKE '%5' THEN 'https://new.example.org' ELSE base_url END AS base_url, licence, licence_url, notes
FROM {registry} WHERE name NOT LIKE '%7'
"""
ORACLE_PARTS["gate"] = """
SELECT *, list_filter([
    CASE WHEN NOT (coalesce(reuse_status LIKE 'APPROVED%', false) AND coalesce(adapter_enabled, false) AND (bulk_download_allowed OR api_available))
      THEN concat('reuse_status=', coalesce(reuse_status, 'UNKNOWN'), ', adapter_enabled=', CAST(coalesce(adapter_enabled, false) AS STRING)) END,
    CASE WHEN NOT coalesce(commercial_reuse_allowed, false) THEN 'commercial_reuse_allowed=False (no recorded legal clearance for commercial resale)' END],
  lambda x: x IS NOT NULL) AS reasons FROM {registry}
"""


@query("source_gate", "SELECT name, len(reasons) = 0 AS allowed, array_to_string(reasons, '; ') AS reasons FROM {gate}")
def source_gate(src):
    return G.source_gate(src.registry, True).select("name", "allowed", F.array_join("reasons", "; ").alias("reasons"))


ORACLE_PARTS["merged"] = """
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'created' WHEN b.name IS NULL THEN 'untouched'
    WHEN b.name LIKE '%1' OR b.name LIKE '%5' THEN 'updated' ELSE 'skipped' END AS outcome,
  CASE WHEN b.name LIKE '%1' THEN 'JUDGMENT' ELSE 'DATABASE' END AS source_type,
  coalesce(a.reuse_status, b.reuse_status, 'UNKNOWN') AS reuse_status,
  CASE WHEN b.name LIKE '%5' THEN 'https://new.example.org' ELSE 'https://example.org' END AS base_url
FROM {registry_now} a FULL JOIN (SELECT trim(name) AS name, reuse_status FROM {registry_seed}) b ON a.name = b.name
"""


@query("merge_registry", "SELECT * FROM {merged}")
def merge_registry(src):
    out = G.merge_registry(src.registry_now, src.registry_seed)
    return out.select("name", "outcome", "source_type", "reuse_status", "base_url")


@query("merge_counts", "SELECT outcome, count(*) AS sources FROM {merged} GROUP BY outcome")
def merge_counts(src):
    return G.merge_counts(G.merge_registry(src.registry_now, src.registry_seed))


INPUTS["datasets"] = """
SELECT p_partkey AS dataset_key, concat('Supplier#', lpad(CAST(p_partkey % 120 AS STRING), 9, '0')) AS source,
  p_size = 1 AS linked_on_external, CASE WHEN p_size = 2 THEN NULL ELSE p_size <> 3 END AS commercial_reuse_allowed,
  CASE WHEN p_size = 4 THEN '' ELSE concat('https://example.org/', CAST(p_partkey AS STRING)) END AS download_url
FROM {part}
"""
INPUTS["dataset_records"] = "SELECT l_partkey AS dataset_key, l_orderkey AS record FROM {lineitem}"


@query("dataset_status", """
SELECT dataset_key, status, CASE WHEN status = 'INGESTED' THEN coalesce(n, 0) ELSE 0 END AS records, why AS reason FROM (
  SELECT d.dataset_key, CASE WHEN linked_on_external THEN 'BLOCKED_EXTERNAL' WHEN NOT coalesce(d.commercial_reuse_allowed, false) THEN 'BLOCKED'
      WHEN download_url = '' THEN 'NOT_READY' WHEN g.name IS NULL OR len(reasons) > 0 THEN 'BLOCKED' ELSE 'INGESTED' END AS status,
    CASE WHEN linked_on_external THEN 'substantive content lives on an external unverified host; metadata/link-out only'
      WHEN NOT coalesce(d.commercial_reuse_allowed, false) THEN 'commercial_reuse_allowed not confirmed'
      WHEN download_url = '' THEN 'download_url not configured' WHEN g.name IS NULL THEN 'no source registry row'
      WHEN len(reasons) > 0 THEN array_to_string(reasons, '; ') END AS why
  FROM {datasets} d LEFT JOIN {gate} g ON g.name = d.source)
LEFT JOIN (SELECT dataset_key, count(*) AS n FROM {dataset_records} GROUP BY ALL) USING (dataset_key)""")
def dataset_status(src):
    return G.dataset_status(src.datasets, src.registry, src.dataset_records, True)


INPUTS["decision_rows"] = """
SELECT CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE concat(' ΥΠΚ ', CAST(doc_id AS STRING), '/', lang, ' ') END AS dno, text, lang, source,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('https://example.org/', CAST(doc_id AS STRING)) END AS url FROM {documents}
"""


@query("decision_records", r"""
SELECT concat('consumer-decision-', regexp_replace(regexp_replace(translate(lower(trim(dno)), 'γπύ', 'gpy'), '[^0-9a-z]+', '-', 'g'), '^-+|-+$', '', 'g')) AS canonical_key,
  concat('Απόφαση ', trim(dno)) AS title, concat('Decision ', trim(dno), chr(10), CASE WHEN trim(text) <> '' THEN concat(trim(text), chr(10)) ELSE '' END,
    'Statutory basis: ', lang, chr(10), 'Affected undertaking: ', source) AS body, url AS external_url
FROM {decision_rows} WHERE trim(dno) <> ''""")
def decision_records(src):
    raw = src.decision_rows.select(
        F.col("dno").alias(R.DECISION_NO), F.col("text").alias(R.SUMMARY), F.col("lang").alias(R.LEGISLATION),
        F.col("source").alias(R.COMPANY), F.col("url").alias(R.URL), F.lit("").alias(R.DATE),
    )
    return R.decision_records(raw).select("canonical_key", "title", "body", "external_url")


INPUTS["supplier_cells"] = """
SELECT s_suppkey, s_name, CASE WHEN s_nationkey = 3 THEN NULL ELSE s_nationkey END AS s_nationkey FROM {supplier}
"""


@query("normalize_table", """
SELECT concat('supplier-table-', substr(sha256(body), 1, 10)) AS canonical_key, body FROM (
  SELECT concat('s_suppkey: ', s_suppkey, ' | s_name: ', s_name, CASE WHEN s_nationkey IS NOT NULL THEN concat(' | s_nationkey: ', s_nationkey) ELSE '' END) AS body FROM {supplier_cells})""")
def normalize_table(src):
    return R.normalize_table(src.supplier_cells, "Supplier table").select("canonical_key", "body")


@query("decode_documents", """
SELECT path, CASE WHEN doc_id % 7 <> 0 THEN text WHEN doc_id % 2 = 0 THEN concat(text, '�') ELSE '' END AS text FROM (
  SELECT doc_id, concat('/in/', CAST(doc_id AS STRING), CASE WHEN doc_id % 2 = 0 THEN '.TXT' ELSE '.dat' END) AS path, text FROM {documents})""")
def decode_documents(src):
    raw = F.encode("text", "UTF-8")
    rows = src.documents.select(
        F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".TXT").otherwise(".dat")).alias("path"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw).alias("content"),
    )
    return R.decode_documents(rows)


INPUTS["acts"] = """
SELECT o_orderkey AS act, concat(CAST(o_orderkey % 6 AS STRING), CAST(year(o_orderdate) AS STRING), CASE WHEN o_orderstatus = 'F' THEN 'L' WHEN o_orderstatus = 'O' THEN 'R' ELSE 'D' END,
    lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')) AS celex,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Κανονισμός' ELSE '' END AS title_el, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Regulation' END AS title_en
FROM {orders}
"""


@query("validate_acts", r"""
SELECT act, title, concat_ws(chr(10), title, title_en) AS body,
  CASE WHEN NOT regexp_full_match(celex, '[1-4]\d{4}[LR]\d{4}') THEN 'invalid or missing CELEX' WHEN title IS NULL THEN 'no official title' END AS reject_reason
FROM (SELECT *, coalesce(nullif(title_el, ''), title_en) AS title FROM {acts})""")
def validate_acts(src):
    return R.validate_acts(src.acts).select("act", "title", "body", "reject_reason")


@query("discover", "SELECT s_name, s_suppkey FROM {supplier} WHERE s_name >= 'Supplier#000000042'")
def discover(src):
    return R.discover(src.supplier.select("s_name", "s_suppkey"), "Supplier#000000042", "s_name")


INPUTS["date_texts"] = """
SELECT o_orderkey, CASE CAST(o_orderkey % 4 AS INT)
  WHEN 0 THEN concat(' ', CAST(day(o_orderdate) AS STRING), '/', CAST(month(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING))
  WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 2 THEN concat(CAST(year(o_orderdate) AS STRING), '/', CAST(month(o_orderdate) AS STRING), '/1')
  ELSE concat('31/2/', CAST(year(o_orderdate) AS STRING)) END AS raw FROM {orders}
"""


@query("parse_date", """
SELECT o_orderkey, strftime(coalesce(try_strptime(trim(raw), '%-d/%-m/%Y'), try_strptime(trim(raw), '%Y-%m-%d'), try_strptime(trim(raw), '%Y/%-m/%-d')), '%Y-%m-%d') AS parsed
FROM {date_texts}""")
def parse_date(src):
    return src.date_texts.select("o_orderkey", day(D.parse_date("raw")).alias("parsed"))


# Arrivals: a document arrives for the record of its source; documents with a label are already stored.
INPUTS["arrivals"] = """
SELECT lang AS source, source AS record_id, source AS canonical_key, text AS payload, doc_id AS arrival FROM {documents}
"""
INPUTS["stored_docs"] = """
SELECT a.source, a.record_id, a.canonical_key, a.payload, a.arrival FROM {arrivals} a JOIN {labels} l ON a.arrival = l.doc_id
"""


def stored(src):
    return src.stored_docs.select("source", "record_id", T.sha256("payload").alias("content_hash"))


def pointers(src):
    latest = src.stored_docs.groupBy("source", "canonical_key").agg(
        F.max_by(F.struct("record_id", T.sha256("payload").alias("content_hash")), "arrival").alias("l")
    )
    return latest.select("source", "canonical_key", "l.*").select("source", "canonical_key", R.snapshot_id().alias("snapshot_id"))


@query("snapshot", """
SELECT source, record_id, content_hash, min(arrival) AS arrival, sha256(concat(source, ':', record_id, ':', content_hash)) AS snapshot_id
FROM (SELECT *, sha256(payload) AS content_hash FROM {arrivals})
WHERE (source, record_id, content_hash) NOT IN (SELECT source, record_id, sha256(payload) FROM {stored_docs}) GROUP BY ALL""")
def snapshot(src):
    return R.snapshot(src.arrivals, stored(src)).select("source", "record_id", "content_hash", "arrival", "snapshot_id")


ORACLE_PARTS["new_pointers"] = "SELECT source, canonical_key, sha256(concat(source, ':', record_id, ':', sha256(payload))) AS id FROM {arrivals} QUALIFY row_number() OVER (PARTITION BY source, canonical_key ORDER BY arrival DESC) = 1"
ORACLE_PARTS["old_pointers"] = "SELECT source, canonical_key, sha256(concat(source, ':', record_id, ':', sha256(payload))) AS id FROM {stored_docs} QUALIFY row_number() OVER (PARTITION BY source, canonical_key ORDER BY arrival DESC) = 1"


@query("upsert_documents", """
SELECT source, canonical_key, coalesce(n.id, o.id) AS snapshot_id, o.id IS NULL AS created_new,
  coalesce(o.id <> n.id, false) AS version_changed, coalesce(o.id = n.id, false) AS deduplicated
FROM {old_pointers} o FULL JOIN {new_pointers} n USING (source, canonical_key)""")
def upsert_documents(src):
    return R.upsert_documents(pointers(src), src.arrivals)


@query("lineage", """
SELECT stage, artifact_id, snapshot_id, 'run-1' AS run_id, 'p1' AS parser_version, 'n1' AS normalizer_version FROM (
  SELECT 'NORMALIZE' AS stage, concat(law, ':', version_number) AS artifact_id, version_id AS snapshot_id FROM {chain}
  UNION ALL SELECT 'CHUNK', concat(case_id, ':', para_number), version_id FROM {paragraphs} JOIN {judgments} USING (case_id))""")
def lineage(src):
    versions = chain(src).select(
        F.concat_ws(":", "law", F.col("version_number").cast("string")).alias("artifact_id"), F.col("version_id").alias("snapshot_id")
    )
    pieces = paragraphs(src).join(src.judgments, "case_id").select(
        F.concat_ws(":", "case_id", F.col("para_number").cast("string")).alias("artifact_id"), F.col("version_id").alias("snapshot_id")
    )
    out = R.lineage({"NORMALIZE": versions, "CHUNK": pieces}, "run-1", parser_version="p1", normalizer_version="n1")
    return out.drop("embedding_version")


INPUTS["facts_now"] = """
SELECT l_orderkey AS document_id, concat('fact ', CAST(l_linenumber AS STRING)) AS text,
  CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'proposed' END AS status FROM {lineitem}
"""
INPUTS["facts_again"] = """
SELECT o_orderkey AS document_id, 'fact again' AS text, 'proposed' AS status FROM {orders} WHERE o_orderstatus = 'F'
"""


@query("refresh_proposed", """
SELECT document_id, text, status FROM {facts_now} WHERE status <> 'proposed' OR document_id NOT IN (SELECT document_id FROM {facts_again})
UNION ALL SELECT document_id, text, status FROM {facts_again}""")
def refresh_proposed(src):
    return R.refresh_proposed(src.facts_now, src.facts_again)


INPUTS["source_records"] = """
SELECT n_name AS source, r_name AS jurisdiction, concat('key-', CAST(s_suppkey AS STRING)) AS canonical_key, s_name AS title, concat('Balance ', s_name) AS body,
  CASE WHEN s_suppkey % 2 = 0 THEN 'DECISION' ELSE NULL END AS authority_type, concat('snap-', CAST(s_suppkey AS STRING)) AS snapshot_id,
  CAST(s_suppkey AS STRING) AS decision_no, 'CC' AS licence FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""


@query("source_document_chunks", """
SELECT sha256(concat('srcdoc:', source, ':', canonical_key)) AS chunk_id, canonical_key AS document_key, snapshot_id AS version_id, body AS text,
  concat(title, chr(10), 'Jurisdiction: ', jurisdiction, chr(10), 'Type: ', coalesce(authority_type, 'SOURCE_DOCUMENT')) AS hierarchy_context,
  decision_no, canonical_key AS content_hash FROM {source_records}""")
def source_document_chunks(src):
    out = S.source_document_chunks(src.source_records)
    return out.select(
        "chunk_id", "document_key", "version_id", "text", "hierarchy_context", F.col("source_locator.decision_no").alias("decision_no"), "content_hash"
    )
