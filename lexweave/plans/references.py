"""References and the citation graph."""

from pyspark.sql import functions as F

from ..operators import graph as G
from ..scale import SPREAD_ROWS, spread
from .base import INPUTS, ORACLE_PARTS, query
from .documents import paragraphs, wording

INPUTS["citation_texts"] = """
SELECT arrival AS text_id, law, CASE CAST(arrival % 7 AS INT)
  WHEN 0 THEN concat('Article ', a, ' of the Law ', law, ' and Civil 12/1999')
  WHEN 1 THEN concat('see ECLI:CY:AD:1999:A', a, ' or Law ', law)
  WHEN 2 THEN concat('Civil Appeal ', a, '/1999')
  WHEN 3 THEN concat('under Law ', law, ' only')
  WHEN 4 THEN concat('άρθρο ', a, ' του Νόμου ', law)
  WHEN 5 THEN concat('Article 999 of Law ', law)
  ELSE concat('plain prose ', st) END AS cite
FROM {law_facts}
"""
# Search entries: the provisions of every law and one judgment per conversation.
INPUTS["entries"] = """
SELECT 'legislation_node' AS kind, concat('law-', law, '-art-', number) AS canonical_ref, law AS canonical_id,
  concat('Law of customer ', law) AS title, body, 'en' AS language, law AS ref_law, number AS ref_article,
  CAST(NULL AS STRING) AS ecli, CAST(NULL AS STRING) AS case_number, CAST(NULL AS STRING) AS court
FROM (SELECT law, a AS number, max(concat(l_body, chr(10), l_loose)) AS body FROM {law_lines} GROUP BY law, a
      UNION ALL SELECT law, b, max(l_last) FROM {law_lines} GROUP BY law, b)
UNION ALL
SELECT 'judgment_node', concat('judgment-', ecli), case_id, title, concat(title, ' before ', court, ', case ', case_number),
  'en', NULL, NULL, ecli, case_number, court
FROM {judgments}
"""
ORACLE_PARTS["parsed"] = r"""
SELECT text_id, cite, CASE WHEN art <> '' THEN 'legislation_article' WHEN ecli <> '' OR cno <> '' THEN 'judgment'
    WHEN lno <> '' THEN 'legislation' ELSE 'unknown' END AS kind,
  nullif(art, '') AS article,
  CASE WHEN art <> '' THEN art_law WHEN ecli <> '' THEN NULL WHEN cno <> '' THEN cno ELSE nullif(lno, '') END AS law,
  CASE WHEN art = '' AND ecli = '' AND cno <> '' THEN cyr END AS year,
  CASE WHEN art = '' AND ecli = '' AND cno <> '' THEN concat(cno, '/', cyr) END AS case_number,
  CASE WHEN art = '' AND ecli <> '' THEN ecli END AS ecli
FROM (SELECT text_id, cite,
  regexp_extract(cite, '(?i)(?:Article|άρθρο)\s+([0-9IVXL]+[A-Z]?)\s+(?:of|του)\s+(?:the\s+)?(?:Law\s+|Νόμο?ü?\s+)?([0-9]+)', 1) AS art,
  regexp_extract(cite, '(?i)(?:Article|άρθρο)\s+([0-9IVXL]+[A-Z]?)\s+(?:of|του)\s+(?:the\s+)?(?:Law\s+|Νόμο?ü?\s+)?([0-9]+)', 2) AS art_law,
  regexp_extract(cite, '(?i)\bECLI:[A-Z]{2}:[A-Z0-9]{1,6}:[0-9]{4}:[A-Z0-9]{1,6}\b') AS ecli,
  regexp_extract(cite, '([0-9]{1,5})\s*/\s*([0-9]{4})', 1) AS cno, regexp_extract(cite, '([0-9]{1,5})\s*/\s*([0-9]{4})', 2) AS cyr,
  regexp_extract(cite, '(?i)\bLaw\s+([0-9]+)', 1) AS lno FROM {citation_texts})
"""
ORACLE_PARTS["cite_keys"] = """
SELECT *, CASE kind WHEN 'legislation_article' THEN concat('art|', law, '|', article) WHEN 'legislation' THEN concat('law|', law)
  WHEN 'judgment' THEN CASE WHEN ecli IS NOT NULL THEN concat('ecli|', ecli) ELSE concat('case|', case_number) END END AS key
FROM {parsed}
"""
ORACLE_PARTS["entry_keys"] = """
SELECT concat('art|', ref_law, '|', ref_article) AS key, canonical_ref, title, body FROM {entries} WHERE ref_law IS NOT NULL
UNION ALL SELECT concat('law|', ref_law), canonical_ref, title, body FROM {entries} WHERE ref_law IS NOT NULL
UNION ALL SELECT concat('ecli|', ecli), canonical_ref, title, body FROM {entries} WHERE ecli IS NOT NULL
UNION ALL SELECT concat('case|', case_number), canonical_ref, title, body FROM {entries} WHERE case_number IS NOT NULL
"""


@query("reference_mentions", " UNION ALL ".join(
    f"SELECT arrival, '{kind}' AS kind, hits[i] AS text, list_sum([len(g) for g in gaps[1:i]]) + coalesce(list_sum([len(h) for h in hits[1:i-1]]), 0) AS start"
    f" FROM (SELECT arrival, regexp_extract_all(raw_text, '{pattern}', 0) AS hits, regexp_split_to_array(raw_text, '{pattern}') AS gaps,"
    f" unnest(generate_series(1, len(regexp_extract_all(raw_text, '{pattern}', 0)))) AS i FROM {{law_source}})"
    for kind, pattern in [
        ("article", r"(?i)(?:Άρθρο|άρθρο|Article|αρ\.)\s*\.?\s*[0-9IVXLC]+[A-Z]?(?:\(\d+[a-z]?\))?(?:\([α-ω]\))?"),
        ("chapter", r"(?i)(?:ΚΕΦ\.|Κεφ\.|Κεφάλαιο|Chapter)\s*[0-9]+"),
        ("law", r"(?i)(?:Ν\.\s*|Law\s+|Νόμος\s+)?[0-9]+(?:\([IVXLC]+\))?\s*/\s*[0-9]{4}"),
        ("judgment_ecli", r"(?i)\bECLI:[A-Z]{2}:[A-Z0-9]{1,6}:[0-9]{4}:[A-Z0-9]{1,6}\b"),
        ("judgment_case", r"[0-9]{1,5}\s*/\s*[0-9]{4}"),
    ]))
def reference_mentions(src):
    out = G.reference_mentions(spread(src.law_source.select("arrival", "raw_text"), SPREAD_ROWS), "raw_text")
    return out.select("arrival", "kind", "text", "start")


@query("classify_citations", """
SELECT text_id, kind, article, law, year, case_number, ecli,
  CASE WHEN kind = 'legislation_article' THEN 0.97 WHEN ecli IS NOT NULL THEN 0.99 WHEN kind = 'judgment' THEN 0.8
       WHEN kind = 'legislation' THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence FROM {parsed}""")
def classify_citations(src):
    return G.classify_citations(src.citation_texts.select("text_id", F.col("cite").alias("c")), "c").drop("c")


@query("validate_citations", """
SELECT text_id, kind, kind <> 'unknown' AS parsed, CASE WHEN kind <> 'unknown' THEN coalesce(n, 0) > 0 END AS exists,
  CAST(CASE WHEN kind <> 'unknown' THEN coalesce(n, 0) ELSE -1 END AS BIGINT) AS matches
FROM {cite_keys} LEFT JOIN (SELECT key, count(*) AS n FROM {entry_keys} GROUP BY key) USING (key)""")
def validate_citations(src):
    out = G.validate_citations(src.citation_texts.select("text_id", "cite"), src.entries)
    return out.select("text_id", "kind", "parsed", "exists", F.coalesce("matches", F.lit(-1)).alias("matches"))


@query("resolve_authorities", """
SELECT text_id, cite, canonical_ref IS NOT NULL AS verified, canonical_ref, title, substr(body, 1, 300) AS text
FROM {cite_keys} LEFT JOIN (SELECT key, min(canonical_ref) AS canonical_ref, min_by(title, canonical_ref) AS title,
  min_by(body, canonical_ref) AS body FROM {entry_keys} GROUP BY key) USING (key)""")
def resolve_authorities(src):
    return G.resolve_authorities(src.citation_texts.select("text_id", "cite"), src.entries)


ORACLE_PARTS["latest_wording"] = "SELECT * FROM {wording} WHERE effective_to IS NULL"


@query("provision_cross_refs", r"""
SELECT DISTINCT m.law, m.node_id AS source_id, t.node_id AS target_id, m.start AS span_start, m.hit AS source_text
FROM (SELECT law, node_id, hits[i] AS hit, regexp_extract(hits[i], '[0-9]+') AS article,
    list_sum([len(g) for g in gaps[1:i]]) + coalesce(list_sum([len(h) for h in hits[1:i-1]]), 0) AS start
  FROM (SELECT law, node_id, regexp_extract_all(source_text, '(?i)(?:Άρθρο|Article|αρ\.)\s*\.?\s*[0-9IVXLC]+[A-Z]?(?:\(\d+[a-z]?\))?(?:\([α-ω]\))?', 0) AS hits,
      regexp_split_to_array(source_text, '(?i)(?:Άρθρο|Article|αρ\.)\s*\.?\s*[0-9IVXLC]+[A-Z]?(?:\(\d+[a-z]?\))?(?:\([α-ω]\))?') AS gaps,
      unnest(generate_series(1, len(hits))) AS i FROM {latest_wording})) m
JOIN {latest_wording} t ON t.law = m.law AND t.node_type = 'ARTICLE' AND t.number = m.article AND t.node_id <> m.node_id""")
def provision_cross_refs(src):
    latest = wording(src).filter("effective_to IS NULL")
    return G.provision_cross_refs(latest).select("law", "source_id", "target_id", "span_start", "source_text")


@query("enrich_judgments", r"""
SELECT DISTINCT case_id, para_number, relationship, target_key, 'CY' AS target_jurisdiction FROM (
  SELECT p.case_id, p.para_number, 'CITES' AS relationship,
    unnest(regexp_extract_all(p.text, '\bECLI:[A-Z]{2}:[A-Z0-9]{1,6}:[0-9]{4}:[A-Z0-9]{1,6}\b')) AS target_key FROM {paragraphs} p
  UNION ALL
  SELECT p.case_id, p.para_number, 'APPLIES', n.node_id
  FROM (SELECT case_id, para_number, unnest(regexp_extract_all(text, '(?i)Article ([0-9]+)', 1)) AS article FROM {paragraphs}) p
  JOIN {judgments} j USING (case_id)
  JOIN (SELECT DISTINCT law, number, node_id FROM {wording} WHERE node_type = 'ARTICLE') n
    ON n.law = j.applicable_law AND n.number = p.article)""")
def enrich_judgments(src):
    out = G.enrich_judgments(paragraphs(src), src.judgments, wording(src), "case_id")
    return out.drop("review_status")


# Edges: an order cites the part of each of its lines.
INPUTS["case_citations"] = """
SELECT concat('judgment-', CAST(l_orderkey AS STRING)) AS source_key, 'CY' AS source_jurisdiction,
  concat('judgment-', CAST(l_partkey AS STRING)) AS target_key, CASE WHEN l_linestatus = 'F' THEN 'UK' ELSE 'CY' END AS target_jurisdiction,
  'CITES' AS kind FROM {lineitem}
"""
INPUTS["raw_treatments"] = """
SELECT concat('judgment-', CAST(l_orderkey AS STRING)) AS source_key, concat('judgment-', CAST(l_partkey AS STRING)) AS target_key,
  'CY' AS target_jurisdiction,
  CASE l_returnflag WHEN 'A' THEN 'FOLLOWS' WHEN 'N' THEN 'OVERRULES' ELSE 'MENTIONS' END AS treatment,
  CASE WHEN l_linestatus = 'F' THEN 'validated' ELSE NULL END AS review_status FROM {lineitem}
"""
INPUTS["law_links"] = """
SELECT concat('judgment-', CAST(l_orderkey AS STRING)) AS judgment_key, 'APPLIES' AS relationship,
  concat('law-', CAST(l_suppkey AS STRING), '-art-', CAST(l_linenumber AS STRING)) AS provision_key,
  'CY' AS legislation_jurisdiction FROM {lineitem}
"""
INPUTS["provision_refs"] = """
SELECT concat('law-', CAST(l_suppkey AS STRING), '-art-', CAST(l_linenumber AS STRING)) AS source_key,
  concat('law-', CAST(l_partkey % 100 AS STRING), '-art-1') AS target_key, 'REFERENCES' AS relationship
FROM {lineitem}
"""
INPUTS["case_keys"] = """
SELECT concat('judgment-', CAST(p_partkey AS STRING)) AS case_key FROM {part}
"""
INPUTS["provision_keys"] = """
SELECT concat('law-', CAST(s_suppkey AS STRING), '-art-1') AS provision_key FROM {supplier}
"""
ORACLE_PARTS["treatments"] = """
SELECT source_key, target_key, target_jurisdiction, CASE treatment WHEN 'MENTIONS' THEN 'DISCUSSES' ELSE treatment END AS treatment,
  coalesce(review_status, 'review_required') AS review_status FROM {raw_treatments}
"""


@query("expand_cases", """
SELECT source_key AS case_key, 'cited' AS relation, target_key AS other_key, kind AS label, target_jurisdiction AS jurisdiction, NULL AS review_status
FROM {case_citations} WHERE source_key IN (SELECT case_key FROM {case_keys})
UNION ALL SELECT target_key, 'citing', source_key, kind, source_jurisdiction, NULL FROM {case_citations} WHERE target_key IN (SELECT case_key FROM {case_keys})
UNION ALL SELECT source_key, 'treatment', target_key, treatment, target_jurisdiction, review_status FROM {treatments} WHERE source_key IN (SELECT case_key FROM {case_keys})
UNION ALL SELECT judgment_key, 'legislation_link', provision_key, relationship, legislation_jurisdiction, NULL FROM {law_links} WHERE judgment_key IN (SELECT case_key FROM {case_keys})""")
def expand_cases(src):
    return G.expand_cases(src.case_keys, src.case_citations, G.normalize_treatments(src.raw_treatments), src.law_links)


# Three names a case in a chain of two rows; every tenth case is also known under a name of the next one.
INPUTS["case_names"] = """
SELECT concat('ecli-', CAST(p_partkey AS STRING)) AS alias, concat('judgment-', CAST(p_partkey AS STRING)) AS canonical_id FROM {part}
UNION ALL SELECT concat('no-', CAST(p_partkey AS STRING)), concat('ecli-', CAST(p_partkey AS STRING)) FROM {part}
UNION ALL SELECT concat('no-', CAST(p_partkey AS STRING)), concat('ecli-', CAST(p_partkey + 1 AS STRING)) FROM {part} WHERE p_partkey % 10 = 0
"""
INPUTS["named_cases"] = "SELECT concat('no-', CAST(p_partkey AS STRING)) AS case_key FROM {part}"
ORACLE_PARTS["same_case"] = """
SELECT concat('no-', CAST(a.p_partkey AS STRING)) AS case_key, concat('judgment-', CAST(b.p AS STRING)) AS name FROM {part} a
JOIN (SELECT p_partkey AS p, p_partkey - CASE WHEN p_partkey % 10 = 1 THEN 1 ELSE 0 END AS c FROM {part}
      UNION SELECT p_partkey + 1, p_partkey FROM {part} WHERE p_partkey % 10 = 0) b ON b.c = a.p_partkey - CASE WHEN a.p_partkey % 10 = 1 THEN 1 ELSE 0 END
"""


@query("expand_cases_by_name", """
SELECT case_key, relation, count(*) AS n, count(DISTINCT other_key) AS others FROM (
  SELECT case_key, 'cited' AS relation, target_key AS other_key FROM {same_case} JOIN {case_citations} ON source_key = name
  UNION ALL SELECT case_key, 'citing', source_key FROM {same_case} JOIN {case_citations} ON target_key = name
  UNION ALL SELECT case_key, 'treatment', target_key FROM {same_case} JOIN {treatments} ON source_key = name
  UNION ALL SELECT case_key, 'legislation_link', provision_key FROM {same_case} JOIN {law_links} ON judgment_key = name) GROUP BY ALL""")
def expand_cases_by_name(src):
    out = G.expand_cases(src.named_cases, src.case_citations, G.normalize_treatments(src.raw_treatments), src.law_links, src.case_names)
    return out.groupBy("case_key", "relation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("other_key").alias("others"))


@query("expand_provisions", """
SELECT source_key AS provision_key, 'references_out' AS relation, target_key AS other_key, relationship AS label FROM {provision_refs}
WHERE source_key IN (SELECT provision_key FROM {provision_keys})
UNION ALL SELECT target_key, 'referenced_by', source_key, relationship FROM {provision_refs} WHERE target_key IN (SELECT provision_key FROM {provision_keys})
UNION ALL SELECT provision_key, 'case', judgment_key, relationship FROM {law_links} WHERE provision_key IN (SELECT provision_key FROM {provision_keys})""")
def expand_provisions(src):
    return G.expand_provisions(src.provision_keys, src.provision_refs, src.law_links)


@query("normalize_treatments", "SELECT source_key, target_key, treatment, review_status FROM {treatments}")
def normalize_treatments(src):
    return G.normalize_treatments(src.raw_treatments).drop("target_jurisdiction")


@query("case_aliases", """
SELECT unnest([ecli, case_number, concat('judgment-', case_number), case_id]) AS alias, case_id AS canonical_id FROM {judgments}""")
def case_aliases(src):
    return G.case_aliases(src.judgments.withColumnRenamed("case_id", "canonical_id"))


INPUTS["raw_edges"] = """
SELECT concat('judgment-', CAST(l_orderkey AS STRING)) AS source_key, concat('judgment-', CAST(l_partkey AS STRING)) AS target_key,
  'CY' AS source_jurisdiction, CASE WHEN l_linestatus = 'F' THEN 'UK' ELSE NULL END AS target_jurisdiction,
  CASE WHEN l_returnflag = 'R' THEN 'APPROVES' ELSE NULL END AS relationship,
  CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN CAST(l_orderkey AS STRING)
       ELSE concat('00000000-0000-4000-8000-0000', CAST(10000000 + l_orderkey AS STRING)) END AS evidence_id
FROM {lineitem}
"""


@query("build_edges", """
SELECT 'case_citation' AS edge_kind, source_key, target_key, coalesce(target_jurisdiction, source_jurisdiction) AS target_jurisdiction,
  coalesce(relationship, 'CITES') AS relationship, evidence_id IS NULL OR len(evidence_id) = 36 AS valid FROM {raw_edges}
UNION ALL
SELECT 'law_link', source_key, target_key, coalesce(target_jurisdiction, source_jurisdiction), coalesce(relationship, 'APPLIES'),
  evidence_id IS NULL OR len(evidence_id) = 36 FROM {raw_edges}""")
def build_edges(src):
    both = G.build_edges(src.raw_edges, "case_citation").unionByName(G.build_edges(src.raw_edges, "law_link"))
    return both.select("edge_kind", "source_key", "target_key", "target_jurisdiction", "relationship", "valid")


# Results: each part is a result of the query of its size, on the matter of its size.
INPUTS["part_results"] = """
SELECT CAST(p_size AS BIGINT) AS query_id, CAST(p_size % 10 AS BIGINT) AS matter_id,
  concat('judgment-', CAST(p_partkey AS STRING)) AS canonical_ref, concat('judgment-', CAST(p_partkey AS STRING)) AS case_key FROM {part}
"""
INPUTS["matter_authorities"] = """
SELECT CAST(doc_id % 10 AS BIGINT) AS matter_id, concat('doc-', CAST(doc_id AS STRING)) AS canonical_ref,
  CASE WHEN toxic = 1 THEN 'adverse' ELSE 'supporting' END AS classification,
  concat('issue ', CAST(quality AS STRING)) AS matter_issue FROM {labels}
"""


@query("adverse_authorities", """
SELECT query_id, canonical_ref, matter_issue AS basis, NULL AS treatment, 'LAWYER DECISION' AS provenance
FROM (SELECT DISTINCT query_id, matter_id FROM {part_results}) JOIN {matter_authorities} USING (matter_id) WHERE classification = 'adverse'
UNION ALL
SELECT query_id, canonical_ref, NULL, treatment, 'STRUCTURED_EXTRACTION'
FROM {part_results} JOIN {treatments} ON case_key = source_key WHERE treatment = 'OVERRULES'""")
def adverse_authorities(src):
    treatments = G.normalize_treatments(src.raw_treatments)
    return G.adverse_authorities(src.part_results, treatments, src.matter_authorities).drop("review_status")
