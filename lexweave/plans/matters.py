"""Matter analytics, evidence and grounded answers."""

from pyspark.sql import functions as F

from ..functions import fixed, text as T
from ..operators import graph as G, matter as M
from ..scale import SPREAD_ROWS, spread
from ..session import durable
from .base import INPUTS, ORACLE_PARTS, Source, query
from .documents import arrived_wording, day, of_laws, paragraphs, spans
from .search import aliases, hybrid, index_of

INPUTS["matter_texts"] = """
SELECT o_orderkey AS document_id, o_custkey AS matter_id,
  concat('The supplier Alpha Trading of ', o_orderpriority, ' shall pay €', CAST(o_orderkey AS STRING), ',000.50 and must deliver. On ',
    CAST(o_orderkey % 32 AS STRING), '/', CAST(o_orderkey % 13 AS STRING), '/', CAST(year(o_orderdate) AS STRING), ' goods were delivered; Beta Ltd agrees to pay $ ',
    CAST(o_custkey AS STRING), CASE WHEN o_orderstatus = 'F' THEN '. Contract signed by John Smith and Alpha Trading. Claim FILED later.' ELSE ' This Court Order Of Record was received.' END) AS text
FROM {orders}
"""


def regex_spans(pattern: str, source: str = "matter_texts") -> str:
    return f"""SELECT document_id, matter_id, text, hits[i] AS hit,
      CAST(list_sum([len(g) for g in gaps[1:i]]) + coalesce(list_sum([len(h) for h in hits[1:i-1]]), 0) AS BIGINT) AS s
    FROM (SELECT *, regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_split_to_array(text, '{pattern}') AS gaps,
      unnest(generate_series(1, len(regexp_extract_all(text, '{pattern}', 0)))) AS i FROM {{{source}}})"""


def word_spans(words: list[str], source: str = "matter_texts") -> str:
    return " UNION ALL ".join(
        f"""SELECT document_id, matter_id, text, CAST(list_sum([len(g) for g in gaps[1:i]]) + (i - 1) * {len(w)} AS BIGINT) AS s
    FROM (SELECT *, string_split(lower(text), '{w}') AS gaps, unnest(generate_series(1, len(string_split(lower(text), '{w}')) - 1)) AS i FROM {{{source}}})"""
        for w in words
    )


ORACLE_PARTS["amount_spans"] = regex_spans(r"[€£$]\s?\d[\d,.]*")
ORACLE_PARTS["name_spans"] = regex_spans(r"\b[A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+)*\s?\b")
ORACLE_PARTS["duty_spans"] = word_spans(fixed.OBLIGATIONS)
STOP = ", ".join(f"'{w}'" for w in fixed.NAME_STOP)


@query("extract_facts", f"""
SELECT document_id, 'amount' AS kind, hit AS text, s AS char_start, s + len(hit) AS char_end, 0.9::DOUBLE AS confidence FROM {{amount_spans}}
UNION ALL SELECT document_id, 'obligation', trim(substr(text, greatest(0, s - 40) + 1, s + 40 - greatest(0, s - 40))), greatest(0, s - 40), s + 40, 0.6 FROM {{duty_spans}}
UNION ALL SELECT document_id, 'party', trim(hit), s, s + len(hit), 0.7 FROM {{name_spans}}
WHERE trim(hit) NOT IN ({STOP}) AND regexp_matches(substr(trim(hit), 2), '[a-z]') AND len(string_split(trim(hit), ' ')) <= 3
QUALIFY row_number() OVER (PARTITION BY document_id, lower(trim(hit)) ORDER BY s) = 1""")
def extract_facts(src):
    return M.extract_facts(spread(src.matter_texts.select("document_id", "text")), "text").select("document_id", *M.FACT)


ORACLE_PARTS["date_spans"] = regex_spans(r"\b\d{1,2}/\d{1,2}/\d{4}\b")
ORACLE_PARTS["verb_spans"] = word_spans(fixed.EVENT_VERBS)
ORACLE_PARTS["matter_events"] = r"""
SELECT document_id, matter_id, strftime(d, '%Y-%m-%d') AS event_date, string_split_regex(trim(substr(text, s + 1, len(hit) + 40)), '[.;]')[1] AS description,
  s AS char_start, s + len(hit) AS char_end, 0.9::DOUBLE AS confidence
FROM (SELECT *, try_strptime(hit, '%-d/%-m/%Y') AS d FROM {date_spans}) WHERE d IS NOT NULL
UNION ALL SELECT document_id, matter_id, NULL, CASE WHEN s >= 40 THEN trim(substr(text, s - 39, 80)) ELSE trim(substr(text, greatest(0, len(text) + s - 40) + 1, greatest(0, s + 40 - greatest(0, len(text) + s - 40)))) END,
  greatest(0, s - 40), s + 40, 0.5
FROM {verb_spans} WHERE NOT regexp_matches(substr(text, greatest(0, s - 30) + 1, s - greatest(0, s - 30)), '\b\d{1,2}/\d{1,2}/\d{4}\b')
"""


def matter_events(src: Source):
    return M.extract_events(spread(src.matter_texts), "text")


@query("extract_events", "SELECT document_id, event_date, description, char_start, char_end, confidence FROM {matter_events}")
def extract_events(src):
    out = matter_events(src).withColumn("event_date", day("event_date"))
    return out.select("document_id", "event_date", "description", "char_start", "char_end", "confidence")


@query("chronology", "SELECT matter_id, document_id, event_date, description FROM {matter_events} WHERE event_date IS NOT NULL")
def chronology(src):
    return M.chronology(matter_events(src)).select("matter_id", "document_id", day("event_date").alias("event_date"), "description")


INPUTS["issue_facts"] = """
SELECT o_custkey AS matter_id, o_orderkey AS fact_id, CASE CAST(o_orderkey % 11 AS INT) WHEN 0 THEN 'Company became INSOLVENT' WHEN 1 THEN 'owed a Duty of Care' WHEN 2 THEN 'failed to pay'
    WHEN 3 THEN 'claims Damages' WHEN 4 THEN 'is liable' WHEN 5 THEN 'time-barred claim' WHEN 6 THEN 'έχει δικαιοδοσία' WHEN 7 THEN 'wants an injunction' WHEN 8 THEN 'he had a duty' WHEN 9 THEN 'of care for her' ELSE 'nothing here' END AS text,
  CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'proposed' ELSE 'rejected' END AS status FROM {orders}
"""
INPUTS["issues_now"] = """
SELECT c_custkey AS matter_id, 'Is the defendant liable to the claimant and on what legal basis?' AS text, 'accepted' AS status FROM {customer} WHERE c_nationkey < 8
"""


ORACLE_PARTS["issue_words"] = "SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}')".format(word, issue.replace("'", "''")) for words, issue in fixed.ISSUE_RULES for word in words
) + ") r(word, issue)"


@query("suggest_issues", """
SELECT i.matter_id, i.issue AS text, coalesce(e.status, 'proposed') AS status, e.status IS NULL AS created FROM (
  SELECT DISTINCT matter_id, issue FROM (
    SELECT matter_id, lower(string_agg(text, ' ' ORDER BY fact_id)) AS body FROM {issue_facts} WHERE status = 'accepted' GROUP BY matter_id)
  JOIN {issue_words} ON contains(body, word)) i
LEFT JOIN {issues_now} e ON e.matter_id = i.matter_id AND e.text = i.issue""")
def suggest_issues(src):
    return M.suggest_issues(src.issue_facts, src.issues_now)


INPUTS["fact_decisions"] = """
SELECT l_orderkey AS fact_id, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'maybe' END AS status, l_shipdate AS ts,
  l_linenumber * 10000000 + l_partkey AS decision_id FROM {lineitem}
"""


@query("review_state", """
SELECT o_orderkey AS fact_id, coalesce(status, 'proposed') AS status FROM {orders}
LEFT JOIN (SELECT fact_id, arg_max(status, (ts, decision_id)) AS status FROM {fact_decisions} WHERE status <> 'maybe' GROUP BY fact_id) ON fact_id = o_orderkey""")
def review_state(src):
    return M.review_state(src.orders.select(F.col("o_orderkey").alias("fact_id")), src.fact_decisions)


INPUTS["authority_log"] = """
SELECT user_id % 10 AS org_id, user_id AS matter_id, concat('law-', CAST(event_id % 40 AS STRING)) AS canonical_ref, event_id, ts,
  CASE event_type WHEN 'signup' THEN 'save' WHEN 'click' THEN 'save' WHEN 'view' THEN 'suggest' ELSE 'classify' END AS action,
  CASE WHEN event_type = 'error' THEN 'bogus' WHEN event_type = 'click' THEN NULL WHEN event_id % 3 = 0 THEN 'adverse' WHEN event_id % 3 = 1 THEN 'supporting' ELSE 'neutral' END AS value,
  CASE WHEN event_id % 2 = 0 THEN 'reviewer' ELSE NULL END AS basis, CASE WHEN event_id % 4 = 0 THEN 'CY' ELSE NULL END AS jurisdiction, 'legislation' AS authority_type,
  CASE WHEN event_id % 5 = 0 THEN 'private' ELSE NULL END AS source_scope, concat('name ', CAST(event_id AS STRING)) AS authority_name,
  CASE WHEN event_id % 6 = 0 THEN concat('note ', CAST(event_id AS STRING)) ELSE NULL END AS lawyer_note, concat('issue ', CAST(event_id % 9 AS STRING)) AS matter_issue, props AS evidence
FROM {events}
"""
ORACLE_PARTS["state"] = """
SELECT org_id, matter_id, canonical_ref, arg_max(authority_name, (ts, event_id)) FILTER (action = 'save') AS authority_name,
  arg_max(lawyer_note, (ts, event_id)) FILTER (action = 'save' AND lawyer_note IS NOT NULL) AS lawyer_note,
  coalesce(arg_max(source_scope, (ts, event_id)) FILTER (action = 'save' AND source_scope IS NOT NULL), 'public') AS source_scope,
  coalesce(arg_max(value, (ts, event_id)) FILTER (action = 'classify'), nullif(arg_min(CASE WHEN action = 'save' THEN coalesce(value, '') ELSE '' END, (ts, event_id)), ''), 'unclassified') AS classification,
  arg_max(value, (ts, event_id)) FILTER (action = 'suggest') AS suggestion,
  arg_max(coalesce(basis, 'MODEL_INFERENCE'), (ts, event_id)) FILTER (action = 'suggest') AS suggestion_provenance, min(ts) AS saved_at
FROM {authority_log} WHERE value IS DISTINCT FROM 'bogus' GROUP BY ALL
"""
STATE = ["org_id", "matter_id", "canonical_ref", "authority_name", "lawyer_note", "source_scope", "classification", "suggestion", "suggestion_provenance"]


@query("authority_state", f"SELECT {', '.join(STATE)} FROM {{state}}")
def authority_state(src):
    return M.authority_state(src.authority_log).select(*STATE)


@query("authority_list", "SELECT org_id, matter_id, canonical_ref, classification FROM {state} WHERE classification = 'adverse'")
def authority_list(src):
    return M.authority_list(M.authority_state(src.authority_log), "adverse").select("org_id", "matter_id", "canonical_ref", "classification")


@query("authority_folders", """
SELECT org_id, matter_id, classification, canonical_ref, authority_name, count(*) OVER (PARTITION BY org_id, matter_id, classification) AS folder_size FROM {state}""")
def authority_folders(src):
    return M.authority_folders(M.authority_state(src.authority_log)).drop("saved_at")


INPUTS["notes"] = """
SELECT event_id AS notification_id, user_id % 7 AS org_id, ts AS created_at, CASE WHEN event_type = 'view' THEN ts ELSE NULL END AS read_at, event_type AS kind FROM {events}
"""


@query("notifications", """
SELECT notification_id, org_id, kind, read_at IS NOT NULL AS is_read, row_number() OVER (PARTITION BY org_id ORDER BY created_at DESC, notification_id DESC) AS rank FROM {notes} QUALIFY rank <= 50""")
def notifications(src):
    return M.notifications(src.notes).drop("created_at", "read_at")


INPUTS["new_items"] = """
SELECT concat('k', CAST(event_id % 500 AS STRING)) AS follow_key, concat('ref-', CAST(event_id AS STRING)) AS reference, ts FROM {events}
"""
INPUTS["follows"] = """
SELECT c_nationkey AS org_id, concat('k', CAST(c_custkey % 300 AS STRING)) AS follow_key FROM {customer}
"""


@query("follow_alerts", """
SELECT org_id, follow_key, reference, items FROM (SELECT DISTINCT org_id, follow_key FROM {follows})
JOIN (SELECT follow_key, arg_max(reference, (ts, reference)) AS reference, count(*) AS items FROM {new_items} GROUP BY ALL) USING (follow_key)""")
def follow_alerts(src):
    return M.follow_alerts(src.new_items, src.follows).select("org_id", "follow_key", "reference", "items")


# Memos: the orders of a customer are facts, issues or citations by their status.
INPUTS["memo_facts"] = "SELECT o_custkey AS matter_id, o_orderkey AS pos, concat('fact ', o_orderpriority) AS text FROM {orders} WHERE o_orderstatus = 'F'"
INPUTS["memo_issues"] = "SELECT o_custkey AS matter_id, o_orderkey AS pos, concat('issue ', o_orderpriority) AS text FROM {orders} WHERE o_orderstatus = 'P'"
INPUTS["memo_cites"] = "SELECT o_custkey AS matter_id, o_orderkey AS pos, cite FROM {orders} JOIN {citation_texts} ON text_id = o_orderkey WHERE o_orderstatus = 'O'"
ORACLE_PARTS["memo_resolved"] = """
SELECT m.matter_id, m.pos, m.cite, canonical_ref, title, substr(body, 1, 300) AS text FROM {memo_cites} m JOIN {cite_keys} k ON k.text_id = m.pos
LEFT JOIN (SELECT key, min(canonical_ref) AS canonical_ref, min_by(title, canonical_ref) AS title, min_by(body, canonical_ref) AS body FROM {entry_keys} GROUP BY key) USING (key)
"""
ORACLE_PARTS["memo_matters"] = "SELECT matter_id FROM {memo_facts} UNION SELECT matter_id FROM {memo_issues} UNION SELECT matter_id FROM {memo_cites}"


@query("assemble_memo", """
SELECT matter_id, part, 0 AS pos, sub, line FROM {memo_matters} CROSS JOIN (VALUES (0, 0, 'RESEARCH MEMO (draft)'), (0, 1, repeat('=', 21)), (0, 2, ''), (0, 3, 'FACTS (accepted matter facts):'),
  (2, 0, ''), (2, 1, 'ISSUES:'), (4, 0, ''), (4, 1, 'SUPPORTING AUTHORITIES (verified against corpus):')) t(part, sub, line)
UNION ALL SELECT matter_id, 1, pos, 0, concat('  • ', text) FROM {memo_facts}
UNION ALL SELECT matter_id, 1, 0, 0, '  (none)' FROM {memo_matters} WHERE matter_id NOT IN (SELECT matter_id FROM {memo_facts})
UNION ALL SELECT matter_id, 3, pos, 0, concat('  • ', text) FROM {memo_issues}
UNION ALL SELECT matter_id, 3, 0, 0, '  (none)' FROM {memo_matters} WHERE matter_id NOT IN (SELECT matter_id FROM {memo_issues})
UNION ALL SELECT matter_id, 5, pos, 0, concat('  • ', cite, ' — ', title, ' [', canonical_ref, ']') FROM {memo_resolved} WHERE canonical_ref IS NOT NULL
UNION ALL SELECT matter_id, 5, pos, 1, concat('      ', text) FROM {memo_resolved} WHERE canonical_ref IS NOT NULL
UNION ALL SELECT matter_id, 5, 0, 0, '  • No verified authority could be cited for this matter.' FROM {memo_matters} WHERE matter_id NOT IN (SELECT matter_id FROM {memo_resolved} WHERE canonical_ref IS NOT NULL)
UNION ALL SELECT matter_id, 9, pos, 0, concat('rejected: ', cite) FROM {memo_resolved} WHERE canonical_ref IS NULL""")
def assemble_memo(src):
    return M.assemble_memo(src.memo_facts, src.memo_issues, src.memo_cites, src.entries).drop("lawyer_review_required")


# Results to answer from: each judgment's number is a query with one provision and one judgment as results.
INPUTS["answer_queries"] = """
SELECT CAST(conv_id AS BIGINT) AS query_id, CASE CAST(conv_id % 3 AS INT) WHEN 0 THEN 'which status duty is there' WHEN 1 THEN 'Awarding damages or costs' ELSE 'zzz qqq duty' END AS query FROM {judgments}
"""
INPUTS["answer_results"] = """
SELECT CAST(conv_id AS BIGINT) AS query_id, CAST(conv_id % 10 AS BIGINT) AS matter_id, concat('law-', CAST(conv_id AS STRING), '-art-', CAST(conv_id % 40 + 1 AS STRING)) AS canonical_ref,
  CAST(NULL AS STRING) AS case_key, 1 AS rank, CASE WHEN conv_id % 2 = 0 THEN DATE '1998-01-01' ELSE NULL END AS query_date FROM {judgments}
UNION ALL SELECT CAST(conv_id AS BIGINT), CAST(conv_id % 10 AS BIGINT), concat('judgment-ECLI:CY:AD:2019:A', CAST(conv_id + 1 AS STRING)), concat('judgment-', CAST(conv_id + 1 AS STRING)), 2, NULL FROM {judgments}
"""
ORACLE_PARTS["evidence"] = """
SELECT r.query_id, r.canonical_ref, r.rank, 'judgment_paragraph' AS type, p.para_number AS pos, p.text FROM {answer_results} r
JOIN {judgments} j ON r.canonical_ref = concat('judgment-', j.ecli) JOIN {paragraphs} p USING (case_id)
UNION ALL SELECT query_id, canonical_ref, rank, 'provision', 0, source_text FROM (
  SELECT r.*, c.version_id FROM {answer_results} r JOIN {chain} c ON c.law = split_part(substr(r.canonical_ref, 5), '-art-', 1) WHERE r.rank = 1
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY (effective_from <= coalesce(query_date, DATE '2020-01-01')
    AND (effective_to IS NULL OR coalesce(query_date, DATE '2020-01-01') < effective_to)) DESC, effective_from DESC, version_number DESC) = 1) x
JOIN {wording} w ON w.version_id = x.version_id AND w.node_type = 'ARTICLE' AND w.number = split_part(x.canonical_ref, '-art-', 2)
"""


def named_paragraphs(src: Source):
    dealt = src.over(conversations=spread(src.conversations, SPREAD_ROWS))
    return paragraphs(dealt, keep=True).withColumnRenamed("case_id", "canonical_id")


def evidence(src: Source, results=None):
    results = src.answer_results if results is None else results
    named = of_laws(src, results.select(T.ref_law("canonical_ref").alias("law")).filter("law IS NOT NULL").distinct())
    return M.attach_evidence(
        results, aliases(src), named_paragraphs(src), spans(named), lambda wanted: arrived_wording(named, wanted), F.lit("2020-01-01").cast("date"),
        disjoint=True,
    )


@query("attach_evidence", "SELECT query_id, canonical_ref, type, pos, text FROM {evidence}")
def attach_evidence(src):
    return evidence(src).select("query_id", "canonical_ref", "type", "pos", "text")


INPUTS["law_titles"] = "SELECT law, min(title) AS title, min(jurisdiction) AS jurisdiction FROM {law_source} GROUP BY law"
INPUTS["judgment_treatments"] = "SELECT concat(CAST(conv_id AS STRING), '/2019') AS source_key, 'OVERRULES' AS treatment FROM {conversations}"


@query("authority_detail", """
SELECT r.canonical_ref, 'judgment' AS authority_type, j.title AS name, j.court, coalesce(a.n, 0) AS cited, coalesce(b.n, 0) AS citing, coalesce(t.n, 0) AS treatments, coalesce(l.n, 0) AS legislation_links
FROM (SELECT DISTINCT canonical_ref FROM {answer_results} WHERE rank = 2) r LEFT JOIN {judgments} j ON r.canonical_ref = concat('judgment-', j.ecli)
LEFT JOIN (SELECT source_key, count(*) AS n FROM {judgment_citations} GROUP BY ALL) a ON a.source_key = j.case_id
LEFT JOIN (SELECT target_key, count(*) AS n FROM {judgment_citations} GROUP BY ALL) b ON b.target_key = j.ecli
LEFT JOIN (SELECT source_key, count(*) AS n FROM {judgment_treatments} GROUP BY ALL) t ON t.source_key = j.case_number
LEFT JOIN (SELECT judgment_key, count(*) AS n FROM {judgment_links} GROUP BY ALL) l ON l.judgment_key = j.case_id
UNION ALL SELECT DISTINCT canonical_ref, 'legislation', concat('Law of customer ', split_part(substr(canonical_ref, 5), '-art-', 1)), NULL, 0, 0, 0, 0 FROM {answer_results} WHERE rank = 1""")
def authority_detail(src):
    judgments = src.judgments.withColumnRenamed("case_id", "canonical_id")
    out = M.authority_detail(
        src.answer_results, aliases(src), judgments, src.law_titles, src.judgment_citations, src.judgment_treatments, src.judgment_links
    )
    return out.select("canonical_ref", "authority_type", "name", "court", "cited", "citing", "treatments", "legislation_links")


@query("research", """
SELECT h.query_id, h.rank, h.canonical_ref, coalesce(j.title, concat('Law of customer ', split_part(substr(h.canonical_ref, 5), '-art-', 1))) AS name,
  CAST(CASE WHEN j.case_id IS NOT NULL THEN (SELECT count(*) FROM {paragraphs} p WHERE p.case_id = j.case_id)
    ELSE (SELECT count(*) FROM {wording} w WHERE w.version_id = coalesce(h.version_id, (SELECT c.version_id FROM {chain} c WHERE c.law = split_part(substr(h.canonical_ref, 5), '-art-', 1) AND c.effective_to IS NULL))
      AND w.node_type = 'ARTICLE' AND w.number = split_part(h.canonical_ref, '-art-', 2)) END AS BIGINT) AS evidence_rows
FROM {hybrid_dated} h LEFT JOIN {judgments} j ON h.canonical_ref = concat('judgment-', j.ecli)""")
def research(src):
    results = durable(hybrid(src))
    judgments = src.judgments.withColumnRenamed("case_id", "canonical_id")
    detail = M.authority_detail(
        results, aliases(src), judgments, src.law_titles, src.judgment_citations, src.judgment_treatments, src.judgment_links
    )
    counts = evidence(src, results).groupBy("query_id", "canonical_ref").agg(F.count(F.lit(1)).alias("evidence_rows"))
    out = results.join(detail.select("canonical_ref", "name"), "canonical_ref").join(counts, ["query_id", "canonical_ref"], "left")
    return out.select("query_id", "rank", "canonical_ref", "name", F.coalesce("evidence_rows", F.lit(0)).alias("evidence_rows"))


ORACLE_PARTS["qualifying"] = r"""
SELECT query_id, canonical_ref, rank FROM (SELECT e.query_id, canonical_ref, rank, lower(text) AS l, unnest(list_distinct(regexp_extract_all(lower(query), '[a-z\x{0370}-\x{03ff}]{3,}'))) AS w
  FROM {evidence} e JOIN {answer_queries} q USING (query_id)) WHERE contains(l, w) GROUP BY ALL HAVING count(DISTINCT w) >= 2
"""


@query("grounded_answer", f"""
SELECT e.query_id, 'answer' AS part, pos, canonical_ref, trim(text) AS text, 'SOURCE FACT' AS provenance FROM {{evidence}} e
JOIN (SELECT query_id, min(rank) AS rank FROM {{qualifying}} GROUP BY ALL) USING (query_id, rank)
UNION ALL SELECT query_id, 'proposition', row_number() OVER (PARTITION BY query_id ORDER BY rank, pos, canonical_ref) AS n, canonical_ref, text, 'SOURCE FACT' FROM (
  SELECT query_id, trim(text) AS text, min(rank) AS rank, min_by(pos, (rank, pos)) AS pos, min_by(canonical_ref, (rank, pos)) AS canonical_ref
  FROM {{evidence}} JOIN {{qualifying}} USING (query_id, canonical_ref, rank) GROUP BY query_id, trim(text)) QUALIFY n <= 12
UNION ALL SELECT query_id, 'message', 0, NULL, '{fixed.NOT_ANSWERED}', 'MODEL_INFERENCE' FROM {{answer_queries}} WHERE query_id NOT IN (SELECT query_id FROM {{qualifying}})
UNION ALL SELECT query_id, 'adverse', 0, m.canonical_ref, matter_issue, 'LAWYER DECISION' FROM (SELECT DISTINCT query_id, matter_id FROM {{answer_results}}) JOIN {{matter_authorities}} m USING (matter_id) WHERE classification = 'adverse'
UNION ALL SELECT query_id, 'adverse', 0, canonical_ref, treatment, 'STRUCTURED_EXTRACTION' FROM {{answer_results}} r JOIN {{treatments}} t ON t.source_key = r.case_key
WHERE treatment = 'OVERRULES' AND ((query_id, canonical_ref) IN (SELECT query_id, canonical_ref FROM {{qualifying}}) OR query_id NOT IN (SELECT query_id FROM {{qualifying}}))""")
def grounded_answer(src):
    treatments = G.normalize_treatments(src.raw_treatments)
    return M.grounded_answer(src.answer_queries, src.answer_results, evidence(src), treatments, src.matter_authorities)


INPUTS["research_facts"] = "SELECT doc_id % 40 AS query_id, CASE WHEN quality = 1 THEN 'accepted' ELSE 'proposed' END AS status FROM {labels}"


ORACLE_PARTS["research_top"] = """
SELECT query_id, count(*) AS n, min_by(canonical_ref, (-score, canonical_ref)) AS canonical_ref FROM (
  SELECT query_id, canonical_ref, score FROM {found}
  UNION ALL SELECT l.query_id, l.canonical_ref, l.score FROM {question_lexical} l LEFT JOIN (SELECT DISTINCT query_id, canonical_ref, true AS exact FROM {found}) f
    ON f.query_id = l.query_id AND f.canonical_ref = l.canonical_ref WHERE f.exact IS NULL)
GROUP BY query_id
"""


@query("grounded_research", """
SELECT q.query_id, t.canonical_ref IS NOT NULL AS supported, CASE WHEN t.canonical_ref IS NULL THEN 'No sufficiently supported authority was found for this question in the curated public corpus.'
    ELSE concat('Based on the retrieved authority ''', e.title, ''' (', t.canonical_ref, '), the supporting text states: ', substr(e.body, 1, 400)) END AS answer,
  t.canonical_ref IS NOT NULL AND coalesce(n, 0) > 0 AS has_authorities, coalesce(f.n_facts, 0) AS accepted_facts
FROM {questions} q LEFT JOIN {research_top} t USING (query_id)
LEFT JOIN {entries} e ON e.canonical_ref = t.canonical_ref
LEFT JOIN (SELECT query_id, count(*) AS n_facts FROM {research_facts} WHERE status = 'accepted' GROUP BY ALL) f USING (query_id)""")
def grounded_research(src):
    out = M.grounded_research(src.questions, src.entries, src.research_facts, 10, index_of(src, "entries"))
    return out.select("query_id", "supported", "answer", (F.col("authorities") > 0).alias("has_authorities"), "accepted_facts")
