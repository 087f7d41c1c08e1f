"""Structure and versions of laws and judgments."""

from pyspark.sql import functions as F

from ..operators import structure as S, temporal as V
from ..scale import SPREAD_ROWS, month_block, position_block, spread
from ..session import stored
from . import inputs  # noqa: F401
from .base import ORACLE_PARTS, Source, query

# Distinct texts per law in order of arrival.
ORACLE_PARTS["chain"] = """
SELECT *, row_number() OVER w AS version_number, lead(effective_from) OVER w AS effective_to,
  lag(version_id) OVER w AS supersedes
FROM (SELECT *, sha256(concat(law, ':', content_hash)) AS version_id FROM (
  SELECT *, sha256(raw_text) AS content_hash,
    row_number() OVER (PARTITION BY law, raw_text ORDER BY effective_from, arrival) AS rn
  FROM {law_source}) WHERE rn = 1)
WINDOW w AS (PARTITION BY law ORDER BY effective_from, arrival)
"""
ORACLE_PARTS["texts"] = """
SELECT arrival, law, 'ARTICLE' AS node_type, a AS number, NULL AS parent_article,
  concat(l_body, chr(10), l_loose) AS source_text, 1 AS sort_order FROM {law_lines}
UNION ALL SELECT arrival, law, 'PARAGRAPH', '1', a, l_para, 0 FROM {law_lines}
UNION ALL SELECT arrival, law, 'ARTICLE', b, NULL, l_last, 2 FROM {law_lines}
"""
ORACLE_PARTS["wording"] = """
SELECT t.*, c.version_id, c.version_number, c.effective_from, c.effective_to,
  sha256(concat(t.law, ':', node_type, ':', coalesce(parent_article, ''), ':', number)) AS node_id
FROM {texts} t JOIN {chain} c USING (arrival)
"""


def chain(src: Source):
    return V.version_chain(src.law_source, "law", ["effective_from", "arrival"], "raw_text", "effective_from")


def wording(src: Source):
    # The chain is made of keys and hashes; texts join it afterwards and are shuffled once.
    kept = chain(src).select(
        "law", "title", "jurisdiction", "arrival", "version_id", "version_number", "effective_from", "effective_to"
    )
    texts = spread(src.law_source.select("arrival", "raw_text"))
    return S.with_node_ids(S.split_provisions(texts.join(kept, "arrival")))


def of_laws(src: Source, laws):
    """The inputs with the texts of the laws (law) only, where nothing is asked of others."""
    orders = src.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return src.over(orders=stored(orders.join(laws, F.col("o_custkey").cast("string") == F.col("law"), "left_semi")))


def spans(src: Source):
    """When each version of `chain` is in force, under the arrival of its text."""
    return V.version_spans(src.law_source, "law", ["effective_from", "arrival"], "raw_text", "effective_from", "arrival")


def arrived_wording(src: Source, wanted=None):
    """The provisions of every arriving text, or of those `wanted` (version_id), for versions that go by their arrival: no chain is made for them."""
    # Orders are dealt, not the texts made of them, which are longer.
    orders = src.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    if wanted is not None:
        orders = stored(orders.join(wanted, F.col("o_orderkey") == F.col("version_id"), "left_semi"))
    texts = src.over(orders=spread(orders, SPREAD_ROWS)).law_source.select(F.col("arrival").alias("version_id"), "law", "raw_text")
    return S.with_node_ids(S.split_provisions(texts))


def paragraphs(src: Source, keep: bool = False):
    return S.segment_judgments(src.judgment_pieces, "case_id", "text", "turn", keep)


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


@query("split_provisions", "SELECT arrival, law, node_type, number, parent_article, source_text, sort_order FROM {texts}")
def split_provisions(src):
    return S.split_provisions(spread(src.law_source.select("arrival", "law", "raw_text"), SPREAD_ROWS))


@query("provision_nodes", """
SELECT law, node_type, number, parent_article, min(arrival) AS first_seen,
  sha256(concat(law, ':', node_type, ':', coalesce(parent_article, ''), ':', number)) AS node_id,
  CASE WHEN parent_article IS NOT NULL THEN sha256(concat(law, ':ARTICLE::', parent_article)) END AS parent_id
FROM {texts} GROUP BY ALL""")
def provision_nodes(src):
    split = S.split_provisions(spread(src.law_source.select("arrival", "law", "raw_text"), SPREAD_ROWS))
    return S.provision_nodes(split).drop("sort_order")


@query("version_chain", """
SELECT law, arrival, version_number, content_hash, version_id, supersedes,
  CASE WHEN effective_to IS NULL THEN 'current' ELSE 'superseded' END AS status,
  strftime(effective_from, '%Y-%m-%d') AS effective_from, strftime(effective_to, '%Y-%m-%d') AS effective_to
FROM {chain}""")
def version_chain(src):
    return chain(src).select(
        "law", "arrival", "version_number", "content_hash", "version_id", "supersedes", "status",
        day("effective_from").alias("effective_from"), day("effective_to").alias("effective_to"),
    )


# A probe per order line: the law of the order, the day the line shipped.
PROBES = """
SELECT DISTINCT l_orderkey AS order_key, l_linenumber AS line_number, CAST(o_custkey AS STRING) AS law,
  CAST(l_shipdate AS DATE) AS as_of FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""
inputs.INPUTS["probes"] = PROBES
ORACLE_PARTS["resolved"] = """
SELECT p.order_key, p.line_number, p.law, p.as_of, c.version_id, c.version_number, c.effective_from, c.effective_to,
  (c.effective_from <= p.as_of AND (c.effective_to IS NULL OR p.as_of < c.effective_to)) AS applicable
FROM {probes} p JOIN {chain} c ON p.law = c.law
QUALIFY row_number() OVER (PARTITION BY order_key, line_number, p.as_of
  ORDER BY applicable DESC, c.effective_from DESC, c.version_number DESC) = 1
"""


@query("resolve_as_of", """
SELECT order_key, line_number, law, strftime(as_of, '%Y-%m-%d') AS as_of, version_number, applicable FROM {resolved}""")
def resolve_as_of(src):
    out = V.resolve_as_of(src.probes, spans(src).drop("version_id"), disjoint=True)
    return out.select("order_key", "line_number", "law", day("as_of").alias("as_of"), "version_number", "applicable")


@query("provisions_as_of", """
SELECT r.order_key, r.line_number, r.version_number, w.node_type, w.number, w.source_text, w.sort_order
FROM {resolved} r JOIN {wording} w USING (version_id)""")
def provisions_as_of(src):
    out = V.provisions_as_of(src.probes, spans(src), arrived_wording(src), disjoint=True)
    return out.select("order_key", "line_number", "version_number", "node_type", "number", "source_text", "sort_order")


# Lines only one side has, with repeats; kept lines of these texts never change their order.
ORACLE_PARTS["text_changes"] = """
SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.node_id, b.node_id) AS node_id, a.t AS old_text, b.t AS new_text
FROM (SELECT c.version_id AS pair_id, w.node_id, w.source_text AS t FROM {chain} c JOIN {wording} w ON c.supersedes = w.version_id) a
FULL JOIN (SELECT c.version_id AS pair_id, w.node_id, w.source_text AS t FROM {chain} c JOIN {wording} w ON c.version_id = w.version_id WHERE c.supersedes IS NOT NULL) b
ON a.pair_id = b.pair_id AND a.node_id = b.node_id WHERE a.t IS DISTINCT FROM b.t
"""
ORACLE_PARTS["line_counts"] = """
SELECT pair_id, node_id, line, sum(old) AS old, sum(new) AS new FROM (
  SELECT pair_id, node_id, unnest(string_split(old_text, chr(10))) AS line, 1 AS old, 0 AS new FROM {text_changes} WHERE old_text IS NOT NULL
  UNION ALL SELECT pair_id, node_id, unnest(string_split(new_text, chr(10))), 0, 1 FROM {text_changes} WHERE new_text IS NOT NULL) GROUP BY ALL
"""


@query("diff_versions", """
SELECT pair_id, node_id, old_text, new_text, CAST(coalesce(removed, 0) AS INT) AS removed, CAST(coalesce(added, 0) AS INT) AS added FROM {text_changes}
LEFT JOIN (SELECT pair_id, node_id, sum(greatest(old - new, 0)) AS removed, sum(greatest(new - old, 0)) AS added FROM {line_counts} GROUP BY ALL) USING (pair_id, node_id)""")
def diff_versions(src):
    return text_diff(src).select(
        "pair_id", "node_id", "old_text", "new_text", F.size("removed_lines").alias("removed"),
        F.size("added_lines").alias("added"),
    )


def text_diff(src: Source):
    pairs = V.version_pairs(src.law_source, "law", ["effective_from", "arrival"], "raw_text", "arrival", month_block("effective_from"))
    return V.diff_texts(pairs, spread(src.law_source.select("arrival", "raw_text")), "law", "arrival", "raw_text")


@query("line_changes", """
SELECT pair_id, node_id, CASE WHEN old > new THEN '-' ELSE '+' END AS sign, line, abs(old - new) AS times FROM {line_counts} WHERE old <> new""")
def line_changes(src):
    rows = V.line_changes(text_diff(src))
    # Ids are shuffled as bytes, which is half of their hexadecimal form.
    ids = {c: F.unhex(c) for c in ("pair_id", "node_id")}
    counts = rows.withColumns(ids).groupBy("pair_id", "node_id", "sign", "line").agg(F.count(F.lit(1)).alias("times"))
    return counts.withColumns({c: F.lower(F.hex(c)) for c in ids})


@query("changed_counts", "SELECT pair_id, count(*) AS changed_nodes FROM {text_changes} GROUP BY pair_id")
def changed_counts(src):
    return V.changed_counts(text_diff(src))


# Amendments: a part is a law with one article, an order line an event on it, in order of shipping.
inputs.INPUTS["amendment_base"] = """
SELECT CAST(p_partkey AS STRING) AS law, 'ARTICLE' AS node_type, CAST(p_size % 7 + 1 AS STRING) AS number,
  concat('Base text of ', p_name) AS source_text
FROM {part}
"""
inputs.INPUTS["amendment_laws"] = """
SELECT CAST(p_partkey AS STRING) AS law, 1 AS version_number FROM {part}
"""
inputs.INPUTS["amendment_events"] = """
SELECT CAST(l_partkey AS STRING) AS law, (l_orderkey * 8 + l_linenumber) * 64 + CAST(l_quantity AS BIGINT) AS event_id,
  CASE WHEN l_quantity = 50 AND l_linenumber = 1 THEN 'REPEAL' WHEN l_quantity = 49 THEN 'ANNOTATE'
       WHEN l_linenumber = 1 THEN 'REPLACE' WHEN l_linenumber = 2 THEN 'INSERT' WHEN l_linenumber = 3 THEN 'DELETE'
       WHEN l_linenumber = 4 THEN 'RENUMBER' WHEN l_linenumber = 5 THEN 'COMMENCE' ELSE 'REPLACE' END AS operation,
  CAST(l_shipdate AS DATE) AS effective_date,
  CASE WHEN l_linenumber = 5 OR l_quantity = 50 THEN NULL ELSE 'ARTICLE' END AS node_type,
  CASE WHEN l_linenumber = 5 OR l_quantity = 50 THEN NULL
    ELSE CAST(l_suppkey % 7 + CASE WHEN l_quantity % 3 = 0 THEN 100 ELSE 1 END AS STRING) END AS number,
  concat('Text ', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING)) AS new_text,
  CASE WHEN l_linenumber = 4 THEN CAST(l_orderkey % 3 + l_suppkey % 5 + CASE WHEN l_tax > 0.04 THEN 100 ELSE 1 END AS STRING) ELSE NULL END AS renumber_to
FROM {lineitem}
"""
# Every law replayed event by event: `slots` are its provisions with the number that each has now.
ORACLE_PARTS["event_order"] = """
SELECT *, row_number() OVER (PARTITION BY law ORDER BY effective_date, event_id) AS n FROM {amendment_events} WHERE operation <> 'ANNOTATE'
"""
ORACLE_PARTS["replayed"] = """
WITH RECURSIVE run AS (
  SELECT law, CAST(0 AS BIGINT) AS n, list({'num': number, 'id': number, 'txt': source_text}) AS slots,
    CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS before FROM {amendment_base} GROUP BY law
  UNION ALL
  SELECT law, n,
    CASE WHEN node_type IS NULL THEN slots
      WHEN hit IS NULL AND operation = 'INSERT' THEN list_append(slots, {'num': number, 'id': concat('e', event_id), 'txt': new_text})
      WHEN hit IS NULL THEN slots
      WHEN operation = 'RENUMBER' THEN list_transform(slots, lambda s: {'num': CASE WHEN s.num = number THEN renumber_to WHEN s.num = renumber_to THEN NULL ELSE s.num END, 'id': s.id, 'txt': s.txt})
      WHEN operation IN ('INSERT', 'DELETE', 'REPLACE') THEN list_transform(slots, lambda s: {'num': s.num, 'id': s.id,
        'txt': CASE WHEN s.num IS DISTINCT FROM number THEN s.txt WHEN operation = 'INSERT' THEN new_text WHEN operation = 'REPLACE' AND s.txt IS NOT NULL THEN new_text END})
      ELSE slots END,
    event_id, CASE WHEN node_type IS NULL THEN NULL WHEN hit IS NOT NULL THEN hit.id WHEN operation = 'INSERT' THEN concat('e', event_id) END, hit.txt
  FROM (SELECT e.*, run.slots, list_filter(run.slots, lambda s: s.num = e.number)[1] AS hit FROM run JOIN {event_order} e ON e.law = run.law AND e.n = run.n + 1))
SELECT * FROM run WHERE n > 0
"""
ORACLE_PARTS["event_reasons"] = """
SELECT e.*, r.id, r.before, CASE WHEN e.operation = 'ANNOTATE' THEN 'unknown operation' WHEN e.node_type IS NOT NULL AND r.id IS NULL THEN 'provision not found' END AS reason
FROM {amendment_events} e LEFT JOIN {replayed} r USING (law, event_id)
"""
ORACLE_PARTS["event_status"] = """
SELECT r.*, coalesce(reason, CASE WHEN (effective_date, event_id) > repealed THEN 'no current version' END) AS why
FROM {event_reasons} r
LEFT JOIN (SELECT law, min((effective_date, event_id)) AS repealed FROM {event_reasons}
           WHERE reason IS NULL AND operation = 'REPEAL' GROUP BY law) USING (law)
"""
ORACLE_PARTS["versions_made"] = """
SELECT *, 1 + row_number() OVER w AS version_number, lead(effective_date) OVER w AS next_date
FROM {event_status} WHERE why IS NULL WINDOW w AS (PARTITION BY law ORDER BY effective_date, event_id)
"""
ORACLE_PARTS["amended"] = """
SELECT law, version_number, event_id, operation, number, renumber_to, id,
  strftime(effective_date, '%Y-%m-%d') AS effective_from, strftime(next_date, '%Y-%m-%d') AS effective_to,
  CASE WHEN operation = 'REPEAL' THEN 'repealed' WHEN next_date IS NULL THEN 'current' ELSE 'superseded' END AS status,
  before AS previous_text, CASE WHEN id IS NULL OR operation = 'DELETE' THEN NULL WHEN operation = 'INSERT' OR (operation = 'REPLACE' AND before IS NOT NULL) THEN new_text
    ELSE before END AS text_after,
  id IS NOT NULL AND (operation IN ('INSERT', 'DELETE') OR (operation = 'REPLACE' AND before IS NOT NULL)) AS changed
FROM {versions_made}
"""


@query("apply_amendments", "SELECT law, version_number, event_id, operation, number, renumber_to, effective_from, effective_to, status, previous_text, text_after, changed FROM {amended}")
def apply_amendments(src):
    out = V.apply_amendments(src.amendment_laws, src.amendment_base, src.amendment_events)
    return out.drop("node_type", "new_text", "identity", "next_change").withColumn("effective_from", day("effective_from")).withColumn(
        "effective_to", day("effective_to")
    )


@query("amended_wording", """
SELECT law, number, from_version, coalesce(to_version, -1) AS to_version, text FROM (
  SELECT *, lead(from_version) OVER (PARTITION BY law, id ORDER BY from_version) AS to_version FROM (
    SELECT law, CASE WHEN operation = 'RENUMBER' THEN renumber_to ELSE number END AS number, id, version_number AS from_version, text_after AS text
    FROM {amended} WHERE changed OR (operation = 'RENUMBER' AND id IS NOT NULL AND renumber_to <> number)
    UNION ALL SELECT law, number, number, 1, source_text FROM {amendment_base}))
WHERE text IS NOT NULL""")
def amended_wording(src):
    made = V.apply_amendments(src.amendment_laws, src.amendment_base, src.amendment_events)
    out = V.amended_wording(src.amendment_laws, src.amendment_base, made)
    return out.select("law", "number", "from_version", F.coalesce("to_version", F.lit(-1)).alias("to_version"), "text")


@query("rejected_amendments", """
SELECT law, event_id, operation, why AS reason FROM {event_status} WHERE why IS NOT NULL""")
def rejected_amendments(src):
    _, rejected = V.number_amendments(src.amendment_events, src.amendment_laws, src.amendment_base)
    return rejected.select("law", "event_id", "operation", "reason")


@query("amendment_history", """
SELECT law, event_id, operation, strftime(effective_date, '%Y-%m-%d') AS effective_date, new_text FROM {amendment_events}""")
def amendment_history(src):
    out = V.amendment_history(src.amendment_events)
    return out.select("law", "event_id", "operation", day("effective_date").alias("effective_date"), "new_text")


# Judgments in the oracle: lines with running counts.
ORACLE_PARTS["case_lines"] = r"""
SELECT case_id, turn, pos, line, CASE regexp_replace(lower(line), '[:.]+$', '')
    WHEN 'the facts' THEN 'facts' WHEN 'procedural history' THEN 'procedural_history'
    WHEN 'legal analysis' THEN 'legal_analysis' WHEN 'holding' THEN 'holding' WHEN 'order' THEN 'order' END AS head
FROM (SELECT case_id, turn, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {judgment_pieces})
WHERE line <> ''
"""
ORACLE_PARTS["case_numbered"] = """
SELECT *, count(head) OVER w AS section_no, count(*) OVER w - count(head) OVER w AS para_number
FROM {case_lines} WINDOW w AS (PARTITION BY case_id ORDER BY turn, pos ROWS UNBOUNDED PRECEDING)
"""
ORACLE_PARTS["paragraphs"] = """
SELECT n.case_id, n.section_no, coalesce(h.head, 'body') AS section_type, h.line AS section_title, n.para_number,
  n.para_number - coalesce(h.para_number, 0) AS para_in_section, n.line AS text
FROM {case_numbered} n LEFT JOIN {case_numbered} h
  ON h.head IS NOT NULL AND n.case_id = h.case_id AND n.section_no = h.section_no
WHERE n.head IS NULL
"""


@query("segment_judgments", "SELECT * FROM {paragraphs}")
def segment_judgments(src):
    return paragraphs(src)


inputs.INPUTS["judgment_texts"] = """
SELECT source AS judgment, doc_id, text FROM {documents}
"""


@query("judgment_versions", """
SELECT judgment, doc_id, version_number, supersedes, CASE WHEN nxt IS NULL THEN 'current' ELSE 'superseded' END AS status
FROM (SELECT *, row_number() OVER w AS version_number, lag(version_id) OVER w AS supersedes, lead(version_id) OVER w AS nxt
  FROM (SELECT judgment, doc_id, sha256(concat(judgment, ':', sha256(text))) AS version_id,
          row_number() OVER (PARTITION BY judgment, text ORDER BY doc_id) AS rn FROM {judgment_texts}) WHERE rn = 1
  WINDOW w AS (PARTITION BY judgment ORDER BY doc_id))""")
def judgment_versions(src):
    out = V.judgment_versions(src.judgment_texts, "judgment", ["doc_id"], "text", position_block("doc_id"))
    return out.select("judgment", "doc_id", "version_number", "supersedes", "status")


@query("judgment_segments", "SELECT case_id, section_no, section_type, para_number, text FROM {paragraphs}")
def judgment_segments(src):
    return S.judgment_segments(paragraphs(src), src.judgments, "case_id").select(
        "case_id", "section_no", "section_type", "para_number", "text"
    )


@query("judgment_sections", """
SELECT case_id, section_no, section_type, count(*) AS n_paragraphs, string_agg(concat(para_number, ':', text), '|' ORDER BY para_number) AS paragraphs
FROM {paragraphs} GROUP BY ALL""")
def judgment_sections(src):
    out = S.judgment_sections(paragraphs(src), src.judgments, "case_id")
    numbered = F.transform("paragraphs", lambda p: F.concat_ws(":", p["para_number"].cast("string"), p["text"]))
    return out.select(
        "case_id", "section_no", "section_type", F.size("paragraphs").cast("bigint").alias("n_paragraphs"), F.array_join(numbered, "|").alias("paragraphs")
    )


@query("extractive_summary", r"""
SELECT j.case_id, coalesce(s.rank, 1) AS rank, coalesce(s.section_type, 'holding') AS section,
  CAST(s.para_number AS STRING) AS para_number, coalesce(s.text, '(no extractive holding text available)') AS text
FROM {judgments} j LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pref, para_number) AS rank FROM (
    SELECT *, CASE section_type WHEN 'holding' THEN 1 WHEN 'legal_analysis' THEN 2 WHEN 'order' THEN 3 END AS pref,
      min(section_no) OVER (PARTITION BY case_id, section_type) AS first_no FROM {paragraphs})
  WHERE pref IS NOT NULL AND section_no = first_no
    AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 3
  QUALIFY rank <= 3) s USING (case_id)""")
def extractive_summary(src):
    return S.extractive_summary(paragraphs(src), src.judgments, "case_id")


CHUNK_FIELDS = "document_type, document_key, chunk_type, text, hierarchy_context, content_hash"


@query("build_chunks", """
SELECT 'legislation' AS document_type, law AS document_key, 'paragraph' AS chunk_type, source_text AS text,
  concat('Law: Law of customer ', law, chr(10), 'Jurisdiction: CY', chr(10), 'Article ', number) AS hierarchy_context,
  sha256(source_text) AS content_hash,
  sha256(concat_ws(':', 'L', law, version_id, 'paragraph', node_type, coalesce(parent_article, ''), number)) AS chunk_id
FROM {wording}
UNION ALL
SELECT 'judgment', case_id, 'paragraph', text, concat(title, chr(10), 'Section: ', section_type), sha256(text),
  sha256(concat_ws(':', 'J', case_id, version_id, 'paragraph', para_number, section_no))
FROM {paragraphs} JOIN {judgments} USING (case_id)
UNION ALL
SELECT 'judgment', case_id, 'section', string_agg(text, chr(10) ORDER BY para_number),
  concat(title, chr(10), 'Section: ', section_type), sha256(string_agg(text, chr(10) ORDER BY para_number)),
  sha256(concat_ws(':', 'J', case_id, version_id, 'section', 'sec', section_no))
FROM {paragraphs} JOIN {judgments} USING (case_id) GROUP BY case_id, title, version_id, section_no, section_type""")
def build_chunks(src):
    out = S.build_chunks(wording(src), paragraphs(src), src.judgments, "case_id")
    return out.select(*CHUNK_FIELDS.split(", "), "chunk_id")


inputs.INPUTS["nation_codes"] = """
SELECT n_nationkey, CASE r_name WHEN 'EUROPE' THEN 'EU' WHEN 'ASIA' THEN 'UK' ELSE 'XX' END AS code
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""


@query("jurisdiction_terms", """
SELECT n_nationkey, code, level, term FROM (
  SELECT n_nationkey, code, unnest(map_keys(m)) AS level, unnest(map_values(m)) AS term FROM (
    SELECT n_nationkey, code, CASE code
      WHEN 'UK' THEN MAP {'1': 'ACT', '2': 'PART', '3': 'Section', '4': 'Subsection', '5': 'Paragraph'}
      WHEN 'EU' THEN MAP {'1': 'REGULATION', '2': 'TITLE', '3': 'ARTICLE', '4': 'PARAGRAPH', '5': 'SUB-PARAGRAPH'}
      ELSE MAP {'1': 'LAW', '2': 'PART', '3': 'CHAPTER', '4': 'ARTICLE', '5': 'SUBARTICLE', '6': 'PARAGRAPH'} END AS m
    FROM {nation_codes}))""")
def jurisdiction_terms(src):
    return S.jurisdiction_terms(src.nation_codes, "code")
