"""Retrieval quality, feedback and case similarity."""

from pyspark.sql import functions as F

from ..operators import evaluate as E, retrieval as R, similarity as M
from ..session import durable
from .base import INPUTS, ORACLE_PARTS, Source, query
from .documents import paragraphs
from .search import index_of

# Gold: good documents belong to the query of their number; bad ones are its hard negatives.
INPUTS["gold"] = """
SELECT doc_id % (SELECT count(*) FROM {benchmark}) AS query_id, concat('doc-', CAST(doc_id AS STRING)) AS canonical_ref, quality FROM {labels}
"""
INPUTS["asked"] = """
SELECT item_id AS query_id, CASE CAST(item_id % 3 AS INT) WHEN 0 THEN 'en' WHEN 1 THEN 'el' ELSE '' END AS language,
  CASE WHEN item_id % 4 = 0 THEN 'exact_reference' ELSE 'concept' END AS query_type, 'CY' AS jurisdiction,
  CASE WHEN item_id % 5 = 0 THEN '2020-01-01' ELSE NULL END AS relevant_date FROM {benchmark}
"""
ORACLE_PARTS["ranked"] = """
SELECT query_id, canonical_ref, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, canonical_ref) AS rank FROM {doc_scores} QUALIFY rank <= 50
"""
ORACLE_PARTS["good"] = "SELECT * FROM {gold} WHERE quality = 1"
ORACLE_PARTS["metrics"] = """
SELECT query_id, round(coalesce(h10 / greatest(1, rel), 0), 3) AS recall_10, round(coalesce(h50 / greatest(1, rel), 0), 3) AS recall_50,
  round(coalesce(1.0 / first, 0), 3) AS mrr, round(coalesce(dcg / (SELECT sum(1 / ln(i + 1)) FROM generate_series(1, least(10, rel)) t(i)), 0), 3) AS ndcg_10,
  round(coalesce(h10 / least(10, n), 0), 3) AS precision_10, CAST(rel AS BIGINT) AS rel
FROM (SELECT a.query_id, coalesce(g.rel, 0) AS rel, h10, h50, first, dcg, n FROM {asked} a
  LEFT JOIN (SELECT query_id, count(DISTINCT canonical_ref) AS rel FROM {good} GROUP BY ALL) g USING (query_id)
  LEFT JOIN (SELECT r.query_id, count(*) AS n, CAST(count(g.canonical_ref) FILTER (rank <= 10) AS DOUBLE) AS h10, CAST(count(g.canonical_ref) AS DOUBLE) AS h50,
      min(rank) FILTER (g.canonical_ref IS NOT NULL) AS first, coalesce(sum(1 / ln(rank + 1)) FILTER (g.canonical_ref IS NOT NULL AND rank <= 10), 0) AS dcg
    FROM {ranked} r LEFT JOIN {good} g ON g.query_id = r.query_id AND g.canonical_ref = r.canonical_ref GROUP BY ALL) USING (query_id))
"""


def ranked(src: Source):
    return R.lexical_search(src.search_queries, src.doc_entries, 50, index_of(src, "doc_entries")).select("query_id", "canonical_ref", "rank")


@query("ranking_metrics", "SELECT query_id, recall_10, recall_50, mrr, ndcg_10, precision_10 FROM {metrics}")
def ranking_metrics(src):
    return E.ranking_metrics(src.asked.select("query_id"), ranked(src), src.gold.filter("quality = 1"))


@query("segment_metrics", """
SELECT segment, count(*) AS queries, round(avg(recall_10), 3) AS recall_10, round(avg(recall_50), 3) AS recall_50, round(avg(mrr), 3) AS mrr,
  round(avg(ndcg_10), 3) AS ndcg_10, round(avg(precision_10), 3) AS precision_10
FROM (SELECT m.*, unnest([nullif(language, ''), query_type, jurisdiction, CASE WHEN relevant_date IS NULL THEN 'non_temporal' ELSE 'temporal' END,
    CASE WHEN query_type = 'exact_reference' THEN 'exact' ELSE 'semantic' END]) AS segment FROM {metrics} m JOIN {asked} USING (query_id))
WHERE segment IS NOT NULL GROUP BY segment""")
def segment_metrics(src):
    return E.segment_metrics(E.ranking_metrics(src.asked, ranked(src), src.gold.filter("quality = 1")))


INPUTS["scope_lists"] = """
SELECT CAST(l_suppkey AS BIGINT) AS query_id, CASE WHEN l_linenumber < 4 THEN concat('law-', CAST(l_partkey AS STRING), '-art-', CAST(l_linenumber AS STRING))
  ELSE concat('judgment-', CAST(l_partkey AS STRING)) END AS canonical_ref, min(l_orderkey) AS rank FROM {lineitem} GROUP BY 1, 2
"""
INPUTS["scope_laws"] = "SELECT CAST(p_partkey AS STRING) AS law FROM {part} WHERE p_size < 20"
INPUTS["scope_cases"] = "SELECT concat('judgment-', CAST(p_partkey AS STRING)) AS canonical_ref FROM {part} WHERE p_size > 30"


@query("scope_results", """
SELECT query_id, canonical_ref, row_number() OVER (PARTITION BY query_id ORDER BY rank, canonical_ref) AS rank FROM {scope_lists}
WHERE split_part(substr(canonical_ref, 5), '-art-', 1) IN (SELECT law FROM {scope_laws}) AND canonical_ref LIKE 'law-%'
  OR canonical_ref IN (SELECT canonical_ref FROM {scope_cases})""")
def scope_results(src):
    return E.scope_results(src.scope_lists, src.scope_laws, src.scope_cases)


@query("evaluate", """
SELECT m.query_id, recall_10, mrr, ndcg_10, rel AS relevant, coalesce(h.n, 0) AS hard_negatives,
  (SELECT string_agg(canonical_ref, ' ' ORDER BY rank) FROM {ranked} r WHERE r.query_id = m.query_id AND rank <= 5) AS ranked_top
FROM {metrics} m LEFT JOIN (SELECT query_id, count(DISTINCT canonical_ref) AS n FROM {gold} WHERE quality = 0 GROUP BY ALL) h ON h.query_id = m.query_id""")
def evaluate(src):
    out = E.evaluate(src.asked, ranked(src), src.gold.filter("quality = 1"), src.gold.filter("quality = 0"))
    return out.select("query_id", "recall_10", "mrr", "ndcg_10", "relevant", "hard_negatives", F.array_join("ranked_top", " ").alias("ranked_top"))


INPUTS["feedback"] = """
SELECT CAST(user_id AS STRING) AS query, concat('doc-', CAST(event_id % 7 AS STRING)) AS canonical_ref,
  CASE event_type WHEN 'signup' THEN 'saved_as_authority' WHEN 'purchase' THEN 'opened' WHEN 'view' THEN 'irrelevant' WHEN 'click' THEN 'adverse' ELSE 'liked' END AS judgement
FROM {events}
"""


@query("feedback_signals", """
SELECT query, canonical_ref, count(*) FILTER (judgement = 'opened') AS opened, count(*) FILTER (judgement = 'saved_as_authority') AS saved_as_authority,
  count(*) FILTER (judgement = 'rejected') AS rejected, count(*) FILTER (judgement = 'irrelevant') AS irrelevant, count(*) FILTER (judgement = 'adverse') AS adverse
FROM {feedback} WHERE judgement <> 'liked' GROUP BY ALL""")
def feedback_signals(src):
    return E.feedback_signals(src.feedback)


INPUTS["case_pairs"] = """
SELECT conv_id AS pair_id, concat('case-', CAST(conv_id AS STRING)) AS a_id, concat('case-', CAST(conv_id + 1 AS STRING)) AS b_id FROM {judgments}
"""
ORACLE_PARTS["known_pairs"] = """
SELECT pair_id, a_id, b_id, a.court AS ca, b.court AS cb FROM {case_pairs} JOIN {judgments} a ON a.case_id = a_id JOIN {judgments} b ON b.case_id = b_id
"""
LETTERS = r"[a-z\x{0370}-\x{03ff}]{3,}"
ORACLE_PARTS["dimension_tokens"] = f"""
SELECT case_id, dimension, token, count(*) AS n FROM (
  SELECT case_id, CASE WHEN section_type IN ('holding', 'legal_analysis') THEN 'LEGAL_ISSUE_SIMILARITY' WHEN section_type = 'facts' THEN 'FACTUAL_SIMILARITY'
      WHEN section_type = 'procedural_history' THEN 'PROCEDURAL_SIMILARITY' END AS dimension, unnest(regexp_extract_all(lower(text), '{LETTERS}')) AS token FROM {{paragraphs}})
WHERE dimension IS NOT NULL GROUP BY ALL
"""
ORACLE_PARTS["text_scores"] = """
SELECT pair_id, dimension, sum(least(na, nb)) / sum(greatest(na, nb)) AS score, sum(na) AS ta, sum(nb) AS tb FROM (
  SELECT coalesce(x.pair_id, y.pair_id) AS pair_id, coalesce(x.dimension, y.dimension) AS dimension, coalesce(x.n, 0) AS na, coalesce(y.n, 0) AS nb
  FROM (SELECT p.pair_id, t.* FROM {known_pairs} p JOIN {dimension_tokens} t ON t.case_id = a_id) x
  FULL JOIN (SELECT p.pair_id, t.* FROM {known_pairs} p JOIN {dimension_tokens} t ON t.case_id = b_id) y
    ON x.pair_id = y.pair_id AND x.dimension = y.dimension AND x.token = y.token) GROUP BY ALL
"""
INPUTS["case_targets"] = """
SELECT concat('case-', CAST(conv_id AS STRING)) AS id, concat('t', CAST(conv_id % 3 + turn % 2 AS STRING)) AS target_key FROM {conversations}
"""
ORACLE_PARTS["pair_targets"] = """
SELECT pair_id, count(*) FILTER (x.target_key IS NOT NULL AND y.target_key IS NOT NULL) AS shared, count(*) AS joined FROM (
  SELECT DISTINCT pair_id, target_key FROM {known_pairs} JOIN {case_targets} ON id = a_id) x
FULL JOIN (SELECT DISTINCT pair_id, target_key FROM {known_pairs} JOIN {case_targets} ON id = b_id) y USING (pair_id, target_key) GROUP BY pair_id
"""
ORACLE_PARTS["case_remedies"] = """
SELECT case_id, unnest(list_filter(['damages', 'compensation', 'injunction', 'specific performance', 'costs', 'rescission', 'repayment', 'interest', 'dismissed'],
  lambda t: contains(txt, t))) AS term FROM (SELECT case_id, lower(string_agg(text, ' ' ORDER BY para_number)) AS txt FROM {paragraphs} WHERE section_type = 'order' GROUP BY case_id)
"""
ORACLE_PARTS["pair_remedies"] = """
SELECT pair_id, count(*) FILTER (x.term IS NOT NULL AND y.term IS NOT NULL) AS shared, count(*) AS joined FROM (
  SELECT pair_id, term FROM {known_pairs} JOIN {case_remedies} ON case_id = a_id) x
FULL JOIN (SELECT pair_id, term FROM {known_pairs} JOIN {case_remedies} ON case_id = b_id) y USING (pair_id, term) GROUP BY pair_id
"""


@query("multiset_jaccard", """
SELECT p.pair_id, round(CASE WHEN ta > 0 AND tb > 0 THEN score ELSE 0 END, 3) AS score FROM {known_pairs} p
LEFT JOIN {text_scores} s ON s.pair_id = p.pair_id AND s.dimension = 'LEGAL_ISSUE_SIMILARITY'""")
def multiset_jaccard(src):
    texts = paragraphs(src).filter("section_type IN ('holding', 'legal_analysis')").select(F.col("case_id").alias("id"), "text")
    known = src.judgments.select(F.col("case_id").alias("b_id"))
    return M.multiset_jaccard(src.case_pairs.join(known, "b_id", "left_semi"), texts).select("pair_id", "score")


@query("compare_cases", """
SELECT pair_id, dimension, CASE WHEN dimension = 'PROCEDURAL_SIMILARITY' THEN round(0.5 * CASE WHEN ca = cb THEN 1 ELSE 0 END + 0.5 * base, 3) ELSE base END AS score FROM (
  SELECT p.pair_id, d.dimension, ca, cb, round(coalesce(CASE d.dimension WHEN 'STATUTORY_SIMILARITY' THEN t.shared / greatest(1, t.joined)
    WHEN 'REMEDY_SIMILARITY' THEN r.shared / greatest(1, r.joined) ELSE CASE WHEN s.ta > 0 AND s.tb > 0 THEN s.score END END, 0), 3) AS base
  FROM {known_pairs} p CROSS JOIN (SELECT unnest(['LEGAL_ISSUE_SIMILARITY', 'FACTUAL_SIMILARITY', 'PROCEDURAL_SIMILARITY', 'STATUTORY_SIMILARITY', 'REMEDY_SIMILARITY']) AS dimension) d
  LEFT JOIN {text_scores} s ON s.pair_id = p.pair_id AND s.dimension = d.dimension
  LEFT JOIN {pair_targets} t ON t.pair_id = p.pair_id LEFT JOIN {pair_remedies} r ON r.pair_id = p.pair_id)""")
def compare_cases(src):
    cases = src.judgments.select(F.col("case_id").alias("id"), "court")
    texts = durable(paragraphs(src).select(F.col("case_id").alias("id"), "section_type", "para_number", "text"))
    return M.compare_cases(src.case_pairs, cases, texts, src.case_targets).select("pair_id", "dimension", "score")


@query("missing_cases", "SELECT pair_id, b_id AS id FROM {case_pairs} WHERE b_id NOT IN (SELECT case_id FROM {judgments})")
def missing_cases(src):
    return M.missing_cases(src.case_pairs, src.judgments.select(F.col("case_id").alias("id")))


@query("shared_targets", """
SELECT DISTINCT pair_id, x.target_key FROM {case_pairs} JOIN {case_targets} x ON x.id = a_id JOIN {case_targets} y ON y.id = b_id AND y.target_key = x.target_key""")
def shared_targets(src):
    return M.shared_targets(src.case_pairs, src.case_targets)
