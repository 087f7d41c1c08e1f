"""Candidate lists, fusion and hybrid search."""

from pyspark.sql import functions as F

from ..functions import fixed, text as T
from ..operators import graph as G, retrieval as R
from ..operators.index import read_index, write_index
from ..scale import SPREAD_ROWS, spread
from ..session import durable, fresh_folder
from .base import INPUTS, ORACLE_PARTS, Source, query
from .documents import day, spans

INPUTS["search_queries"] = "SELECT item_id AS query_id, text AS query FROM {benchmark}"
INPUTS["doc_entries"] = """
SELECT 'document' AS kind, concat('doc-', CAST(doc_id AS STRING)) AS canonical_ref, CAST(doc_id AS STRING) AS canonical_id,
  source AS title, text AS body, lang AS language, CAST(NULL AS STRING) AS ref_law, CAST(NULL AS STRING) AS ref_article,
  CAST(NULL AS STRING) AS ecli, CAST(NULL AS STRING) AS case_number, CAST(NULL AS STRING) AS court
FROM {documents}
"""
# Questions on laws and judgments, four kinds.
INPUTS["questions"] = """
SELECT item_id AS query_id, concat(CASE CAST(item_id % 4 AS INT)
  WHEN 0 THEN concat('Article ', CAST(item_id * 3 % 40 + 1 AS STRING), ' of Law ', CAST(item_id * 3 AS STRING), ' in force on 15/06/1998 ')
  WHEN 1 THEN concat('duty under Law ', CAST(item_id AS STRING), ' and ECLI:CY:AD:2019:A', CAST(item_id AS STRING), ' on 1 March 2000 ')
  WHEN 2 THEN concat('second party shall pay in case ', CAST(item_id AS STRING), '/2019 ')
  ELSE concat('Ρύθμιση P see Article ', CAST(item_id % 40 + 1 AS STRING), ' ') END, text) AS query
FROM {benchmark}
"""
INPUTS["chunk_vectors"] = """
SELECT vec_id AS chunk_id, embedding AS vector, CASE WHEN label = 9 THEN 'judgment' WHEN label = 8 THEN 'source_document' ELSE 'legislation' END AS document_type,
  CASE WHEN label = 9 THEN concat('ECLI:CY:AD:2019:A', CAST(vec_id % 100 AS STRING)) ELSE CAST(vec_id AS STRING) END AS document_key,
  CAST(vec_id % 40 + 1 AS STRING) AS article_number
FROM {embeddings}
"""
# Citations between judgments and links to laws, as enrichment makes them.
INPUTS["judgment_citations"] = """
SELECT case_id AS source_key, concat('ECLI:CY:AD:2019:A', CAST(conv_id % 97 AS STRING)) AS target_key FROM {judgments}
"""
INPUTS["judgment_links"] = """
SELECT case_id AS judgment_key, concat(applicable_law, '-art-', CAST(conv_id % 40 + 1 AS STRING)) AS provision_key FROM {judgments}
"""

FOLD = f"'{fixed.FOLD_FROM}', '{fixed.FOLD_TO}'"
SPLIT = r"'[^\p{L}\p{N}_\x{0370}-\x{03ff}]+'"
FOLD_SPLIT = r"'[^\p{L}\p{N}_]+'"


def lexical_sql(queries: str, entries: str) -> str:
    """Every matching (query, entry) with its score, for the oracle."""
    return f"""
SELECT query_id, kind, canonical_ref, phrase,
  round(overlap + hits * 0.1 + CASE WHEN phrase THEN 3 ELSE 0 END + CASE WHEN contains(ltitle, q) THEN 2 ELSE 0 END
    + 4 * len(list_filter([ref_article, ref_law, ecli, case_number], lambda c: c IS NOT NULL AND contains(lower(c), q))), 6) AS score
FROM (
  SELECT a.query_id, a.q, len(a.tokens) AS n, e.kind, e.canonical_ref, lower(coalesce(e.title, '')) AS ltitle, e.ref_article, e.ref_law,
    e.ecli, e.case_number, h.hits, contains(e.l, a.q) AS phrase, len(list_filter(a.tokens, lambda t: contains(e.l, t))) AS overlap
  FROM (SELECT query_id, q, list_filter(regexp_split_to_array(q, {SPLIT}), lambda t: t <> '') AS tokens
        FROM (SELECT query_id, trim(lower(query)) AS q FROM {{{queries}}})) a
  JOIN (
    SELECT query_id, canonical_ref, kind, sum(tf) AS hits
    FROM (SELECT canonical_ref, kind, term, count(*) AS tf FROM (
            SELECT canonical_ref, kind, unnest(regexp_split_to_array(translate(lower(body), {FOLD}), {FOLD_SPLIT})) AS term FROM {{{entries}}})
          WHERE term <> '' GROUP BY ALL)
    JOIN (SELECT DISTINCT query_id, unnest(regexp_split_to_array(translate(lower(query), {FOLD}), {FOLD_SPLIT})) AS term FROM {{{queries}}}) USING (term)
    GROUP BY ALL) h ON h.query_id = a.query_id
  JOIN (SELECT *, lower(body) AS l FROM {{{entries}}}) e ON e.canonical_ref = h.canonical_ref AND e.kind = h.kind)
WHERE n < 2 OR overlap >= 2
"""


#: Where the indexes of this session's inputs are stored, by application, directory and input.
_INDEXES: dict[tuple[str, str, str], str] = {}


def index_of(src: Source, name: str):
    """The stored index of an input: written by the first query that needs it, read by the others."""
    key = src.spark.sparkContext.applicationId, src.sf_dir, name
    if key not in _INDEXES:
        folder = fresh_folder(src.spark, f"index-{name}")
        write_index(spread(getattr(src, name), SPREAD_ROWS), folder)
        _INDEXES[key] = folder
    return read_index(src.spark, _INDEXES[key])


ORACLE_PARTS["doc_scores"] = lexical_sql("search_queries", "doc_entries")
ORACLE_PARTS["question_scores"] = lexical_sql("questions", "entries")


@query("postings", f"""
SELECT term, canonical_ref, count(*) AS tf FROM (
  SELECT canonical_ref, unnest(regexp_split_to_array(translate(lower(body), {FOLD}), {FOLD_SPLIT})) AS term FROM {{doc_entries}})
WHERE term <> '' GROUP BY ALL""")
def postings(src):
    # References are unique: texts dealt by them are shuffled once, and their words, which are more, not at all.
    return R.postings(src.doc_entries.repartition("canonical_ref"))


@query("lexical_search", """
SELECT query_id, kind, canonical_ref, score, phrase, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, canonical_ref) AS rank
FROM {doc_scores} QUALIFY rank <= 10""")
def lexical_search(src):
    return R.lexical_search(src.search_queries, src.doc_entries, 10, index_of(src, "doc_entries"))


# Two batches of arriving entries: the provisions, then the judgments and changed provisions.
INPUTS["entry_batches"] = """
SELECT 1 AS batch, kind, canonical_ref, canonical_id, title, body, language, ref_law, ref_article, ecli, case_number, court FROM {entries}
UNION ALL
SELECT 2, kind, canonical_ref, canonical_id, concat(title, ' (amended)'), concat(body, ' as amended'), 'el',
  CASE WHEN length(ref_law) = 1 THEN '' ELSE ref_law END, NULL, NULL, CASE WHEN ecli IS NOT NULL THEN concat(case_number, 'A') END, '' FROM {entries}
"""


@query("search_projection", """
SELECT kind, canonical_ref, max_by(canonical_id, batch) AS canonical_id, max_by(title, batch) AS title, max_by(body, batch) AS body, max_by(language, batch) AS language,
  max_by(ref_law, batch) FILTER (ref_law <> '') AS ref_law, max_by(ref_article, batch) FILTER (ref_article <> '') AS ref_article,
  max_by(ecli, batch) FILTER (ecli <> '') AS ecli, max_by(case_number, batch) FILTER (case_number <> '') AS case_number, max_by(court, batch) FILTER (court <> '') AS court
FROM {entry_batches} GROUP BY kind, canonical_ref""")
def search_projection(src):
    return R.search_projection(src.entry_batches, ["batch"])


# Exact references of the questions; article numbers and law keys are plain digits here.
ORACLE_PARTS["exact"] = r"""
SELECT query_id, canonical_ref, law, article, row_number() OVER (PARTITION BY query_id ORDER BY canonical_ref) AS rank FROM (
  SELECT query_id, regexp_extract(query, 'Article ([0-9]+) of Law ([0-9]+)', 1) AS article,
    regexp_extract(query, 'Article ([0-9]+) of Law ([0-9]+)', 2) AS law FROM {questions})
JOIN {entries} ON ref_law = law AND ref_article = article
"""


@query("exact_lookup", "SELECT * FROM {exact}")
def exact_lookup(src):
    return R.exact_lookup(src.questions, src.entries)


ORACLE_PARTS["question_lexical"] = """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, canonical_ref) AS rank FROM {question_scores} QUALIFY rank <= 30
"""
ORACLE_PARTS["question_cites"] = r"""
SELECT query_id, ecli, case_number, article FROM (SELECT query_id,
  nullif(regexp_extract(query, 'ECLI:CY:AD:2019:A[0-9]+'), '') AS ecli,
  CASE WHEN NOT regexp_matches(query, 'ECLI:|Article [0-9]+ of Law') THEN nullif(regexp_replace(regexp_extract(query, '([0-9]{1,5})\s*/\s*([0-9]{4})'), '\s', '', 'g'), '') END AS case_number,
  nullif(regexp_extract(query, 'Article ([0-9]+) of Law', 1), '') AS article FROM {questions})
"""


ORACLE_PARTS["found"] = """
SELECT query_id, kind, canonical_ref, 100.0 AS score, concat('Exact match: Article ', article) AS reason
FROM {exact} x JOIN {entries} USING (canonical_ref)
UNION ALL SELECT query_id, kind, canonical_ref, 100.0, 'Exact citation match' FROM {question_cites} c JOIN {entries} e
  ON e.ecli = c.ecli OR (c.ecli IS NULL AND e.case_number = c.case_number) WHERE c.article IS NULL
"""


@query("search", """
SELECT query_id, kind, canonical_ref, score, reason, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, canonical_ref) AS rank FROM (
  SELECT * FROM {found}
  UNION ALL SELECT query_id, kind, canonical_ref, score, CASE WHEN phrase THEN 'Exact phrase match in text' ELSE 'Lexical match (tf/word overlap)' END
  FROM {question_lexical} WHERE rank <= 10 AND (query_id, canonical_ref) NOT IN (SELECT query_id, canonical_ref FROM {found}))
QUALIFY rank <= 10""")
def search(src):
    return R.search(src.questions, src.entries, 10, index=index_of(src, "entries"))


INPUTS["dated_texts"] = """
SELECT o_orderkey AS query_id, CASE CAST(o_orderkey % 5 AS INT)
  WHEN 0 THEN concat('as of ', CAST(o_orderkey % 31 + 1 AS STRING), '/', CAST(o_orderkey % 14 + 1 AS STRING), '/', CAST(1990 + o_orderkey % 30 AS STRING), ' in 2011')
  WHEN 1 THEN concat('on ', CAST(o_orderkey % 32 AS STRING), ' March 20', CAST(10 + o_orderkey % 20 AS STRING))
  WHEN 2 THEN concat('law in 20', CAST(10 + o_orderkey % 20 AS STRING), ' for ', o_orderpriority)
  WHEN 3 THEN concat('since ', CAST(o_orderkey % 28 + 1 AS STRING), '.', CAST(o_orderkey % 12 + 1 AS STRING), '.1999')
  ELSE concat('no date for order ', CAST(o_orderkey % 1000 AS STRING)) END AS query
FROM {orders}
"""


@query("detect_query_date", r"""
SELECT query_id, strftime(coalesce(
  try_strptime(regexp_replace(regexp_extract(query, '\b(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4})\b', 1), '[.\-]', '/', 'g'), '%-d/%-m/%Y')::DATE,
  try_strptime(regexp_extract(query, '\b\d{1,2}\s+March\s+20\d{2}\b'), '%-d %B %Y')::DATE,
  try_strptime(concat(nullif(regexp_extract(query, '\b(20\d{2})\b', 1), ''), '-06-01'), '%Y-%m-%d')::DATE), '%Y-%m-%d') AS query_date
FROM {dated_texts}""")
def detect_query_date(src):
    return R.detect_query_date(src.dated_texts).select("query_id", day("query_date").alias("query_date"))


def centroids(src: Source):
    """Mean vector per label: the dense queries."""
    parts = spread(src.embeddings).select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("p")).select(
        F.col("label").cast("bigint").alias("query_id"), F.transform("p", lambda e: e["m"]).alias("vector")
    )


ORACLE_PARTS["centroids"] = """
SELECT CAST(label AS BIGINT) AS query_id, list(m ORDER BY pos) AS vector FROM (
  SELECT label, pos, avg(x) AS m FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM {embeddings})
  GROUP BY label, pos) GROUP BY label
"""
ORACLE_PARTS["dense"] = """
SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, round(list_cosine_similarity(c.vector, CAST(v.vector AS DOUBLE[])), 9) AS similarity
  FROM {centroids} c CROSS JOIN {chunk_vectors} v) QUALIFY rank <= 20
"""


@query("dense_topk", "SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM {dense}")
def dense_topk(src):
    out = R.dense_topk(centroids(src), src.chunk_vectors, 20)
    return out.withColumn("similarity", F.round("similarity", 6))


def question_vectors(src: Source):
    mean = centroids(src).select(F.col("query_id").alias("_label"), "vector")
    return src.questions.select("query_id", (F.col("query_id") % 10).alias("_label")).join(mean, "_label").drop("_label")


ORACLE_PARTS["chunk_refs"] = """
SELECT query_id, canonical_ref, row_number() OVER (PARTITION BY query_id ORDER BY d.rank) AS rank FROM (
  SELECT d.*, CASE WHEN document_type = 'legislation' THEN concat('law-', document_key, '-art-', article_number)
    WHEN document_type = 'judgment' THEN concat('judgment-', document_key) END AS canonical_ref
  FROM {dense} d JOIN {chunk_vectors} USING (chunk_id)) d WHERE canonical_ref IS NOT NULL
"""


@query("chunk_refs", """
SELECT query_id, canonical_ref, d.rank FROM (SELECT d.query_id, d.rank, CASE WHEN document_type = 'legislation' THEN concat('law-', document_key, '-art-', article_number)
    WHEN document_type = 'judgment' THEN concat('judgment-', document_key) END AS canonical_ref
  FROM {dense} d JOIN {chunk_vectors} USING (chunk_id)) d WHERE canonical_ref IS NOT NULL""")
def chunk_refs(src):
    hits = R.dense_topk(centroids(src), src.chunk_vectors, 20).join(src.chunk_vectors.drop("vector"), "chunk_id")
    return R.chunk_refs(hits).select("query_id", "canonical_ref", "rank")


ORACLE_PARTS["question_dense"] = """
SELECT q.query_id, d.canonical_ref, d.rank FROM {questions} q JOIN {chunk_refs} d ON d.query_id = q.query_id % 10
"""
ORACLE_PARTS["tree"] = """
SELECT query_id, canonical_ref, row_number() OVER (PARTITION BY query_id ORDER BY ref_law, canonical_ref) AS rank FROM (
  SELECT DISTINCT query_id, e.ref_law, e.canonical_ref FROM (
    SELECT DISTINCT query_id, split_part(substr(canonical_ref, 5), '-art-', 1) AS law FROM (
      SELECT query_id, canonical_ref FROM {exact} UNION ALL SELECT query_id, canonical_ref FROM {question_lexical}
      UNION ALL SELECT query_id, canonical_ref FROM {question_dense}) WHERE canonical_ref LIKE 'law-%-art-%')
  JOIN {entries} e ON e.ref_law = law AND e.kind = 'legislation_node')
"""
ORACLE_PARTS["graph"] = """
SELECT query_id, canonical_ref, row_number() OVER (PARTITION BY query_id ORDER BY part, canonical_ref) AS rank FROM (
  SELECT DISTINCT c.query_id, 1 AS part, concat('judgment-', target_key) AS canonical_ref FROM {question_cites} c
    JOIN {judgments} j ON j.ecli = c.ecli OR (c.ecli IS NULL AND j.case_number = c.case_number) JOIN {judgment_citations} ON source_key = case_id WHERE c.article IS NULL
  UNION ALL SELECT DISTINCT c.query_id, 2, concat('law-', provision_key) FROM {question_cites} c
    JOIN {judgments} j ON j.ecli = c.ecli OR (c.ecli IS NULL AND j.case_number = c.case_number) JOIN {judgment_links} ON judgment_key = case_id WHERE c.article IS NULL)
"""


@query("tree_expand", """
SELECT query_id, canonical_ref, row_number() OVER (PARTITION BY query_id ORDER BY ref_law, canonical_ref) AS rank FROM (
  SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS query_id, e.ref_law, e.canonical_ref FROM {lineitem} JOIN {entries} e ON e.ref_law = CAST(l_partkey AS STRING))""")
def tree_expand(src):
    named = src.lineitem.select(
        F.col("l_suppkey").alias("query_id"),
        F.concat(F.lit("law-"), F.col("l_partkey").cast("string"), F.lit("-art-1")).alias("canonical_ref"),
    )
    return R.tree_expand(named, src.entries)


def aliases(src: Source):
    return G.case_aliases(src.judgments.withColumnRenamed("case_id", "canonical_id"))


@query("graph_expand", "SELECT query_id, canonical_ref, rank FROM {graph}")
def graph_expand(src):
    return R.graph_expand(src.questions, aliases(src), src.judgment_citations, src.judgment_links)


# Lists to fuse: each order line puts its part on the list of its flag for the supplier's query.
INPUTS["ranked_lists"] = """
SELECT CAST(l_suppkey AS BIGINT) AS query_id, l_returnflag AS list_name,
  concat('judgment-', CASE WHEN l_partkey % 11 = 0 THEN 'none-' ELSE '' END, CAST(l_partkey AS STRING)) AS canonical_ref,
  CAST(l_orderkey % 97 + 1 AS BIGINT) AS rank FROM {lineitem}
"""
INPUTS["fuse_exact"] = """
SELECT CAST(s_suppkey AS BIGINT) AS query_id, concat('judgment-', CAST(s_suppkey * 3 AS STRING)) AS canonical_ref, 1 AS rank FROM {supplier}
"""
INPUTS["part_entries"] = """
SELECT 'judgment_node' AS kind, concat('judgment-', CAST(p_partkey AS STRING)) AS canonical_ref, p_name AS title, p_type AS body, 'en' AS language
FROM {part}
"""
ORACLE_PARTS["fused_parts"] = """
SELECT query_id, canonical_ref, sum(1.0 / (60 + rank)) AS rrf FROM {ranked_lists} GROUP BY ALL
"""


@query("rrf_fuse", "SELECT query_id, canonical_ref, round(rrf, 9) AS rrf FROM {fused_parts}")
def rrf_fuse(src):
    return R.rrf_fuse(src.ranked_lists).withColumn("rrf", F.round("rrf", 9))


ORACLE_PARTS["assembled"] = """
SELECT s.query_id, s.canonical_ref, e.title, e.body, s.exact, s.rrf,
  row_number() OVER (PARTITION BY s.query_id ORDER BY s.rrf DESC, s.canonical_ref) AS fused_rank
FROM (SELECT query_id, canonical_ref, coalesce(x.own, f.rrf) AS rrf, x.own IS NOT NULL AS exact
      FROM {fused_parts} f FULL JOIN (SELECT query_id, canonical_ref, 1000 + 1.0 / (60 + rank) AS own FROM {fuse_exact}) x USING (query_id, canonical_ref)) s
JOIN {part_entries} e USING (canonical_ref) QUALIFY fused_rank <= 30
"""


def assembled(src: Source):
    return R.assemble(R.rrf_fuse(src.ranked_lists), src.fuse_exact, src.part_entries, 10)


@query("assemble", "SELECT query_id, canonical_ref, title, body, exact, round(rrf, 6) AS rrf, fused_rank FROM {assembled}")
def assemble(src):
    out = assembled(src).withColumn("rrf", F.round("rrf", 6))
    return out.select("query_id", "canonical_ref", "title", "body", "exact", "rrf", "fused_rank")


# Annotated results: each order line refers to the law of its order's customer at the day it shipped.
INPUTS["dated_refs"] = """
SELECT order_key, line_number, CASE WHEN line_number = 7 THEN concat('judgment-', law) ELSE concat('law-', law, '-art-1') END AS canonical_ref,
  CASE WHEN line_number = 6 THEN NULL ELSE as_of END AS query_date, as_of FROM {probes}
"""


@query("annotate_temporal", """
SELECT order_key, line_number, d.canonical_ref, CAST(CASE WHEN line_number < 6 THEN r.version_number ELSE -1 END AS BIGINT) AS applicable_version,
  CASE WHEN line_number < 6 THEN strftime(r.effective_from, '%Y-%m-%d') END AS applicable_from,
  CASE WHEN line_number < 6 THEN strftime(r.effective_to, '%Y-%m-%d') END AS applicable_to
FROM {dated_refs} d JOIN {resolved} r USING (order_key, line_number, as_of)""")
def annotate_temporal(src):
    out = R.annotate_temporal(src.dated_refs, spans(src), "canonical_ref", "query_date", disjoint=True)
    return out.select(
        "order_key", "line_number", "canonical_ref",
        F.coalesce("applicable_version", F.lit(-1)).cast("bigint").alias("applicable_version"),
        day("applicable_from").alias("applicable_from"), day("applicable_to").alias("applicable_to"),
    )


# Scores for some of the texts: equal texts share one.
def part_scores(src: Source):
    rows = assembled(src).filter("length(body) % 2 = 0")
    return rows.select(
        "query_id", T.sha256("body").alias("text_hash"), ((F.length("body") * 13 + F.col("query_id")) % 101 / 7).alias("score")
    ).distinct()


@query("rerank", """
SELECT query_id, canonical_ref, exact, coalesce(round(score, 3), -1) AS rerank_score,
  row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, round(score, 3) DESC NULLS LAST, fused_rank) AS rank
FROM (SELECT *, CASE WHEN length(body) % 2 = 0 THEN ((length(body) * 13 + query_id) % 101) / 7 END AS score FROM {assembled})""")
def rerank(src):
    out = R.rerank(assembled(src), part_scores(src))
    return out.select("query_id", "canonical_ref", "exact", F.coalesce("rerank_score", F.lit(-1.0)).alias("rerank_score"), "rank")


def shared_words(queries: list[str], texts: list[str]) -> list[float]:
    """Stand-in scorer: shared words over words of the query."""
    out = []
    for q, t in zip(queries, texts):
        asked = set(q.lower().split())
        out.append(len(asked & set(t.lower().split())) / max(1, len(asked)))
    return out


INPUTS["supplier_queries"] = """
SELECT CAST(s_suppkey AS BIGINT) AS query_id, concat('red ECONOMY ring ', s_name) AS query FROM {supplier}
"""


@query("score_texts", """
SELECT DISTINCT query_id, sha256(body) AS text_hash, round(CASE WHEN body = 'ECONOMY' THEN 0.25 ELSE 0.0 END, 6) AS score FROM {assembled}""")
def score_texts(src):
    return R.score_texts(assembled(src), src.supplier_queries, shared_words).withColumn("score", F.round("score", 6))


@query("explain", """
SELECT order_key, line_number, concat_ws(' | ', CASE WHEN line_number = 1 THEN concat('Exact match: ', d.canonical_ref) END,
  CASE WHEN line_number < 6 THEN concat('Applicable version as of event date: v', r.version_number, ' (', strftime(r.effective_from, '%Y-%m-%d'), ' – ',
    coalesce(strftime(r.effective_to, '%Y-%m-%d'), 'now'), ')') END, 'BM25 + dense + tree/graph fusion (RRF)') AS explanation
FROM {dated_refs} d JOIN {resolved} r USING (order_key, line_number, as_of)""")
def explain(src):
    placed = R.annotate_temporal(src.dated_refs, spans(src), "canonical_ref", "query_date", disjoint=True)
    out = R.explain(placed.withColumn("exact", F.col("line_number") == 1))
    return out.select("order_key", "line_number", F.array_join("explanation", " | ").alias("explanation"))


def hybrid(src: Source):
    # The search projection and the version history are stored tables in use; here they are made once.
    return R.hybrid_search(
        src.questions, durable(src.entries), spans(src), 10, query_vectors=question_vectors(src), chunks=src.chunk_vectors,
        aliases=aliases(src), citations=src.judgment_citations, links=src.judgment_links, disjoint=True, index=index_of(src, "entries"),
    )


ORACLE_PARTS["question_fused"] = """
SELECT query_id, canonical_ref, sum(1.0 / (60 + rank)) AS rrf FROM (
  SELECT query_id, canonical_ref, rank FROM {question_lexical} UNION ALL SELECT query_id, canonical_ref, rank FROM {question_dense}
  UNION ALL SELECT query_id, canonical_ref, rank FROM {tree} UNION ALL SELECT query_id, canonical_ref, rank FROM {graph}) GROUP BY ALL
"""
ORACLE_PARTS["question_dates"] = """
SELECT query_id, CASE query_id % 4 WHEN 0 THEN DATE '1998-06-15' WHEN 1 THEN DATE '2000-03-01' ELSE
  CASE WHEN regexp_matches(query, '\\b(20\\d{2})\\b') THEN make_date(CAST(regexp_extract(query, '\\b(20\\d{2})\\b', 1) AS INT), 6, 1) END END AS query_date FROM {questions}
"""
ORACLE_PARTS["hybrid"] = """
SELECT s.query_id, s.canonical_ref, s.exact, s.rrf, s.title, s.body, d.query_date,
  row_number() OVER (PARTITION BY s.query_id ORDER BY s.exact DESC, s.rrf DESC, s.canonical_ref) AS rank
FROM (SELECT query_id, canonical_ref, e.title, e.body, coalesce(x.own, f.rrf) AS rrf, x.own IS NOT NULL AS exact
      FROM {question_fused} f FULL JOIN (SELECT query_id, canonical_ref, 1000 + 1.0 / (60 + rank) AS own FROM {exact}) x USING (query_id, canonical_ref)
      JOIN {entries} e USING (canonical_ref)) s
JOIN {question_dates} d USING (query_id) QUALIFY rank <= 10
"""
ORACLE_PARTS["hybrid_dated"] = """
SELECT h.*, c.version_id, c.version_number, c.effective_from, c.effective_to FROM {hybrid} h
LEFT JOIN {chain} c ON h.query_date IS NOT NULL AND h.canonical_ref LIKE 'law-%-art-%' AND c.law = split_part(substr(h.canonical_ref, 5), '-art-', 1)
QUALIFY row_number() OVER (PARTITION BY h.query_id, h.canonical_ref ORDER BY
  (c.effective_from <= h.query_date AND (c.effective_to IS NULL OR h.query_date < c.effective_to)) DESC, c.effective_from DESC, c.version_number DESC) = 1
"""


@query("hybrid_search", """
SELECT query_id, rank, canonical_ref, exact, round(rrf, 6) AS rrf, strftime(query_date, '%Y-%m-%d') AS query_date,
  CAST(coalesce(version_number, -1) AS BIGINT) AS applicable_version, strftime(effective_from, '%Y-%m-%d') AS applicable_from
FROM {hybrid_dated}""")
def hybrid_search(src):
    out = hybrid(src)
    return out.select(
        "query_id", "rank", "canonical_ref", "exact", F.round("rrf", 6).alias("rrf"), day("query_date").alias("query_date"),
        F.coalesce("applicable_version", F.lit(-1)).cast("bigint").alias("applicable_version"),
        day("applicable_from").alias("applicable_from"),
    )


# Private items: documents belong to an organisation; a query is a benchmark text asked by each of three.
INPUTS["private_items"] = """
SELECT doc_id % 3 AS org_id, doc_id AS item_id, source AS title, text AS body FROM {documents}
"""
INPUTS["private_queries"] = """
SELECT item_id * 10 + org AS query_id, org AS org_id, text AS query FROM {benchmark} CROSS JOIN (SELECT 0 AS org UNION ALL SELECT 1 UNION ALL SELECT 2)
"""
ORACLE_PARTS["private_terms"] = f"""
SELECT query_id, org_id, terms, unnest(terms) AS term FROM (SELECT query_id, org_id, list_distinct(list_filter(regexp_split_to_array(
  translate(array_to_string(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda t: t <> '')[1:8], ' '), {FOLD}), {FOLD_SPLIT}), lambda t: t <> '')) AS terms FROM {{private_queries}})
"""
ORACLE_PARTS["private_tf"] = f"""
SELECT org_id, item_id, title, term, count(*) AS n FROM (
  SELECT org_id, item_id, title, unnest(regexp_split_to_array(translate(lower(body), {FOLD}), {FOLD_SPLIT})) AS term FROM {{private_items}}) GROUP BY ALL
"""


@query("private_search", """
SELECT query_id, org_id, item_id, title, round(n * 0.1, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, item_id) AS rank, true AS internal, false AS primary_authority
FROM (SELECT query_id, q.org_id, item_id, title, sum(n) AS n FROM {private_terms} q JOIN {private_tf} t ON t.org_id = q.org_id AND t.term = q.term
  GROUP BY query_id, q.org_id, item_id, title, len(terms) HAVING count(*) = len(terms)) QUALIFY rank <= 10""")
def private_search(src):
    return R.private_search(src.private_queries, spread(src.private_items), 10)


INPUTS["vector_pairs"] = """
SELECT a.vec_id, b.vec_id AS other_id, a.embedding AS a, b.embedding AS b FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1
"""


@query("pairwise_cosine", """
SELECT vec_id, other_id, round(list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])), 4) AS cosine FROM {vector_pairs}""")
def pairwise_cosine(src):
    return R.pairwise_cosine(src.vector_pairs, "a", "b").select("vec_id", "other_id", "cosine")


def letter_vector(texts: list[str]) -> list[list[float]]:
    """Stand-in model: counts of a few letters."""
    return [[float(t.count(c)) for c in "aeiu"] for t in texts]


@query("embed_column", """
SELECT doc_id, CAST(v[1] AS DOUBLE) AS d1, CAST(v[2] AS DOUBLE) AS d2, CAST(v[3] AS DOUBLE) AS d3, CAST(v[4] AS DOUBLE) AS d4, 4 AS dimensions, 'letters' AS model, 'run-1' AS model_run_id FROM (
  SELECT doc_id, list_transform(['a', 'e', 'i', 'u'], lambda c: len(text) - len(replace(text, c, ''))) AS v FROM {documents})""")
def embed_column(src):
    out = R.embed_column(
        spread(src.documents.select("doc_id", "text")), letter_vector, provider="local", model="letters", version="1",
        dimensions=4, run_id="run-1",
    )
    parts = [F.get("vector", F.lit(k)).alias(f"d{k + 1}") for k in range(4)]
    return out.select("doc_id", *parts, "dimensions", "model", "model_run_id")
