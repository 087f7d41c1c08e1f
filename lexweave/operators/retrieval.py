"""Candidate lists, fusion and ranked results for tables of queries."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as TY

from ..functions import dates as D, fixed, text as T, vectors as VF
from ..scale import first_per_key, query_batches, sequence_in_blocks, top_per_key
from ..session import durable, fresh_folder
from .graph import entry_keys, with_citation
from .index import indexed_scores, write_index
from .temporal import annotate_temporal

ENTRY_COLUMNS = [
    "kind", "canonical_ref", "canonical_id", "title", "body", "language", "ref_law", "ref_article", "ecli",
    "case_number", "court",
]


def search_projection(entries: DataFrame, order: list[str]) -> DataFrame:
    """One row per (kind, canonical_ref) from arriving entries.

    Body, title and language come from the newest arrival; law, article, ECLI, case and court keep
    their newest non-empty value.
    """
    at = F.struct(*order)

    def kept(c: str) -> Column:
        given = F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.col(c))
        return F.max_by(given, F.when(given.isNotNull(), at)).alias(c)

    names = ("ref_law", "ref_article", "ecli", "case_number", "court")
    ids = entries.groupBy("kind", "canonical_ref").agg(*[kept(c) for c in names])
    newest = first_per_key(
        entries.select("kind", "canonical_ref", "canonical_id", "title", "body", "language", *order),
        ["kind", "canonical_ref"], [F.col(c).desc() for c in order],
    )
    return newest.join(ids, ["kind", "canonical_ref"]).select(*ENTRY_COLUMNS)


def postings(entries: DataFrame, text: str = "body") -> DataFrame:
    """(term, canonical_ref, tf) of folded words, counted before the shuffle."""
    words = entries.select("canonical_ref", F.explode_outer(T.folded_tokens(text)).alias("term"))
    return words.filter("term IS NOT NULL").groupBy("term", "canonical_ref").agg(F.count(F.lit(1)).alias("tf"))


def lexical_scores(queries: DataFrame, entries: DataFrame, index: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(query_id, kind, canonical_ref, score, phrase) of every matching entry, or of those that may be among the best `k`.

    An entry matches when one folded query word is one of its folded words. With two or more query
    words at least two must occur in the lower-case body as substrings. score = occurring words
    + 0.1 per matching position + 3 if the body holds the whole query + 2 if the title does
    + 4 per identifier holding it.

    `index` is a stored index of `entries` (see `index.write_index`); without it one is made for this call.
    """
    if index is None:
        index = write_index(entries, fresh_folder(entries.sparkSession, "index"))
    return indexed_scores(queries, entries, index, k)


def lexical_search(queries: DataFrame, entries: DataFrame, k: int, index: DataFrame | None = None) -> DataFrame:
    """The best `k` entries per query by score, then reference."""
    scores = lexical_scores(queries, entries, index, k)
    return top_per_key(scores, ["query_id"], [F.desc("score"), "canonical_ref", "kind"], k)


def exact_lookup(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Provisions a query names exactly: (query_id, canonical_ref, rank, law, article).

    First the article-of-law form on (law, article); if nothing is found the wider form with
    alphanumeric law keys on (law, article); if still nothing its canonical reference.
    """
    parsed, cite = with_citation(queries, "query"), F.col("_c")
    wide_article = T.blank_to_null(F.regexp_extract("query", fixed.FLAGS + fixed.KEYED_ARTICLE, 1))
    wide_law = F.regexp_replace(
        T.blank_to_null(F.regexp_extract("query", fixed.FLAGS + fixed.KEYED_ARTICLE, 2)), r"\.+$", ""
    )

    def way(prio: int, key: Column, law: Column, article: Column) -> Column:
        return F.when(key.isNotNull(), F.struct(
            F.lit(prio).alias("way"), key.alias("key"), law.alias("law"), article.alias("article")
        ))

    named = F.when(cite["kind"] == "legislation_article", T.reference_key(cite))
    ways = F.array_compact(F.array(
        way(1, named, cite["law"], cite["article"]),
        way(2, F.concat(F.lit("art|"), wide_law, F.lit("|"), wide_article), wide_law, wide_article),
        way(3, F.concat(F.lit("ref|law-"), wide_law, F.lit("-art-"), wide_article), wide_law, wide_article),
    ))
    keyed = parsed.select("query_id", F.inline_outer(ways)).filter("key IS NOT NULL")
    by_ref = entries.select(F.concat(F.lit("ref|"), "canonical_ref").alias("key"), "canonical_ref")
    targets = entry_keys(entries).filter(F.col("key").startswith("art|")).unionByName(by_ref)
    hits = keyed.join(targets, "key").select("query_id", "way", "canonical_ref", "law", "article")
    best = hits.groupBy("query_id").agg(F.min("way").alias("way"))
    first = hits.join(best, ["query_id", "way"]).select("query_id", "canonical_ref", "law", "article").distinct()
    return first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("canonical_ref")))


def search(queries: DataFrame, entries: DataFrame, k: int, mode: str = "hybrid", index: DataFrame | None = None) -> DataFrame:
    """Exact references at 100, then lexical hits without repeats, best `k` with a reason; `index` as in `lexical_scores`."""
    parsed = with_citation(queries, "query").withColumn("_key", T.reference_key(F.col("_c")))
    named = parsed.filter(F.col("_c.kind").isin("legislation_article", "judgment")).select(
        "query_id", "_key",
        F.when(F.col("_c.kind") == "judgment", "Exact citation match").otherwise(
            F.concat(F.lit("Exact match: Article "), "_c.article")
        ).alias("reason"),
    )
    exact = (
        named.join(entry_keys(entries, "kind").withColumnRenamed("key", "_key"), "_key")
        .select("query_id", "kind", "canonical_ref", F.lit(fixed.EXACT_SCORE).alias("score"), "reason")
    )
    asked = parsed if mode in ("lexical", "hybrid", "semantic") else parsed.filter("_c.kind = 'unknown'")
    lexical = lexical_search(asked.select(*queries.columns), entries, k, index).select(
        "query_id", "kind", "canonical_ref", "score",
        F.when(F.col("phrase"), "Exact phrase match in text").otherwise("Lexical match (tf/word overlap)").alias("reason"),
    )
    both = exact.unionByName(lexical.join(exact, ["query_id", "kind", "canonical_ref"], "left_anti"))
    return top_per_key(both, ["query_id"], [F.desc("score"), "canonical_ref", "kind"], k)


def detect_query_date(queries: DataFrame) -> DataFrame:
    return queries.withColumn("query_date", D.detect_query_date("query"))


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int, vector: str = "vector") -> DataFrame:
    """The `k` chunks with the highest cosine per query: (query_id, chunk_id, similarity, rank).

    Each task multiplies its Arrow batches with the query matrix and passes on only rows that can
    still be among the best `k` (ties included), so no (query, chunk) pair table exists.
    Queries travel to the tasks in batches of bounded size.
    """
    sc = chunks.sparkSession.sparkContext
    parts = []
    for batch in query_batches(queries, "query_id"):
        rows = batch.select("query_id", vector).collect()
        rows = [r for r in rows if r[1]]
        if rows:
            parts.append(_dense_batch(sc.broadcast(([r[0] for r in rows], [list(r[1]) for r in rows])), batch, chunks, k, vector))
    if not parts:
        schema = TY.StructType([queries.schema["query_id"], chunks.schema["chunk_id"],
                                TY.StructField("similarity", TY.DoubleType()), TY.StructField("rank", TY.IntegerType())])
        return chunks.sparkSession.createDataFrame([], schema)
    hits = reduce(DataFrame.unionByName, parts)
    return top_per_key(hits, ["query_id"], [F.desc("similarity"), "chunk_id"], k)


def _dense_batch(shared, queries: DataFrame, chunks: DataFrame, k: int, vector: str) -> DataFrame:
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, raw = shared.value
        groups: dict[int, list[int]] = {}
        for i, v in enumerate(raw):
            groups.setdefault(len(v), []).append(i)
        mats = {}
        for n, members in groups.items():
            m = np.array([raw[i] for i in members], dtype="float64")
            size = np.sqrt((m * m).sum(axis=1))
            mats[n] = m / np.where(size == 0, 1.0, size)[:, None]
        floor = np.full(len(ids), -np.inf)
        kept = np.full((len(ids), k), -np.inf)
        for pdf in batches:
            sims = np.zeros((len(ids), len(pdf)))
            lens = pdf[vector].map(len).to_numpy()
            for n, members in groups.items():
                at = np.flatnonzero(lens == n)
                if len(at):
                    m = np.array([np.asarray(v, dtype="float64") for v in pdf[vector].iloc[at]])
                    size = np.sqrt((m * m).sum(axis=1))
                    sims[np.ix_(members, at)] = mats[n] @ (m / np.where(size == 0, 1.0, size)[:, None]).T
            both = np.concatenate([kept, sims], axis=1)
            kept = -np.partition(-both, k - 1, axis=1)[:, :k]
            floor = kept.min(axis=1)
            q, c = np.nonzero(sims >= floor[:, None] - 1e-9)
            yield pd.DataFrame({
                "query_id": [ids[i] for i in q], "chunk_id": pdf["chunk_id"].to_numpy()[c], "similarity": sims[q, c],
            })

    schema = TY.StructType([
        queries.schema["query_id"], chunks.schema["chunk_id"], TY.StructField("similarity", TY.DoubleType()),
    ])
    usable = chunks.select("chunk_id", vector).filter(F.size(vector) > 0)
    return usable.mapInPandas(best, schema).withColumn("similarity", F.round("similarity", 9))


def pairwise_cosine(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cosine of two vector columns to 4 decimals."""
    return pairs.withColumn("cosine", F.round(VF.cosine(F.col(a), F.col(b)), 4))


def chunk_refs(hits: DataFrame) -> DataFrame:
    """Chunk hits as canonical references, rank and repeats kept."""
    law = (F.col("document_type") == "legislation") & F.col("article_number").isNotNull()
    ref = F.when(law, F.concat(F.lit("law-"), "document_key", F.lit("-art-"), "article_number")).when(
        F.col("document_type") == "judgment", F.concat(F.lit("judgment-"), "document_key")
    )
    return hits.withColumn("canonical_ref", ref).filter("canonical_ref IS NOT NULL")


def tree_expand(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """Every provision of each law a candidate names: (query_id, canonical_ref, rank) in reference order.

    Entries are unique by kind and reference, as search_projection makes them.
    """
    laws = candidates.select("query_id", T.ref_law("canonical_ref").alias("ref_law")).filter("ref_law IS NOT NULL").distinct()
    nodes = entries.filter("kind = 'legislation_node'").select("ref_law", "canonical_ref")
    nodes = nodes.join(laws.select("ref_law").distinct(), "ref_law", "left_semi")
    # References of one law share a prefix, so the next two characters slice even a huge law.
    piece = F.substr("canonical_ref", F.lit(1), F.length("ref_law") + 11)
    placed = sequence_in_blocks(nodes, ["ref_law"], ["canonical_ref"], piece, number="_place")
    # A query's laws are counted before their provisions are attached, so what is put in order are laws.
    sizes = nodes.groupBy("ref_law").agg(F.count(F.lit(1)).alias("_n"))
    ends = candidates.select(T.ref_law("canonical_ref").alias("ref_law")).agg(F.min("ref_law"), F.max("ref_law")).first()
    shared = len(os.path.commonprefix([x or "" for x in ends]))
    block = F.substr("ref_law", F.lit(shared + 1), F.lit(2))
    counted = sequence_in_blocks(laws.join(sizes, "ref_law"), ["query_id"], ["ref_law"], block, totals={"_upto": F.col("_n")})
    found = counted.select("query_id", "ref_law", (F.col("_upto") - F.col("_n")).alias("_before")).join(placed, "ref_law")
    return found.select("query_id", "canonical_ref", (F.col("_before") + F.col("_place")).cast("bigint").alias("rank"))


def graph_expand(queries: DataFrame, aliases: DataFrame, citations: DataFrame, links: DataFrame) -> DataFrame:
    """References around the case a query names: cited cases, then linked provisions.

    `aliases` maps every key of a case to its canonical_id; edges use any of those keys.
    """
    parsed, cite = with_citation(queries, "query"), F.col("_c")
    key = F.when(cite["kind"] == "judgment", F.coalesce(cite["ecli"], cite["case_number"]))
    named = parsed.select("query_id", key.alias("alias")).filter("alias IS NOT NULL")
    cases = named.join(aliases, "alias").select("query_id", "canonical_id").distinct()
    keys = cases.join(aliases, "canonical_id").select("query_id", "alias")
    cited = keys.join(citations.select(F.col("source_key").alias("alias"), "target_key"), "alias").select(
        "query_id", F.lit(1).alias("part"), F.concat(F.lit("judgment-"), "target_key").alias("canonical_ref")
    )
    linked = keys.join(links.select(F.col("judgment_key").alias("alias"), "provision_key"), "alias").select(
        "query_id", F.lit(2).alias("part"), F.concat(F.lit("law-"), "provision_key").alias("canonical_ref")
    )
    # A much-citing case is numbered slice by slice; references of one court and year share 26 characters.
    piece = F.struct("part", F.substring("canonical_ref", 1, 26))
    return sequence_in_blocks(
        cited.unionByName(linked).distinct(), ["query_id"], ["part", "canonical_ref"], piece, number="rank"
    ).drop("part")


def rrf_fuse(lists: DataFrame, k: int = fixed.RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over every occurrence of a reference in any list, repeats included."""
    return lists.groupBy("query_id", "canonical_ref").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"))


def assemble(fused: DataFrame, exact: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """Best 3k references with an entry per query; exact ones score 1000 more and count once."""
    marked = exact.select(
        "query_id", "canonical_ref", F.lit(True).alias("exact"),
        (F.lit(fixed.EXACT_BONUS) + 1.0 / (F.lit(fixed.RRF_K) + F.col("rank"))).alias("_own"),
    )
    scored = fused.join(marked, ["query_id", "canonical_ref"], "full_outer").select(
        "query_id", "canonical_ref", F.coalesce("_own", "rrf").alias("rrf"), F.coalesce("exact", F.lit(False)).alias("exact")
    )
    detail = first_per_key(entries.select("canonical_ref", "kind", "title", "body", "language"), ["canonical_ref"], ["kind"])
    known = scored.join(detail.select("canonical_ref"), "canonical_ref", "left_semi")
    top = top_per_key(known, ["query_id"], [F.desc("rrf"), "canonical_ref"], 3 * k, "fused_rank")
    return top.join(detail, "canonical_ref")


def rerank(results: DataFrame, scores: DataFrame | None) -> DataFrame:
    """Final order per query: exact references first, then by score with unscored last, then as fused.

    `scores` holds query_id, text_hash, score; equal texts share one score. Without it the fused order stays.
    """
    if scores is None:
        scored = results.withColumn("rerank_score", F.lit(None).cast("double"))
    else:
        text = F.coalesce(T.blank_to_null("body"), F.col("title"), F.lit(""))
        given = scores.groupBy("query_id", "text_hash").agg(F.max("score").alias("_s"))
        scored = results.withColumn("text_hash", T.sha256(text)).join(given, ["query_id", "text_hash"], "left")
        scored = scored.withColumn("rerank_score", F.round("_s", 3)).drop("_s", "text_hash")
    order = [F.desc("exact"), F.desc_nulls_last("rerank_score"), "fused_rank"]
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))


def score_texts(results: DataFrame, queries: DataFrame, scorer: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """(query_id, text_hash, score) from a user function on batches of (query, text); each text once per query."""
    text = F.coalesce(T.blank_to_null("body"), F.col("title"), F.lit(""))
    pairs = results.select("query_id", T.sha256(text).alias("text_hash"), text.alias("_text"))
    pairs = pairs.dropDuplicates(["query_id", "text_hash"]).join(queries.select("query_id", "query"), "query_id")

    @F.pandas_udf("double")
    def run(query: pd.Series, body: pd.Series) -> pd.Series:
        return pd.Series(scorer(query.tolist(), body.tolist()), dtype="float64")

    return pairs.select("query_id", "text_hash", run("query", "_text").alias("score"))


def embed_column(
    df: DataFrame, fn: Callable[[list[str]], list[list[float]]], *, text: str = "text", context: str | None = None,
    provider: str, model: str, version: str, dimensions: int, run_id: str,
) -> DataFrame:
    """Adds the vector a user function gives for the context header, else the text, and its lineage."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([list(map(float, v)) for v in fn(s.tolist())])

    source = F.col(text) if context is None else F.coalesce(T.blank_to_null(context), F.col(text))
    lineage = {"provider": provider, "model": model, "embedding_version": version, "model_run_id": run_id}
    out = df.withColumn("vector", run(source)).withColumn("dimensions", F.lit(dimensions))
    return out.select("*", *[F.lit(v).alias(n) for n, v in lineage.items()])


def explain(results: DataFrame) -> DataFrame:
    """Reasons in order: exact match, applicable version, fusion note."""
    shown = F.concat(
        F.lit("Applicable version as of event date: v"), F.col("applicable_version").cast("string"), F.lit(" ("),
        F.coalesce(F.date_format("applicable_from", "yyyy-MM-dd"), F.lit("None")), F.lit(" – "),
        F.coalesce(F.date_format("applicable_to", "yyyy-MM-dd"), F.lit("now")), F.lit(")"),
    )
    reasons = F.array_compact(F.array(
        F.when(F.col("exact"), F.concat(F.lit("Exact match: "), "canonical_ref")),
        F.when(F.col("applicable_version").isNotNull(), shown),
        F.lit(fixed.FUSION_NOTE),
    ))
    return results.withColumn("explanation", reasons)


def hybrid_search(
    queries: DataFrame, entries: DataFrame, versions: DataFrame, k: int, *, mode: str = "hybrid",
    query_vectors: DataFrame | None = None, chunks: DataFrame | None = None, aliases: DataFrame | None = None,
    citations: DataFrame | None = None, links: DataFrame | None = None, scores: DataFrame | None = None,
    disjoint: bool = False, index: DataFrame | None = None,
) -> DataFrame:
    """Fused, dated, reranked and explained results of every query.

    Lists: exact references, lexical (3k), dense (2k, modes hybrid and semantic), the law tree of those, the
    citation graph. Queries hold query_id, query and optionally as_of, which overrides the date found in
    the text. Optional inputs leave their list out.
    """
    given = F.col("as_of") if "as_of" in queries.columns else F.lit(None).cast("date")
    dated = queries.withColumn("query_date", F.coalesce(given, D.detect_query_date("query")))
    # Candidate lists hold a few k rows per query and are read several times: each is computed once.
    exact = durable(exact_lookup(queries, entries))
    lists = [durable(lexical_search(queries, entries, 3 * k, index).select("query_id", "canonical_ref", "rank"))]
    if chunks is not None and query_vectors is not None and mode in ("hybrid", "semantic"):
        hits = dense_topk(query_vectors, chunks, 2 * k).join(chunks.drop("vector"), "chunk_id")
        refs = chunk_refs(hits)
        again = W.partitionBy("query_id").orderBy("rank")
        lists.append(durable(refs.withColumn("rank", F.row_number().over(again)).select("query_id", "canonical_ref", "rank")))
    named = reduce(DataFrame.unionByName, [x.select("query_id", "canonical_ref") for x in [exact, *lists]])
    lists.append(tree_expand(named, entries))
    if aliases is not None and citations is not None and links is not None:
        lists.append(graph_expand(queries, aliases, citations, links))
    fused = rrf_fuse(reduce(DataFrame.unionByName, [x.withColumn("rank", F.col("rank").cast("bigint")) for x in lists]))
    found = assemble(fused, exact, entries, k).join(dated.select("query_id", "query_date"), "query_id")
    placed = annotate_temporal(found, versions, "canonical_ref", "query_date", disjoint)
    ordered = rerank(placed, scores).filter(F.col("rank") <= k)
    return explain(ordered)


def private_search(queries: DataFrame, precedents: DataFrame, k: int) -> DataFrame:
    """Items of the query's own organisation that hold all of its first eight words; never primary law.

    Queries hold query_id, org_id, query; precedents hold org_id, item_id, title, body. The rank value
    is 0.1 per matching position.
    """
    first = F.slice(F.filter(F.split(F.lower(T.strip("query")), r"\s+"), lambda t: t != ""), 1, 8)
    wanted = F.array_distinct(F.flatten(F.transform(first, lambda t: T.folded_tokens(t))))
    asked = queries.select("query_id", "org_id", wanted.alias("terms")).filter(F.size("terms") > 0)
    terms = asked.select("query_id", "org_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    words = precedents.select("org_id", "item_id", F.explode_outer(T.folded_tokens("body")).alias("term"))
    counted = words.filter("term IS NOT NULL").groupBy("org_id", "item_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    met = counted.join(terms, ["org_id", "term"]).groupBy("query_id", "org_id", "item_id", "n_terms").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tf").alias("hits")
    )
    scored = met.filter("n = n_terms").withColumn("score", F.round(F.col("hits") * 0.1, 6))
    top = top_per_key(scored, ["query_id"], [F.desc("score"), "item_id"], k)
    return top.join(precedents.select("org_id", "item_id", "title"), ["org_id", "item_id"]).select(
        "query_id", "org_id", "item_id", "title", "score", "rank", F.lit(True).alias("internal"),
        F.lit(False).alias("primary_authority"),
    )
