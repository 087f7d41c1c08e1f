"""Similarity of judgments by separate dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text as T
from ..scale import position_block, sequence_in_blocks
from ..session import durable


def _overlap(pairs: DataFrame, counts: DataFrame, group: list[str]) -> DataFrame:
    """Per pair and group: sum of the smaller and of the larger token counts.

    The larger ones follow from the totals: max = a + b - min, so only shared tokens are joined.
    """
    counts = durable(counts)  # read for both sides and for the totals
    totals = counts.groupBy("id", *group).agg(F.sum("n").alias("total"))
    a = pairs.select("pair_id", F.col("a_id").alias("id")).join(counts, "id").select("pair_id", *group, "token", F.col("n").alias("na"))
    b = pairs.select("pair_id", F.col("b_id").alias("id")).join(counts, "id").select("pair_id", *group, "token", F.col("n").alias("nb"))
    shared = a.join(b, ["pair_id", *group, "token"]).groupBy("pair_id", *group).agg(F.sum(F.least("na", "nb")).alias("low"))
    ta = pairs.select("pair_id", F.col("a_id").alias("id")).join(totals, "id").select("pair_id", *group, F.col("total").alias("ta"))
    tb = pairs.select("pair_id", F.col("b_id").alias("id")).join(totals, "id").select("pair_id", *group, F.col("total").alias("tb"))
    both = ta.join(tb, ["pair_id", *group]).join(shared, ["pair_id", *group], "left")
    low = F.coalesce("low", F.lit(0))
    return both.select("pair_id", *group, (low / (F.col("ta") + F.col("tb") - low)).alias("score"))


def token_counts(texts: DataFrame, group: list[str] = []) -> DataFrame:
    """(id, group, token, n) of letter runs of three or more."""
    words = texts.select("id", *group, F.explode_outer(T.letter_tokens("text")).alias("token")).filter("token IS NOT NULL")
    return words.groupBy("id", *group, "token").agg(F.count(F.lit(1)).alias("n"))


def multiset_jaccard(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Token multiset overlap per pair, 3 decimals, 0 if a side has no token. Pairs hold pair_id, a_id, b_id."""
    scores = _overlap(pairs, token_counts(texts), [])
    return pairs.join(scores, "pair_id", "left").select(
        *pairs.columns, F.round(F.coalesce("score", F.lit(0.0)), 3).alias("score")
    )


def _set_overlap(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Per pair: size of the intersection and of the union of two sets (id, item)."""
    items = members.distinct()
    sizes = items.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    a = pairs.select("pair_id", F.col("a_id").alias("id")).join(items, "id").select("pair_id", "item")
    b = pairs.select("pair_id", F.col("b_id").alias("id")).join(items, "id").select("pair_id", "item")
    shared = a.join(b, ["pair_id", "item"]).groupBy("pair_id").agg(F.count(F.lit(1)).alias("shared"))
    out = pairs.join(sizes.select(F.col("id").alias("a_id"), F.col("size").alias("sa")), "a_id", "left")
    out = out.join(sizes.select(F.col("id").alias("b_id"), F.col("size").alias("sb")), "b_id", "left")
    out = out.join(shared, "pair_id", "left").fillna(0, ["sa", "sb", "shared"])
    return out.select("pair_id", "shared", (F.col("sa") + F.col("sb") - F.col("shared")).alias("joined"))


def shared_targets(pairs: DataFrame, citations: DataFrame) -> DataFrame:
    """Authorities both cases of a pair cite, one per row."""
    items = citations.select("id", "target_key").distinct()
    a = pairs.select("pair_id", F.col("a_id").alias("id")).join(items, "id").select("pair_id", "target_key")
    b = pairs.select("pair_id", F.col("b_id").alias("id")).join(items, "id").select("pair_id", "target_key")
    return a.join(b, ["pair_id", "target_key"])


def remedies(paragraphs: DataFrame) -> DataFrame:
    """(id, item): remedy words in the order sections of a case; a phrase may run over a paragraph break."""
    orders = paragraphs.filter("section_type = 'order'").select("id", "para_number", "text")
    joined = sequence_in_blocks(
        orders, ["id"], ["para_number"], position_block("para_number"), following={"_next": "text"}
    )
    text = F.lower(F.concat_ws(" ", "text", "_next"))
    terms = F.filter(F.array(*[F.lit(t) for t in fixed.REMEDIES]), lambda t: F.contains(text, t))
    return joined.select("id", F.explode(terms).alias("item")).distinct()


def compare_cases(pairs: DataFrame, cases: DataFrame, paragraphs: DataFrame, citations: DataFrame) -> DataFrame:
    """Five similarity dimensions per pair of known cases, one row each with an explanation.

    Cases hold id, court; paragraphs id, section_type, para_number, text; citations id, target_key.
    """
    known = cases.select("id", "court")
    pairs = pairs.select("pair_id", "a_id", "b_id").join(
        known.select(F.col("id").alias("a_id"), F.col("court").alias("_ca")), "a_id"
    ).join(known.select(F.col("id").alias("b_id"), F.col("court").alias("_cb")), "b_id")
    dimension = (
        F.when(F.col("section_type").isin("holding", "legal_analysis"), "LEGAL_ISSUE_SIMILARITY")
        .when(F.col("section_type") == "facts", "FACTUAL_SIMILARITY")
        .when(F.col("section_type") == "procedural_history", "PROCEDURAL_SIMILARITY")
    )
    texts = paragraphs.select("id", dimension.alias("dimension"), "text").filter("dimension IS NOT NULL")
    by_text = _overlap(pairs, token_counts(texts, ["dimension"]), ["dimension"])
    by_target = _set_overlap(pairs, citations.select("id", F.col("target_key").alias("item")))
    by_remedy = _set_overlap(pairs, remedies(paragraphs))

    def ratio(df: DataFrame, name: str) -> DataFrame:
        score = F.col("shared") / F.greatest(F.lit(1), "joined")
        return df.select("pair_id", F.lit(name).alias("dimension"), score.alias("score"), "shared")

    none = F.lit(None).cast("bigint")
    measured = by_text.withColumn("shared", none).unionByName(ratio(by_target, "STATUTORY_SIMILARITY")).unionByName(
        ratio(by_remedy, "REMEDY_SIMILARITY")
    )
    explained = [
        ("LEGAL_ISSUE_SIMILARITY", F.lit("Term overlap in holding/legal-analysis sections.")),
        ("FACTUAL_SIMILARITY", F.lit("Term overlap in the facts section.")),
        ("PROCEDURAL_SIMILARITY", F.lit("Same court + procedural-history overlap.")),
        ("STATUTORY_SIMILARITY", _counted("Shared cited authorities: ")),
        ("REMEDY_SIMILARITY", _counted("Shared remedy outcomes: ")),
    ]
    names = F.explode(F.array(*[F.lit(n) for n, _ in explained])).alias("dimension")
    rows = pairs.select("pair_id", "a_id", "b_id", "_ca", "_cb", names).join(measured, ["pair_id", "dimension"], "left")
    same_court = F.when((F.col("_ca") == F.col("_cb")) & (F.col("_ca") != ""), 1.0).otherwise(0.0)
    base = F.round(F.coalesce("score", F.lit(0.0)), 3)
    score = F.when(F.col("dimension") == "PROCEDURAL_SIMILARITY", F.round(0.5 * same_court + 0.5 * base, 3)).otherwise(base)
    explanation = F.coalesce(*[F.when(F.col("dimension") == n, e) for n, e in explained])
    return rows.select("pair_id", "a_id", "b_id", "dimension", score.alias("score"), explanation.alias("explanation"))


def _counted(prefix: str) -> Column:
    n = F.coalesce("shared", F.lit(0))
    return F.concat(F.lit(prefix), F.when(n == 0, "none").otherwise(n.cast("string")), F.lit("."))


def missing_cases(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """(pair_id, id) of pair members that are not known cases."""
    sides = pairs.select("pair_id", F.explode(F.array("a_id", "b_id")).alias("id"))
    return sides.join(cases.select("id"), "id", "left_anti").distinct()
