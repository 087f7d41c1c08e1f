"""Retrieval quality and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import fixed, text as T

METRICS = ["recall_10", "recall_50", "mrr", "ndcg_10", "precision_10"]


def ranking_metrics(queries: DataFrame, ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """recall@10, recall@50, MRR, nDCG@10 and precision@10 per query, 3 decimals, 0 when undefined."""
    relevant = gold.select("query_id", "canonical_ref").distinct()
    sizes = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("_rel"))
    marked = ranked.join(relevant.withColumn("_hit", F.lit(1)), ["query_id", "canonical_ref"], "left")
    hit, rank = F.coalesce("_hit", F.lit(0)), F.col("rank")
    per = marked.groupBy("query_id").agg(
        F.sum(F.when(rank <= 10, hit).otherwise(0)).alias("_h10"), F.sum(F.when(rank <= 50, hit).otherwise(0)).alias("_h50"),
        F.min(F.when(hit == 1, rank)).alias("_first"),
        F.sum(F.when((rank <= 10) & (hit == 1), 1.0 / F.ln(rank + 1)).otherwise(0.0)).alias("_dcg"),
        F.count(F.lit(1)).alias("_n"),
    )
    out = queries.join(per, "query_id", "left").join(sizes, "query_id", "left")
    rel = F.coalesce("_rel", F.lit(0))
    ideal = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.when(i <= rel, 1.0 / F.ln(i + 1)).otherwise(0.0)),
        F.lit(0.0), lambda acc, x: acc + x,
    )

    def value(c: Column, name: str) -> Column:
        return F.round(F.coalesce(c, F.lit(0.0)), 3).alias(name)

    return out.select(
        *queries.columns,
        value(F.col("_h10") / F.greatest(F.lit(1), rel), "recall_10"),
        value(F.col("_h50") / F.greatest(F.lit(1), rel), "recall_50"),
        value(1.0 / F.col("_first"), "mrr"),
        value(F.when(rel > 0, F.col("_dcg") / ideal), "ndcg_10"),
        value(F.col("_h10") / F.least(F.lit(10), F.col("_n")), "precision_10"),
    )


def segment_metrics(per_query: DataFrame) -> DataFrame:
    """Mean of each (rounded) metric per language, query type, jurisdiction, temporal and exact/semantic segment."""
    keys = F.array_compact(F.array(
        T.blank_to_null("language"), T.blank_to_null("query_type"), T.blank_to_null("jurisdiction"),
        F.when(F.col("relevant_date").isNotNull(), "temporal").otherwise("non_temporal"),
        F.when(F.col("query_type") == "exact_reference", "exact").otherwise("semantic"),
    ))
    rows = per_query.select(F.explode(keys).alias("segment"), *METRICS)
    return rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(m), 3).alias(m) for m in METRICS]
    )


def scope_results(ranked: DataFrame, laws: DataFrame, judgments: DataFrame) -> DataFrame:
    """Results inside the benchmark corpus, ranked anew. `laws` holds law, `judgments` holds canonical_ref."""
    keyed = ranked.withColumn("_law", T.ref_law("canonical_ref"))
    in_laws = keyed.join(laws.select(F.col("law").alias("_law")).distinct(), "_law", "left_semi")
    in_cases = keyed.filter("_law IS NULL").join(judgments.select("canonical_ref").distinct(), "canonical_ref", "left_semi")
    kept = in_laws.unionByName(in_cases).drop("_law")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "canonical_ref")))


def evaluate(queries: DataFrame, ranked: DataFrame, gold: DataFrame, hard_negatives: DataFrame) -> DataFrame:
    """Metrics per query with its top five results and the sizes of its relevant and hard-negative sets.

    Hard negatives are shown, never scored.
    """
    metrics = ranking_metrics(queries, ranked, gold)
    top = ranked.filter("rank <= 5").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "canonical_ref"))).alias("_t"))
    top = top.select("query_id", F.transform("_t", lambda x: x["canonical_ref"]).alias("ranked_top"))

    def size(df: DataFrame, name: str) -> DataFrame:
        return df.select("query_id", "canonical_ref").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias(name))

    out = metrics.join(top, "query_id", "left").join(size(gold, "relevant"), "query_id", "left")
    out = out.join(size(hard_negatives, "hard_negatives"), "query_id", "left")
    return out.fillna(0, ["relevant", "hard_negatives"])


def feedback_signals(feedback: DataFrame) -> DataFrame:
    """Counts of each accepted judgement per (query, reference). Signals for people, not for training."""
    valid = feedback.filter(F.col("judgement").isin(fixed.FEEDBACK_JUDGEMENTS))
    counts = valid.groupBy("query", "canonical_ref").pivot("judgement", fixed.FEEDBACK_JUDGEMENTS).agg(F.count(F.lit(1)))
    return counts.fillna(0, fixed.FEEDBACK_JUDGEMENTS)
