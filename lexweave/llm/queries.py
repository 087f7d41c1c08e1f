"""Registered queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    balltree, bloom_lm, decontaminate, line_crf, mixing, passages, prefix_doubling, prefix_trie, repair, reshard, secrets, simhash, url_rules,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


@_query("op1_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def old_shard() -> Column:
    """Where a document lies before resharding: six shards by source."""
    return F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % 6


@_query("op5_reshard")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = reshard.reshard(table(spark, sf_dir, "documents"), old_shard(), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


@_query("op7_line_crf")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = line_crf.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    scored = line_crf.score(docs.select("doc_id", "text"), field)
    return scored.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= line_crf.ACCEPT).cast("int").alias("predicted"),
    )


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table of the mixture: the language of the documents that `labels` covers."""
    covered = labels.select(F.col("doc_id").alias("k")).distinct()
    return docs.join(covered, docs["doc_id"] == covered["k"], "left_semi").select("doc_id", F.col("lang").alias("domain"))


def mixture(docs: DataFrame, labels: DataFrame) -> mixing.Mix:
    return mixing.fit_rates(docs, mixing.fit_domains(docs, labelled_domains(docs, labels)))


@_query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mix = mixture(docs, table(spark, sf_dir, "labels"))
    return mixing.with_rates(docs.select("doc_id", "text"), mix).drop("text")


@_query("op3_balltree")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return balltree.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@_query("op9_url_rules", f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN host LIKE 'ads.%' OR host LIKE '%.ads.%' OR path LIKE '/ads/%' OR path LIKE '/login%' OR path LIKE '/wp-admin/%'
      OR path LIKE '%.exe' OR path LIKE '%.zip' OR (host LIKE 'm.%' AND path LIKE '/%.html')
      OR (host LIKE 'blog.%' AND path LIKE '/%/99%') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


@_query("op6_bloom_lm")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder("doc_id", 10) == 0
    scored = bloom_lm.train_and_score(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query("op10_prefix_doubling")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = prefix_doubling.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return cut.withColumnRenamed("kept", "kept_sha256")


@_query("op2_passages")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_units(table(spark, sf_dir, "documents"))


@_query("op11_secrets")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda p: p["certain"])

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda p: p["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"), secrets.joined(F.col("findings")).alias("spans"),
    )


@_query("op12_prefix_trie")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), grafted=True)


@_query("op13_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    repaired = repair.repair(repair.damage(conversations))
    every = conversations.select("conv_id").distinct().withColumn("key", repair.keyed(F.col("conv_id")))
    both = every.join(repaired.figures, "key", "left").join(repaired.digests(), "key", "left")
    figures = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(
        "conv_id", *figures, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
