"""A training-data pipeline in five stages, each written as Parquet and read again by the next.

Stages take and return rows with the columns of `documents`; the last adds what
sharding decides. No row is dropped but by a stage's own decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.llm import decontaminate, line_crf, mixing, near_texts, queries, reshard
from lexweave.session import fresh_folder


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field accepts; it learns from the labelled documents of this stage's input."""
    field = line_crf.fit(docs, queries.table(spark, sf_dir, "labels"), F.lit(True))
    scored = line_crf.score(docs, field, name="_quality")
    return scored.where(F.col("_quality") >= line_crf.ACCEPT).drop("_quality")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity 0.8 of five-word shingles links. Fingerprints propose, and bands what SimHash alone would miss."""
    return near_texts.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its fitted rate says."""
    return mixing.mixed(docs, queries.mixture(docs, queries.table(spark, sf_dir, "labels")))


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its new shard and slot."""
    return reshard.reshard(docs, queries.old_shard(), 8)


STAGES = [
    ("quality_classifier", accept_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("mixing", mix_domains),
    ("sharding", place_in_shards),
]

#: SQL cannot express a trained field or an index search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
