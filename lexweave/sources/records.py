"""Source records: reading, normalising, snapshots and document pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed, text as T
from ..scale import first_per_key

# Column headings of a decisions file, and suffixes always read as text.
DECISION_NO = "Decision No."
SUMMARY = "Decision Summary"
LEGISLATION = "Legislation on which Decision was based"
COMPANY = "Affected Company/Organisations"
URL = "Download_URL"
DATE = "Decision Date"
TEXT_SUFFIXES = (".txt", ".md", ".csv")


def read_decisions(spark: SparkSession, path: str, title_prefix: str = "") -> DataFrame:
    """Decisions from CSV files with a header."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return decision_records(raw, title_prefix)


def decision_records(raw: DataFrame, title_prefix: str = "") -> DataFrame:
    """Rows with a decision number as records: canonical_key, title, body and the decision's fields."""

    def field(name: str) -> Column:
        return F.trim(F.coalesce(F.col(f"`{name}`"), F.lit("")))

    rows = raw.select(
        field(DECISION_NO).alias("decision_no"), field(SUMMARY).alias("summary"), field(LEGISLATION).alias("legislation"),
        field(COMPANY).alias("company"), field(URL).alias("_url"), field(DATE).alias("decision_date"),
    ).filter("decision_no <> ''")
    body = F.concat_ws(
        "\n", F.concat(F.lit("Decision "), "decision_no"), T.blank_to_null("summary"),
        F.concat(F.lit("Statutory basis: "), "legislation"), F.concat(F.lit("Affected undertaking: "), "company"),
    )
    title = F.concat(F.lit(title_prefix), F.lit(" – Απόφαση "), "decision_no")
    return rows.select(
        F.concat(F.lit("consumer-decision-"), T.slug("decision_no")).alias("canonical_key"),
        F.regexp_replace(title, "^[ –]+|[ –]+$", "").alias("title"), body.alias("body"), "legislation", "company", "summary",
        "decision_no", "decision_date", T.blank_to_null("_url").alias("external_url"),
    )


def normalize_table(df: DataFrame, key_prefix: str) -> DataFrame:
    """Any table as records: body `k: v | k: v` over non-empty cells, a key from its hash, the cells as a map."""
    cells = F.array(*[
        F.struct(F.lit(c.strip()).alias("key"), F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias("value"))
        for c in df.columns if c.strip()
    ])
    filled = F.filter(cells, lambda x: x["value"] != "")
    body = F.array_join(F.transform(filled, lambda x: F.concat(x["key"], F.lit(": "), x["value"])), " | ")
    rows = df.select(body.alias("body"), F.map_from_entries(cells).alias("structured"))
    key = F.concat(T.slug(F.lit(key_prefix)), F.lit("-"), F.substring(T.sha256("body"), 1, 10))
    return rows.select(key.alias("canonical_key"), "body", "structured")


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text of files; empty when a file is not text."""
    return decode_documents(spark.read.format("binaryFile").load(path).select("path", "content"))


def decode_documents(df: DataFrame) -> DataFrame:
    """UTF-8 text of `content`. Text suffixes decode with replacement; other files must be valid and free of NUL."""
    name = F.lower("path")
    is_text = F.lit(False)
    for suffix in TEXT_SUFFIXES:
        is_text = is_text | name.endswith(suffix)
    raw = F.col("content").cast("string")
    clean = F.is_valid_utf8(raw) & ~F.contains(raw, F.lit("\0"))
    text = F.when(is_text, F.make_valid_utf8(raw)).when(clean, raw).otherwise("")
    return df.select("path", text.alias("text"))


def validate_acts(df: DataFrame) -> DataFrame:
    """Adds title, body and `reject_reason`, null for acts with a well-formed CELEX and an official title."""
    title = F.coalesce(T.blank_to_null("title_el"), T.blank_to_null("title_en"))
    reason = F.when(~F.coalesce(F.col("celex").rlike(fixed.CELEX), F.lit(False)), "invalid or missing CELEX").when(
        title.isNull(), "no official title"
    )
    return df.withColumn("title", title).withColumn(
        "body", F.concat_ws("\n", title, T.blank_to_null("title_en"))
    ).withColumn("reject_reason", reason)


def discover(df: DataFrame, cursor: str | None, key: str) -> DataFrame:
    """Records from the cursor on, in key order."""
    rows = df if cursor is None else df.filter(F.col(key) >= cursor)
    return rows.orderBy(key)


def snapshot_id() -> Column:
    return T.sha256(F.concat_ws(":", "source", "record_id", "content_hash"))


def snapshot(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Contents not yet stored for their (source, record), first arrival of each.

    Incoming rows hold source, record_id, payload, arrival; existing ones source, record_id, content_hash.
    """
    hashed = incoming.withColumn("content_hash", T.sha256("payload"))
    keys = ["source", "record_id", "content_hash"]
    fresh = hashed.join(existing.select(*keys), keys, "left_anti")
    return first_per_key(fresh, keys, ["arrival"]).withColumn("snapshot_id", snapshot_id())


def upsert_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Pointer of every (source, canonical_key) after a batch, with what the batch did to it.

    The latest arrival wins; content seen before points back to its old snapshot. `current` holds source,
    canonical_key, snapshot_id; a pointer the batch does not touch keeps all flags false.
    """
    arrived = incoming.select("source", "canonical_key", "record_id", T.sha256("payload").alias("content_hash"), "arrival")
    latest = arrived.groupBy("source", "canonical_key").agg(
        F.max_by(F.struct("record_id", "content_hash"), "arrival").alias("_l")
    ).select("source", "canonical_key", "_l.*").withColumn("_new", snapshot_id())
    both = current.withColumnRenamed("snapshot_id", "_old").join(latest, ["source", "canonical_key"], "full_outer")
    created, arrived_ = F.col("_old").isNull(), F.col("_new").isNotNull()
    same = F.col("_old").eqNullSafe(F.col("_new"))
    return both.select(
        "source", "canonical_key", F.coalesce("_new", "_old").alias("snapshot_id"), created.alias("created_new"),
        (~created & arrived_ & ~same).alias("version_changed"), (~created & arrived_ & same).alias("deduplicated"),
    )


def lineage(
    stages: dict[str, DataFrame], run_id: str, *, parser_version: str, normalizer_version: str,
    embedding_version: str | None = None,
) -> DataFrame:
    """One row per derived artifact: stage, artifact_id, snapshot_id and the versions that made it."""
    out = None
    for stage, df in stages.items():
        rows = df.select(
            F.lit(run_id).alias("run_id"), F.lit(stage).alias("stage"), "artifact_id", "snapshot_id",
            F.lit(parser_version).alias("parser_version"), F.lit(normalizer_version).alias("normalizer_version"),
            F.lit(embedding_version).cast("string").alias("embedding_version"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def refresh_proposed(current: DataFrame, extracted: DataFrame, document: str = "document_id") -> DataFrame:
    """Rows after re-extraction: proposed rows of the extracted documents are replaced, reviewed ones stay.

    `extracted` holds every re-extracted document's rows; both hold `status`.
    """
    redone = extracted.select(document).distinct().withColumn("_redone", F.lit(True))
    kept = current.join(redone, document, "left").filter("NOT (status = 'proposed' AND _redone IS NOT NULL)").drop("_redone")
    return kept.unionByName(extracted)
