"""References in text, citation checks and the citation graph as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, scan, text as T
from ..scale import first_per_key, tiled_join
from ..session import durable, stored


def reference_mentions(df: DataFrame, text: str) -> DataFrame:
    """One row per reference in the text: kind, its parts, exact span. All inside the row, no shuffle."""
    return scan.scanned(df, text, scan.mentions, scan.MENTION_TYPE)


def with_citation(df: DataFrame, text: str, name: str = "_c") -> DataFrame:
    """Adds the first reference of the text as a struct.

    Exploding a one-element array keeps Spark from copying the whole expression to each use of a field.
    """
    return df.select("*", F.explode_outer(F.array(T.citation(text))).alias(name))


def classify_citations(df: DataFrame, text: str) -> DataFrame:
    """Adds the first reference of each text: kind, article, law, year, case_number, ecli, confidence."""
    return with_citation(df, text).select(*df.columns, "_c.*")


def entry_keys(entries: DataFrame, *extra: str) -> DataFrame:
    """(key, canonical_ref) of every way an entry can be cited, with further columns if named."""
    keys = F.array_compact(
        F.array(
            F.concat(F.lit("art|"), "ref_law", F.lit("|"), "ref_article"),
            F.concat(F.lit("law|"), "ref_law"),
            F.concat(F.lit("ecli|"), "ecli"),
            F.concat(F.lit("case|"), "case_number"),
        )
    )
    return entries.select(F.explode(keys).alias("key"), "canonical_ref", *extra)


def validate_citations(citations: DataFrame, entries: DataFrame, text: str = "cite") -> DataFrame:
    """parsed, exists and number of matching entries per citation text.

    Entries are counted per key before the join, so a law with many provisions stays one row.
    """
    parsed = with_citation(citations, text).withColumn("_key", T.reference_key(F.col("_c")))
    counts = entry_keys(entries).groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    out = parsed.join(counts, "_key", "left")
    known = F.col("_c.kind") != "unknown"
    matches = F.when(known, F.coalesce("_n", F.lit(0)))
    return out.select(
        *citations.columns, known.alias("parsed"), F.col("_c.kind").alias("kind"), F.col("_c.law").alias("law"),
        F.col("_c.article").alias("article"), F.col("_c.case_number").alias("case_number"),
        F.col("_c.ecli").alias("ecli"), (matches > 0).alias("exists"), matches.alias("matches"),
    )


def resolve_authorities(citations: DataFrame, entries: DataFrame, text: str = "cite") -> DataFrame:
    """Adds canonical_ref, title and the first 300 characters of the entry a citation names.

    `verified` is false for a citation without an entry; use it to split off the rejects.
    Of several entries the first by canonical_ref counts, chosen before the join.
    """
    keyed = with_citation(citations, text).withColumn("_key", T.reference_key(F.col("_c")))
    named = entry_keys(entries).groupBy(F.col("key").alias("_key")).agg(F.min("canonical_ref").alias("canonical_ref"))
    found = keyed.join(named, "_key", "left")
    detail = first_per_key(
        entries.select("canonical_ref", "title", F.substring("body", 1, 300).alias("text"), "kind"),
        ["canonical_ref"], ["kind"],
    ).drop("kind")
    out = found.join(detail, "canonical_ref", "left")
    return out.select(
        *citations.columns, F.col("canonical_ref").isNotNull().alias("verified"), "canonical_ref", "title",
        F.coalesce("text", F.when(F.col("canonical_ref").isNotNull(), F.lit(""))).alias("text"),
    )


def provision_cross_refs(wording: DataFrame) -> DataFrame:
    """Article mentions inside a law's wording as edges to that law's article, without self references.

    Needs law, node_id, node_type, number, source_text of one version per law.
    """
    texts = wording.select(F.col("law").alias("in_law"), "node_id", "source_text")
    found = reference_mentions(texts, "source_text").filter("kind = 'article'").drop("law")
    targets = wording.filter("node_type = 'ARTICLE'").select(
        F.col("law").alias("in_law"), F.col("number").alias("article"), F.col("node_id").alias("target_id")
    ).distinct()
    edges = found.join(targets, ["in_law", "article"]).filter("node_id <> target_id").withColumnRenamed("in_law", "law")
    return edges.select(
        "law", F.col("node_id").alias("source_id"), "target_id", F.lit("REFERENCES").alias("relationship"),
        F.col("text").alias("source_text"), F.col("start").alias("span_start"), F.col("end").alias("span_end"),
        F.lit("high").alias("confidence"),
    ).dropDuplicates(["law", "source_id", "target_id", "span_start", "span_end"])


def enrich_judgments(paragraphs: DataFrame, judgments: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges out of judgment paragraphs, each with its paragraph as evidence, to be reviewed.

    APPLIES: an article mention joined to that article of the judgment's applicable law.
    CITES: an ECLI mention; the second ECLI part is the target jurisdiction.
    `nodes` holds law, node_type, number, node_id.
    """
    base = paragraphs.join(judgments.select(key, "jurisdiction", "applicable_law"), key)
    found = reference_mentions(
        base.select(key, "jurisdiction", "applicable_law", "para_number", F.col("text").alias("_text")), "_text"
    ).filter(F.col("kind").isin("article", "judgment_ecli"))
    articles = nodes.filter("node_type = 'ARTICLE'").select(
        F.col("law").alias("applicable_law"), F.col("number").alias("article"), "node_id"
    ).distinct()
    applies = found.filter("kind = 'article'").join(articles, ["applicable_law", "article"]).select(
        key, "para_number", F.lit("APPLIES").alias("relationship"), F.col("node_id").alias("target_key"),
        F.col("jurisdiction").alias("target_jurisdiction"),
    )
    cites = found.filter("kind = 'judgment_ecli'").select(
        key, "para_number", F.lit("CITES").alias("relationship"), F.col("ecli").alias("target_key"),
        F.get(F.split("ecli", ":"), F.lit(1)).alias("target_jurisdiction"),
    )
    return applies.unionByName(cites).dropDuplicates([key, "para_number", "relationship", "target_key"]).withColumn(
        "review_status", F.lit("review_required")
    )


def case_aliases(judgments: DataFrame) -> DataFrame:
    """(alias, canonical_id): every key a judgment may be cited by."""
    names = F.array_compact(F.array("ecli", "case_number", F.concat(F.lit("judgment-"), "case_number"), "canonical_id"))
    return judgments.select(F.explode(F.array_distinct(names)).alias("alias"), "canonical_id")


def alias_classes(aliases: DataFrame) -> DataFrame:
    """(name, case_class): all names of a case, also where alias rows chain, under the least of them.

    `aliases` holds alias, canonical_id; either may stand as the other in a further row. Every name takes the least
    label around it, then the label of its label, until nothing changes: chains halve with each round.
    """
    pairs = aliases.select(F.col("alias").alias("a"), F.col("canonical_id").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    edges = durable(pairs.union(pairs.select("b", "a")).distinct())
    labels = durable(edges.groupBy(F.col("a").alias("name")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        around = edges.join(labels.withColumnsRenamed({"name": "b", "label": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = labels.join(around, F.col("name") == F.col("a")).select("name", "label", F.least("label", "near").alias("low"))
        further = labels.withColumnsRenamed({"name": "low", "label": "lowest"})
        moved = durable(lower.join(further, "low").select("name", F.least("low", "lowest").alias("label"), F.col("label").alias("before")))
        labels = moved.select("name", "label")
        if moved.filter("label <> before").isEmpty():
            return labels.withColumnRenamed("label", "case_class")


def expand_cases(
    keys: DataFrame, citations: DataFrame, treatments: DataFrame, links: DataFrame, aliases: DataFrame | None = None
) -> DataFrame:
    """Everything around each case as rows: relation, other key, label, jurisdiction, review status.

    Relations: cited, citing, treatment, legislation_link. A much-cited case yields many rows,
    never one collected group. A null key expands to nothing. With `aliases` (alias, canonical_id) a case is
    asked for by any of its names and has the edges of all of them.
    """
    wanted = keys.select(F.col("case_key").alias("_asked"), F.col("case_key").alias("_key")).distinct().filter("_key IS NOT NULL")
    if aliases is not None:
        classes = durable(alias_classes(aliases))
        others = wanted.join(classes, F.col("_asked") == F.col("name")).select("_asked", "case_class")
        others = others.join(classes, "case_class").select("_asked", F.col("name").alias("_key"))
        wanted = wanted.union(others).distinct()
    none = F.lit(None).cast("string")

    def side(edges: DataFrame, on: str, relation: str, other: Column, label: str, jurisdiction: Column, status: Column):
        return edges.join(wanted, F.col(on) == F.col("_key")).select(
            F.col("_asked").alias("case_key"), F.lit(relation).alias("relation"), other.alias("other_key"),
            F.col(label).alias("label"), jurisdiction.alias("jurisdiction"), status.alias("review_status"),
        )

    return (
        side(citations, "source_key", "cited", F.col("target_key"), "kind", F.col("target_jurisdiction"), none)
        .unionByName(side(citations, "target_key", "citing", F.col("source_key"), "kind", F.col("source_jurisdiction"), none))
        .unionByName(side(treatments, "source_key", "treatment", F.col("target_key"), "treatment",
                          F.col("target_jurisdiction"), F.col("review_status")))
        .unionByName(side(links, "judgment_key", "legislation_link", F.col("provision_key"), "relationship",
                          F.col("legislation_jurisdiction"), none))
    )


def expand_provisions(keys: DataFrame, references: DataFrame, links: DataFrame) -> DataFrame:
    """References out, references in and applying cases per provision, as rows."""
    wanted = keys.select(F.col("provision_key").alias("_key")).distinct().filter("_key IS NOT NULL")

    def side(edges: DataFrame, on: str, relation: str, other: str):
        return edges.join(wanted, F.col(on) == F.col("_key")).select(
            F.col(on).alias("provision_key"), F.lit(relation).alias("relation"), F.col(other).alias("other_key"),
            F.col("relationship").alias("label"),
        )

    return (
        side(references, "source_key", "references_out", "target_key")
        .unionByName(side(references, "target_key", "referenced_by", "source_key"))
        .unionByName(side(links, "provision_key", "case", "judgment_key"))
    )


def normalize_treatments(df: DataFrame) -> DataFrame:
    """Unknown treatments become DISCUSSES; a missing status becomes review_required."""
    known = F.coalesce(F.col("treatment").isin(fixed.TREATMENTS), F.lit(False))
    return df.withColumn("treatment", F.when(known, F.col("treatment")).otherwise("DISCUSSES")).withColumn(
        "review_status", F.coalesce("review_status", F.lit("review_required"))
    )


# Relationship each edge kind defaults to, and the shape of an id.
EDGE_DEFAULTS = {"case_citation": "CITES", "law_link": "APPLIES", "provision_reference": "REFERENCES"}
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def build_edges(df: DataFrame, kind: str) -> DataFrame:
    """Typed edges of one kind with defaults filled in.

    Needs source_key, target_key, source_jurisdiction, target_jurisdiction, relationship, evidence_id.
    An evidence id that is no id makes the edge invalid.
    """
    return df.select(
        F.lit(kind).alias("edge_kind"), "source_key", "target_key", "source_jurisdiction",
        F.coalesce("target_jurisdiction", "source_jurisdiction").alias("target_jurisdiction"),
        F.coalesce("relationship", F.lit(EDGE_DEFAULTS[kind])).alias("relationship"), "evidence_id",
        F.lit("review_required").alias("review_status"),
        (F.col("evidence_id").isNull() | F.col("evidence_id").rlike(UUID)).alias("valid"),
    )


def adverse_authorities(results: DataFrame, treatments: DataFrame, matter: DataFrame) -> DataFrame:
    """Adverse material per query: authorities the lawyer marked adverse on the matter, and
    results whose case distinguishes, overrules or criticises another.

    `results` holds query_id, matter_id, canonical_ref, case_key; `matter` holds matter_id, canonical_ref,
    classification, matter_issue.
    """
    none = F.lit(None).cast("string")
    # Few matters have many queries and many authorities each, which meet in far more rows than either has.
    queries = stored(results.select("query_id", "matter_id").distinct())
    decided = tiled_join(matter.filter("classification = 'adverse'").select("matter_id", "canonical_ref", "matter_issue"), queries, "matter_id").select(
        "query_id", "canonical_ref", F.col("matter_issue").alias("basis"), none.alias("treatment"),
        F.lit("LAWYER DECISION").alias("provenance"), none.alias("review_status"),
    )
    hostile = treatments.filter(F.col("treatment").isin(fixed.ADVERSE_TREATMENTS)).select(
        F.col("source_key").alias("case_key"), "treatment", "review_status"
    )
    found = results.filter("case_key IS NOT NULL").join(hostile, "case_key").select(
        "query_id", "canonical_ref", none.alias("basis"), "treatment",
        F.lit("STRUCTURED_EXTRACTION").alias("provenance"),
        F.coalesce("review_status", F.lit("review_required")).alias("review_status"),
    )
    return decided.unionByName(found)
