"""Text to provisions, judgment sections, paragraphs and retrieval chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text as T
from ..scale import first_per_key, position_block, sequence_in_blocks, top_per_key
from ..session import stored


def split_provisions(df: DataFrame, text: str = "raw_text", strict_paragraphs: bool = True) -> DataFrame:
    """One row per ARTICLE and PARAGRAPH of each text: node_type, number, parent_article, source_text, sort_order.

    Works inside the row, so no shuffle: the lines between two article headings form
    a slice of the line array. Text before the first heading is dropped. In strict mode
    `(1) text` with a space stays in the article body and only `(1)text` opens a paragraph.
    """
    others = [c for c in df.columns if c != text]
    listed = with_provisions(df, text, "_nodes", strict_paragraphs)
    exploded = listed.select(*others, F.posexplode_outer("_nodes").alias("sort_order", "_node")).filter("sort_order IS NOT NULL")
    return exploded.select(*others, "_node.*", "sort_order")


def with_provisions(df: DataFrame, text: str, name: str, strict_paragraphs: bool = True) -> DataFrame:
    """`df` with the rows of `split_provisions` of each text as an array `name` instead of the text."""
    paragraph = fixed.PARAGRAPH_HEADING if strict_paragraphs else fixed.PARAGRAPH_HEADING_LOOSE

    def mark(line: Column, i: Column) -> Column:
        article = T.blank_to_null(F.regexp_extract(line, fixed.FLAGS + fixed.ARTICLE_HEADING, 1))
        para = T.blank_to_null(F.regexp_extract(line, fixed.FLAGS + paragraph, 1))
        return F.struct(
            i.alias("pos"), line.alias("line"), article.alias("article"),
            F.when(article.isNull(), para).alias("para"),
        )

    marked = df.withColumn("_lines", F.transform(T.lines(text), mark))
    opening = F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("article"))
    heads = F.transform(
        F.filter("_lines", lambda x: x["article"].isNotNull()),
        lambda x: F.struct(x["pos"].alias("pos"), x["article"].alias("article")),
    )
    marked = marked.withColumn("_heads", F.concat(F.array(opening), heads))

    def section(head: Column, j: Column) -> Column:
        end = F.coalesce(F.get(F.col("_heads"), j + 1)["pos"], F.size("_lines"))
        return F.struct(
            head["article"].alias("article"),
            F.slice("_lines", head["pos"] + 2, end - head["pos"] - 1).alias("lines"),
        )

    def rows(part: Column) -> Column:
        def paragraph_row(x: Column) -> Column:
            return F.struct(
                F.lit("PARAGRAPH").alias("node_type"), x["para"].alias("number"),
                part["article"].alias("parent_article"), T.strip(x["line"]).alias("source_text"),
            )

        body = F.array_join(
            F.transform(F.filter(part["lines"], lambda x: x["para"].isNull()), lambda x: x["line"]), "\n"
        )
        article_row = F.struct(
            F.lit("ARTICLE").alias("node_type"), part["article"].alias("number"),
            F.lit(None).cast("string").alias("parent_article"), T.strip(body).alias("source_text"),
        )
        paras = F.transform(F.filter(part["lines"], lambda x: x["para"].isNotNull()), paragraph_row)
        return F.when(part["article"].isNull(), paras).otherwise(F.concat(paras, F.array(article_row)))

    sections = marked.withColumn("_sections", F.transform("_heads", section))
    return sections.select(*[c for c in df.columns if c != text], F.flatten(F.transform("_sections", rows)).alias(name))


def node_key(law: str | Column, node_type: Column, parent: Column, number: Column) -> Column:
    """Permanent provision identity. The parent article is part of it."""
    return T.sha256(
        F.concat_ws(":", F.col(law) if isinstance(law, str) else law, node_type, F.coalesce(parent, F.lit("")), number)
    )


def with_node_ids(provisions: DataFrame, law: str = "law") -> DataFrame:
    own = node_key(law, F.col("node_type"), F.col("parent_article"), F.col("number"))
    parent = node_key(law, F.lit("ARTICLE"), F.lit(""), F.col("parent_article"))
    return provisions.withColumn("node_id", own).withColumn(
        "parent_id", F.when(F.col("parent_article").isNotNull(), parent)
    )


def provision_nodes(provisions: DataFrame, law: str = "law", order: str = "arrival") -> DataFrame:
    """One row per permanent provision with the place it was first seen."""
    # Ids follow from what is grouped, so they are made once per provision and not shuffled.
    first = provisions.groupBy(law, "node_type", "number", "parent_article").agg(F.min(F.struct(order, "sort_order")).alias("_first"))
    return with_node_ids(first, law).select(
        "node_id", "parent_id", law, "node_type", "number", "parent_article",
        F.col(f"_first.{order}").alias("first_seen"), F.col("_first.sort_order").alias("sort_order"),
    )


def provision_ref(law: Column, node_type: Column, parent: Column, number: Column) -> Column:
    """`law-{law}-art-{n}` or, for a paragraph with a parent, `law-{law}-art-{n}-p{m}`."""
    nested = (node_type == "PARAGRAPH") & parent.isNotNull()
    return F.when(
        nested, F.concat(F.lit("law-"), law, F.lit("-art-"), parent, F.lit("-p"), number)
    ).otherwise(F.concat(F.lit("law-"), law, F.lit("-art-"), number))


def judgment_lines(df: DataFrame, key: str, text: str, part: str | None = None) -> DataFrame:
    """Non-empty trimmed lines with their section heading, if the line is one.

    `part` orders the pieces when a judgment arrives as several rows.
    """
    first = F.col(part).cast("bigint") if part else F.lit(0).cast("bigint")
    lines = df.select(key, first.alias("part"), F.posexplode_outer(T.lines(text)).alias("line_no", "line"))
    lines = lines.withColumn("line", T.strip("line")).filter(F.col("line") != "")
    heading = F.regexp_replace(F.lower("line"), r"[:.]+$", "")
    known = F.create_map(*[F.lit(x) for pair in fixed.HEADINGS.items() for x in pair])
    return lines.withColumn("heading_type", F.element_at(known, heading))


def segment_judgments(df: DataFrame, key: str, text: str, part: str | None = None, keep: bool = False) -> DataFrame:
    """One row per paragraph: section number, type and title, and the running paragraph number.

    Section numbers start at 1; section 0 is the text before the first heading (`body`). The lines are read four times;
    `keep` stores them, so that the texts are cut once.
    """
    lines = judgment_lines(df, key, text, part)
    lines = stored(lines) if keep else lines
    is_head = F.col("heading_type").isNotNull().cast("bigint")
    block = F.col("part") * 1000000 + position_block("line_no")
    ordered = sequence_in_blocks(
        lines, [key], ["part", "line_no"], block,
        totals={"section_no": is_head, "para_number": 1 - is_head},
    )
    heads = ordered.filter("heading_type IS NOT NULL").select(
        F.col(key).alias("_k"), F.col("section_no").alias("_s"),
        F.col("heading_type").alias("section_type"), F.col("line").alias("section_title"),
        F.col("para_number").alias("_start"),
    )
    paragraphs = ordered.filter("heading_type IS NULL")
    on = (F.col(key) == F.col("_k")) & (F.col("section_no") == F.col("_s"))
    return paragraphs.join(heads, on, "left").select(
        key, "section_no", F.coalesce("section_type", F.lit("body")).alias("section_type"), "section_title",
        "para_number", (F.col("para_number") - F.coalesce("_start", F.lit(0))).alias("para_in_section"),
        F.col("line").alias("text"),
    )


def judgment_segments(paragraphs: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Paragraphs of current judgment versions, one row per paragraph in reading order columns.

    `current` holds the keys whose version is the current one.
    """
    return paragraphs.join(current.select(key).distinct(), key, "left_semi")


def judgment_sections(paragraphs: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """The sections of the current judgments, each with its paragraphs in order as an array of (para_number, text)."""
    rows = judgment_segments(paragraphs, current, key)
    listed = F.array_sort(F.collect_list(F.struct("para_number", "text"))).alias("paragraphs")
    return rows.groupBy(key, "section_no", "section_type").agg(listed)


def extractive_summary(paragraphs: DataFrame, cases: DataFrame, key: str, limit: int = 3) -> DataFrame:
    """Up to three paragraphs of three or more words from the holding, then analysis, then order section.

    Only the first section of each type counts. A case without any gets the placeholder row.
    """
    preference = F.create_map(F.lit("holding"), F.lit(1), F.lit("legal_analysis"), F.lit(2), F.lit("order"), F.lit(3))
    wanted = paragraphs.withColumn("_pref", F.element_at(preference, F.col("section_type"))).filter("_pref IS NOT NULL")
    first = wanted.groupBy(key, "section_type").agg(F.min("section_no").alias("section_no"))
    usable = wanted.join(first, [key, "section_type", "section_no"], "left_semi").filter(T.word_count("text") >= 3)
    top = top_per_key(usable, [key], ["_pref", "para_number"], limit, "rank")
    found = top.select(key, "rank", F.col("section_type").alias("section"), F.col("para_number").cast("string"), "text")
    missing = cases.select(key).distinct().join(found.select(key), key, "left_anti").select(
        key, F.lit(1).alias("rank"), F.lit("holding").alias("section"),
        F.lit(None).cast("string").alias("para_number"), F.lit(fixed.NO_HOLDING).alias("text"),
    )
    return found.unionByName(missing)


CHUNK_COLUMNS = [
    "chunk_id", "document_type", "document_key", "version_id", "chunk_type", "text", "hierarchy_context",
    "article_number", "paragraph_number", "section_type", "content_hash",
]


def _finish_chunks(df: DataFrame, seed: Column) -> DataFrame:
    return df.withColumn("chunk_id", T.sha256(seed)).withColumn("content_hash", T.sha256("text")).select(*CHUNK_COLUMNS)


def provision_chunks(wording: DataFrame) -> DataFrame:
    """One chunk per non-empty provision wording.

    Needs law, title, jurisdiction, version_id, node_type, number, parent_article, source_text.
    """
    none = F.lit(None).cast("string")
    rows = wording.filter(F.coalesce(F.length("source_text"), F.lit(0)) > 0).select(
        F.lit("legislation").alias("document_type"), F.col("law").alias("document_key"), "version_id",
        F.lit("paragraph").alias("chunk_type"), F.col("source_text").alias("text"),
        F.concat_ws(
            "\n", F.concat(F.lit("Law: "), "title"), F.concat(F.lit("Jurisdiction: "), "jurisdiction"),
            F.concat(F.lit("Article "), "number"),
        ).alias("hierarchy_context"),
        F.col("number").alias("article_number"), F.col("number").alias("paragraph_number"),
        none.alias("section_type"), "node_type", "parent_article",
    )
    seed = F.concat_ws(
        ":", F.lit("L"), "document_key", "version_id", "chunk_type", "node_type",
        F.coalesce("parent_article", F.lit("")), "paragraph_number",
    )
    return _finish_chunks(rows, seed)


def judgment_chunks(paragraphs: DataFrame, judgments: DataFrame, key: str) -> DataFrame:
    """One chunk per section (its paragraphs joined) and one per paragraph.

    Takes the output of segment_judgments; judgments hold key, title, version_id. A section is
    one text, so its paragraphs meet in one row.
    """
    named = paragraphs.join(judgments.select(key, "title", "version_id"), key)
    context = F.concat(F.coalesce("title", F.lit("")), F.lit("\nSection: "), F.col("section_type"))
    none = F.lit(None).cast("string")
    sections = (
        named.groupBy(key, "title", "version_id", "section_no", "section_type")
        .agg(F.sort_array(F.collect_list(F.struct("para_number", "text"))).alias("_p"))
        .withColumn("text", F.array_join(F.transform("_p", lambda p: p["text"]), "\n"))
        .filter(F.length("text") > 0)
        .select(
            key, "version_id", "section_no", "section_type", "text", context.alias("hierarchy_context"),
            F.lit("section").alias("chunk_type"), none.alias("paragraph_number"),
        )
    )
    single = named.select(
        key, "version_id", "section_no", "section_type", "text",
        context.alias("hierarchy_context"), F.lit("paragraph").alias("chunk_type"), F.col("para_number").cast("string").alias("paragraph_number"),
    )
    rows = sections.unionByName(single).select(
        F.lit("judgment").alias("document_type"), F.col(key).alias("document_key"), "version_id", "chunk_type", "text",
        "hierarchy_context", none.alias("article_number"), "paragraph_number", "section_type", "section_no",
    )
    seed = F.concat_ws(
        ":", F.lit("J"), "document_key", "version_id", "chunk_type", F.coalesce("paragraph_number", F.lit("sec")),
        F.col("section_no").cast("string"),
    )
    return _finish_chunks(rows, seed)


def build_chunks(wording: DataFrame, paragraphs: DataFrame, judgments: DataFrame, key: str) -> DataFrame:
    """Retrieval chunks of provisions and judgments; equal chunk ids are written once."""
    return provision_chunks(wording).unionByName(judgment_chunks(paragraphs, judgments, key))


def jurisdiction_terms(df: DataFrame, code: str) -> DataFrame:
    """Structural term per level for each row's jurisdiction, with CY for unknown codes."""
    terms = F.create_map(
        *[
            x
            for name, levels in fixed.NODE_TERMS.items()
            for x in (F.lit(name), F.create_map(*[F.lit(v) for pair in levels.items() for v in pair]))
        ]
    )
    own = F.coalesce(F.element_at(terms, F.col(code)), F.element_at(terms, F.lit("CY")))
    return df.select("*", F.explode(own).alias("level", "term"))


def source_document_chunks(records: DataFrame) -> DataFrame:
    """One section chunk per source record with a locator struct.

    Needs source, jurisdiction, canonical_key, title, body, authority_type, snapshot_id and the locator fields.
    """
    fields = [c for c in ("decision_no", "decision_date", "legislation", "company", "summary", "licence", "licence_url",
                          "external_url", "dataset_key") if c in records.columns]
    chunks = records.select(
        T.sha256(F.concat_ws(":", F.lit("srcdoc"), "source", "canonical_key")).alias("chunk_id"),
        F.lit("source_document").alias("document_type"), F.col("canonical_key").alias("document_key"),
        F.col("snapshot_id").alias("version_id"), F.lit("section").alias("chunk_type"), F.col("body").alias("text"),
        F.concat(
            "title", F.lit("\nJurisdiction: "), "jurisdiction", F.lit("\nType: "),
            F.coalesce("authority_type", F.lit("SOURCE_DOCUMENT")),
        ).alias("hierarchy_context"),
        F.struct("authority_type", *fields).alias("source_locator"),
        F.substring("canonical_key", 1, 64).alias("content_hash"),
    )
    return first_per_key(chunks, ["chunk_id"], ["version_id"])
