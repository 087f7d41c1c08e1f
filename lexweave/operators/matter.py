"""Facts, events, review state, evidence and grounded answers of matters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates as D, fixed, scan, text as T
from ..scale import position_block, sequence_in_blocks, top_per_key
from ..session import durable, stored
from .graph import adverse_authorities, resolve_authorities, validate_citations
from .retrieval import search
from .temporal import resolve_as_of

FACT = ("kind", "text", "char_start", "char_end", "confidence")


def extract_facts(df: DataFrame, text: str) -> DataFrame:
    """Money amounts (0.9), obligation phrases with 40 characters around (0.6) and capitalised names (0.7) with spans.

    Everything happens inside the row; a name counts once per text, at its first place.
    """
    return scan.scanned(df, text, scan.facts, scan.FACT_TYPE)


def extract_events(df: DataFrame, text: str) -> DataFrame:
    """Dated events (0.9) with the text up to the next stop, and event verbs without a near date (0.5)."""
    found = scan.scanned(df, text, scan.events, scan.EVENT_TYPE)
    dated = found.withColumn("event_date", D.safe_date(F.col("year"), F.col("month"), F.col("day")))
    kept = [c for c in df.columns if c != text]
    return dated.filter("event_date IS NOT NULL OR year IS NULL").select(
        *kept, "event_date", "description", "char_start", "char_end", "confidence"
    )


def chronology(events: DataFrame, matter: str = "matter_id") -> DataFrame:
    """Dated events of each matter in date order."""
    return events.filter("event_date IS NOT NULL").orderBy(matter, "event_date", "char_start")


def suggest_issues(facts: DataFrame, existing: DataFrame) -> DataFrame:
    """Issues the accepted facts of a matter point to, flagged `created` unless the matter has them.

    Facts hold matter_id, fact_id, text, status; existing issues matter_id, text, status. Keywords are looked for in
    the accepted facts in order of fact_id, joined by a space. A keyword of n words spans n facts at most, so each fact is
    searched with the ends of the n - 1 before it and no matter's text is gathered in one place.
    """
    keywords = [w for words, _ in fixed.ISSUE_RULES for w in words]
    accepted = facts.filter("status = 'accepted'").select(
        "matter_id", "fact_id", F.lower(F.coalesce("text", F.lit(""))).alias("_text")
    )
    longest = max(map(len, keywords))
    # What was cut off leaves a line break, which no keyword has, so that no keyword runs over the cut.
    end = F.when(F.length("_text") > longest, F.concat(F.lit("\n"), F.right("_text", F.lit(longest)))).otherwise(F.col("_text"))
    facts_before, last = [], "_end"
    accepted = accepted.withColumn(last, end)
    for k in range(max(w.count(" ") for w in keywords)):
        facts_before.insert(0, f"_before{k}")
        accepted = sequence_in_blocks(
            accepted, ["matter_id"], ["fact_id"], position_block("fact_id"), previous={facts_before[0]: last}
        )
        last = facts_before[0]
    text = F.concat_ws(" ", *facts_before, "_text")

    def found(words: list[str], issue: str) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        return F.when(hit, F.lit(issue))

    rules = F.array_compact(F.array(*[found(words, issue) for words, issue in fixed.ISSUE_RULES]))
    wanted = accepted.select("matter_id", F.explode(rules).alias("text")).distinct()
    known = existing.groupBy("matter_id", "text").agg(F.min("status").alias("_status"))
    return wanted.join(known, ["matter_id", "text"], "left").select(
        "matter_id", "text", F.coalesce("_status", F.lit("proposed")).alias("status"), F.col("_status").isNull().alias("created")
    )


def review_state(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Facts with their last accepted or rejected decision, else proposed. Other values are refused."""
    last = decisions.filter(F.col("status").isin(fixed.REVIEW_STATES)).groupBy("fact_id").agg(
        F.max_by("status", F.struct("ts", "decision_id")).alias("status")
    )
    return facts.join(last, "fact_id", "left").withColumn("status", F.coalesce("status", F.lit("proposed")))


AUTHORITY_FIELDS = [
    "jurisdiction", "authority_type", "source_scope", "authority_name", "lawyer_note", "matter_issue", "evidence",
]


def authority_state(log: DataFrame) -> DataFrame:
    """One row per (org, matter, reference) from a log of save, classify and suggest actions.

    Non-null saved fields overwrite; the lawyer's last classification wins; a suggestion is kept beside it and
    never changes it. A first save may bring its own classification. Log rows hold action, value, basis, ts, event_id
    and the fields of AUTHORITY_FIELDS; rows with a value that is not allowed are refused.
    """
    value = F.col("value")
    allowed = (
        ((F.col("action") == "save") & (value.isNull() | value.isin(fixed.CLASSIFICATIONS)))
        | ((F.col("action") == "classify") & value.isin(fixed.CLASSIFICATIONS))
        | ((F.col("action") == "suggest") & value.isin(fixed.SUGGESTIONS))
    )
    log = log.filter(allowed)
    at = F.struct("ts", "event_id")

    def last(expr: Column, when: Column) -> Column:
        return F.max_by(expr, F.when(when, at))

    save, classify, suggest = (F.col("action") == a for a in ("save", "classify", "suggest"))
    aggs = [last(F.col(c), save & F.col(c).isNotNull()).alias(c) for c in AUTHORITY_FIELDS]
    state = log.groupBy("org_id", "matter_id", "canonical_ref").agg(
        *aggs, last(value, classify).alias("_class"), F.min_by(F.when(save, value), at).alias("_first"),
        last(value, suggest).alias("suggestion"),
        last(F.coalesce("basis", F.lit("MODEL_INFERENCE")), suggest).alias("suggestion_provenance"),
        F.min("ts").alias("saved_at"),
    )
    return state.select(
        "org_id", "matter_id", "canonical_ref", *[c for c in AUTHORITY_FIELDS if c != "source_scope"],
        F.coalesce("source_scope", F.lit("public")).alias("source_scope"),
        F.coalesce("_class", "_first", F.lit("unclassified")).alias("classification"),
        "suggestion", "suggestion_provenance", "saved_at",
    )


def authority_list(state: DataFrame, classification: str | None = None) -> DataFrame:
    """Authorities per matter by save time."""
    rows = state if classification is None else state.filter(F.col("classification") == classification)
    return rows.orderBy("org_id", "matter_id", "saved_at", "canonical_ref")


def authority_folders(state: DataFrame) -> DataFrame:
    """(folder, authority) rows per matter; a folder is a classification, its size stands on every row."""
    keys = ["org_id", "matter_id", "classification"]
    sizes = state.groupBy(*keys).agg(F.count(F.lit(1)).alias("folder_size"))
    return state.select(*keys, "canonical_ref", "authority_name", "saved_at").join(sizes, keys)


def notifications(df: DataFrame, n: int = 50) -> DataFrame:
    """The newest `n` notifications of each organisation with their read flag."""
    flagged = df.withColumn("is_read", F.col("read_at").isNotNull())
    return top_per_key(flagged, ["org_id"], [F.desc("created_at"), F.desc("notification_id")], n)


def unique_follows(follows: DataFrame) -> DataFrame:
    return follows.select("org_id", "follow_key").distinct()


def follow_alerts(new_items: DataFrame, follows: DataFrame) -> DataFrame:
    """One alert per follow that a batch of new items touches, naming the newest item and how many there are.

    Items are reduced per key before the join, so a much-followed key joins one row.
    """
    touched = new_items.groupBy("follow_key").agg(
        F.max_by("reference", F.struct("ts", "reference")).alias("reference"), F.count(F.lit(1)).alias("items"),
        F.max("ts").alias("ts"),
    )
    return unique_follows(follows).join(touched, "follow_key").withColumn("kind", F.lit("followed_update"))


def assemble_memo(
    facts: DataFrame, issues: DataFrame, citations: DataFrame, entries: DataFrame, header: str = "RESEARCH MEMO (draft)"
) -> DataFrame:
    """Draft memo of every matter as ordered lines (matter_id, part, pos, line); always for lawyer review.

    Facts and issues hold matter_id, pos, text; citations matter_id, pos, cite. A citation without an entry never
    enters the text: it is a line of part `rejected`.
    """
    resolved = resolve_authorities(citations, entries)
    matters = facts.select("matter_id").union(issues.select("matter_id")).union(citations.select("matter_id")).distinct()
    good = resolved.filter("verified")

    def fixed_lines(part: int, *lines: str) -> DataFrame:
        rows = F.posexplode(F.array(*[F.lit(x) for x in lines])).alias("sub", "line")
        return matters.select("matter_id", F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("pos"), rows)

    def bullets(df: DataFrame, part: int, line: Column, empty: str, sub: int = 0) -> DataFrame:
        rows = df.select(
            "matter_id", F.lit(part).alias("part"), F.col("pos").cast("bigint").alias("pos"), F.lit(sub).alias("sub"), line.alias("line")
        )
        without = matters.join(df.select("matter_id"), "matter_id", "left_anti").select(
            "matter_id", F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("pos"), F.lit(0).alias("sub"), F.lit(empty).alias("line")
        )
        return rows.unionByName(without) if sub == 0 else rows

    cited = F.concat(F.lit("  • "), "cite", F.lit(" — "), F.coalesce("title", F.lit("None")), F.lit(" ["), "canonical_ref", F.lit("]"))
    no_authority = "  • No verified authority could be cited for this matter."
    parts = [
        fixed_lines(0, header, "=" * len(header), "", "FACTS (accepted matter facts):"),
        bullets(facts, 1, F.concat(F.lit("  • "), "text"), "  (none)"),
        fixed_lines(2, "", "ISSUES:"),
        bullets(issues, 3, F.concat(F.lit("  • "), "text"), "  (none)"),
        fixed_lines(4, "", "SUPPORTING AUTHORITIES (verified against corpus):"),
        bullets(good, 5, cited, no_authority),
        bullets(good, 5, F.concat(F.lit("      "), "text"), "", sub=1),
        resolved.filter("NOT verified").select(
            "matter_id", F.lit(9).alias("part"), F.col("pos").cast("bigint").alias("pos"), F.lit(0).alias("sub"),
            F.concat(F.lit("rejected: "), "cite").alias("line"),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("lawyer_review_required", F.lit(True))


def attach_evidence(
    results: DataFrame, aliases: DataFrame, paragraphs: DataFrame, versions: DataFrame, wording: DataFrame | Callable[[DataFrame], DataFrame],
    now: Column | None = None, disjoint: bool = False,
) -> DataFrame:
    """Evidence rows of results (query_id, canonical_ref, query_date): all paragraphs of a judgment, or the article's
    wording at the version in force on the query date (today without one).

    Paragraphs hold canonical_id, section_type, para_number, text; aliases alias, canonical_id. `wording` may be a function that
    makes the wording of the versions (version_id) it is given: those in force on a query date, and no others, are made then.
    """
    now = F.current_date() if now is None else now
    none = F.lit(None).cast("string")
    cases = results.select("query_id", "canonical_ref", T.judgment_key("canonical_ref").alias("alias")).filter("alias IS NOT NULL")
    # One judgment per reference: an alias shared by several judgments means the first id.
    ids = aliases.groupBy("alias").agg(F.min("canonical_id").alias("canonical_id"))
    from_cases = cases.join(ids, "alias").join(paragraphs, "canonical_id").select(
        "query_id", "canonical_ref", F.lit("judgment_paragraph").alias("type"), "section_type",
        F.col("para_number").cast("bigint").alias("pos"), none.alias("article"), "text",
    )
    laws = results.select(
        "query_id", "canonical_ref", T.ref_law("canonical_ref").alias("law"), T.ref_article("canonical_ref").alias("article"),
        F.coalesce("query_date", now).alias("as_of"),
    ).filter("law IS NOT NULL")
    # Law and number name a version in fewer bytes than its id does.
    made = callable(wording)
    name = ["law", "version_number"] if not made and {"law", "version_number"} <= set(wording.columns) else ["version_id"]
    versions = versions if "version_id" in name else versions.drop("version_id")
    found = resolve_as_of(laws, versions, disjoint=disjoint)
    if made:
        found = stored(found)
        wording = wording(found.select(*name).filter("version_id IS NOT NULL").distinct())
    articles = wording.filter("node_type = 'ARTICLE'").select(*name, F.col("number").alias("article"), "source_text")
    from_laws = found.join(articles, [*name, "article"]).select(
        "query_id", "canonical_ref", F.lit("provision").alias("type"), none.alias("section_type"),
        F.lit(0).cast("bigint").alias("pos"), "article", F.col("source_text").alias("text"),
    )
    return from_cases.unionByName(from_laws)


def authority_detail(
    results: DataFrame, aliases: DataFrame, judgments: DataFrame, laws: DataFrame, citations: DataFrame, treatments: DataFrame,
    links: DataFrame,
) -> DataFrame:
    """Type, name, jurisdiction, court, numbers and graph degree of each result's authority.

    Judgments hold canonical_id, title, jurisdiction, court, case_number, ecli; laws hold law, title, jurisdiction. Edge
    tables are counted per key before the join; `expand_cases` lists the edges themselves.
    """
    ids = aliases.groupBy("alias").agg(F.min("canonical_id").alias("canonical_id"))
    refs = results.select("canonical_ref").distinct()
    keyed = refs.select("canonical_ref", T.judgment_key("canonical_ref").alias("alias"), T.ref_law("canonical_ref").alias("law"))

    def degree(edges: DataFrame, on: str, name: str) -> DataFrame:
        counted = edges.groupBy(F.col(on).alias("alias")).agg(F.count(F.lit(1)).alias("_n"))
        return counted.join(aliases, "alias").groupBy("canonical_id").agg(F.sum("_n").alias(name))

    cases = keyed.filter("alias IS NOT NULL").join(ids, "alias", "left").join(
        judgments.select("canonical_id", "title", "jurisdiction", "court", "case_number", "ecli"), "canonical_id", "left"
    )
    for edges, on, name in (
        (citations, "source_key", "cited"), (citations, "target_key", "citing"),
        (treatments, "source_key", "treatments"), (links, "judgment_key", "legislation_links"),
    ):
        cases = cases.join(degree(edges, on, name), "canonical_id", "left").fillna(0, [name])
    cases = cases.select(
        "canonical_ref", F.lit("judgment").alias("authority_type"), F.col("title").alias("name"), "jurisdiction", "court",
        "case_number", "ecli", "cited", "citing", "treatments", "legislation_links",
    )
    statutes = keyed.filter("law IS NOT NULL").join(laws.select("law", "title", "jurisdiction"), "law", "left").select(
        "canonical_ref", F.lit("legislation").alias("authority_type"), F.coalesce("title", "law").alias("name"), "jurisdiction"
    )
    other = keyed.filter("law IS NULL AND alias IS NULL").select("canonical_ref", F.lit("other").alias("authority_type"))
    return cases.unionByName(statutes, allowMissingColumns=True).unionByName(other, allowMissingColumns=True).fillna(
        0, ["cited", "citing", "treatments", "legislation_links"]
    )


def grounded_answer(
    queries: DataFrame, results: DataFrame, evidence: DataFrame, treatments: DataFrame | None = None,
    matter: DataFrame | None = None, propositions: int = 12,
) -> DataFrame:
    """Answers made only of evidence, as rows (query_id, part, pos, canonical_ref, text, provenance).

    A result qualifies when its evidence holds two or more distinct query words. Parts: `answer` is the evidence of
    the best qualifying result, `proposition` up to twelve distinct texts in result order, `adverse` the contrary
    material, `message` the refusal when nothing qualifies. Results hold query_id, canonical_ref, rank and, for adverse
    material, matter_id and case_key.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(r"([a-zͰ-Ͽ]{3,})"), F.lit(1)))
    asked = queries.select("query_id", words.alias("_words"))
    # Read for the gate, the answer and the propositions; a few rows or judgments per query.
    ranked = durable(evidence.join(results.select("query_id", "canonical_ref", "rank"), ["query_id", "canonical_ref"]))
    lowered = F.lower(F.coalesce("text", F.lit("")))
    met = ranked.join(asked, "query_id").select(
        "query_id", "canonical_ref", "rank", F.explode_outer(F.filter("_words", lambda w: F.contains(lowered, w))).alias("_w")
    )
    qualifying = met.filter("_w IS NOT NULL").groupBy("query_id", "canonical_ref", "rank").agg(
        F.countDistinct("_w").alias("_n")
    ).filter("_n >= 2").drop("_n")
    qualifying = durable(qualifying)
    best = qualifying.groupBy("query_id").agg(F.min("rank").alias("rank"))
    text = T.strip(F.coalesce("text", F.lit("")))
    usable = ranked.withColumn("text", text)
    answer = usable.join(best, ["query_id", "rank"]).filter("text <> ''").select(
        "query_id", F.lit("answer").alias("part"), "pos", "canonical_ref", "text", F.lit("SOURCE FACT").alias("provenance")
    )
    no_text = best.join(answer.select("query_id"), "query_id", "left_anti").select(
        "query_id", F.lit("answer").alias("part"), F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("canonical_ref"),
        F.lit(fixed.NO_VERBATIM).alias("text"), F.lit("MODEL_INFERENCE").alias("provenance"),
    )
    cited = usable.join(qualifying.select("query_id", "canonical_ref"), ["query_id", "canonical_ref"], "left_semi").filter("text <> ''")
    once = cited.groupBy("query_id", "text").agg(F.min(F.struct("rank", "pos", "canonical_ref")).alias("_at"))
    listed = top_per_key(
        once.select("query_id", "text", "_at.*"), ["query_id"], ["rank", "pos", "canonical_ref"], propositions, "_rn"
    ).select(
        "query_id", F.lit("proposition").alias("part"), F.col("_rn").cast("bigint").alias("pos"), "canonical_ref", "text",
        F.lit("SOURCE FACT").alias("provenance"),
    )
    refused = queries.select("query_id").join(best, "query_id", "left_anti").select(
        "query_id", F.lit("message").alias("part"), F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("canonical_ref"),
        F.lit(fixed.NOT_ANSWERED).alias("text"), F.lit("MODEL_INFERENCE").alias("provenance"),
    )
    out = answer.unionByName(no_text).unionByName(listed).unionByName(refused)
    if treatments is None or matter is None:
        return out
    # Contrary material of qualifying results; of all results when nothing qualifies.
    kept = results.join(qualifying.select("query_id", "canonical_ref"), ["query_id", "canonical_ref"], "left_semi")
    rest = results.join(best.select("query_id"), "query_id", "left_anti")
    adverse = adverse_authorities(kept.unionByName(rest), treatments, matter)
    return out.unionByName(adverse.select(
        "query_id", F.lit("adverse").alias("part"), F.lit(0).cast("bigint").alias("pos"), "canonical_ref",
        F.coalesce("treatment", "basis").alias("text"), "provenance",
    ))


def grounded_research(
    queries: DataFrame, entries: DataFrame, facts: DataFrame, k: int = 10, index: DataFrame | None = None
) -> DataFrame:
    """Per query: supported, the answer quoting the top hit, the check of its citation, and numbers of authorities and
    accepted facts. `facts` holds query_id, status."""
    hits = search(queries, entries, k, index=index)
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("authorities"))
    detail = entries.select("canonical_ref", "kind", "title", F.substring(F.coalesce("body", F.lit("")), 1, 400).alias("_quote"))
    top = hits.filter("rank = 1").select("query_id", "canonical_ref", "kind").join(detail, ["canonical_ref", "kind"])
    accepted = facts.filter("status = 'accepted'").groupBy("query_id").agg(F.count(F.lit(1)).alias("accepted_facts"))
    checked = validate_citations(queries, entries, "query")
    out = checked.join(counts, "query_id", "left").join(top, "query_id", "left").join(accepted, "query_id", "left")
    answer = F.concat(
        F.lit("Based on the retrieved authority '"), F.coalesce("title", F.lit("None")), F.lit("' ("), "canonical_ref",
        F.lit("), the supporting text states: "), "_quote",
    )
    supported = F.col("canonical_ref").isNotNull()
    return out.select(
        "query_id", supported.alias("supported"), F.when(supported, answer).otherwise(fixed.UNSUPPORTED).alias("answer"),
        "parsed", F.col("exists").alias("citation_exists"), F.coalesce("authorities", F.lit(0)).alias("authorities"),
        F.coalesce("accepted_facts", F.lit(0)).alias("accepted_facts"),
    )
