"""Column functions over text: folding, tokens, references."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed

WORD_BREAK = r"[^\p{L}\p{N}_]+"
QUERY_BREAK = r"[^\p{L}\p{N}_\x{0370}-\x{03FF}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Lower-case with accents removed."""
    return F.translate(F.lower(_col(c)), fixed.FOLD_FROM, fixed.FOLD_TO)


def tokens(c: Column | str) -> Column:
    """Lower-case words in order, repeats kept, accents kept."""
    return F.filter(F.split(F.lower(_col(c)), QUERY_BREAK), lambda t: t != "")


def folded_tokens(c: Column | str) -> Column:
    return F.filter(F.split(fold(c), WORD_BREAK), lambda t: t != "")


def letter_tokens(c: Column | str) -> Column:
    """Runs of at least three Latin or Greek letters, lower-case."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"([a-zͰ-Ͽ]{3,})"), F.lit(1))


def word_count(c: Column | str) -> Column:
    """Number of whitespace-separated words."""
    return F.size(F.filter(F.split(_col(c), r"\s+"), lambda t: t != ""))


def strip(c: Column | str) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def lines(c: Column | str) -> Column:
    """Lines at any Unicode line break."""
    return F.split(_col(c), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]")


def slug(c: Column | str) -> Column:
    lowered = F.translate(F.lower(F.trim(_col(c))), "γπύ", "gpy")
    return F.regexp_replace(F.regexp_replace(lowered, "[^0-9a-z]+", "-"), "^-+|-+$", "")


def sha256(c: Column | str) -> Column:
    return F.sha2(_col(c), 256)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(""))


def citation(c: Column | str) -> Column:
    """First reference in the text as struct<kind, article, law, year, case_number, ecli, confidence>.

    Order of preference: article of a law, ECLI, case number, bare law, unknown.
    """
    text = F.coalesce(F.trim(_col(c)), F.lit(""))

    def first(pattern: str, group: int) -> Column:
        return blank_to_null(F.regexp_extract(text, fixed.FLAGS + pattern, group))

    article, article_law = first(fixed.ARTICLE_OF_LAW, 1), first(fixed.ARTICLE_OF_LAW, 2)
    ecli = first(fixed.ECLI, 0)
    case_no, case_year = first(fixed.CASE_NUMBER, 1), first(fixed.CASE_NUMBER, 2)
    law = first(fixed.BARE_LAW, 1)
    none = F.lit(None).cast("string")

    def made(kind, art, law_, year, case, ecli_, confidence):
        return F.struct(
            F.lit(kind).alias("kind"), art.alias("article"), law_.alias("law"), year.alias("year"),
            case.alias("case_number"), ecli_.alias("ecli"), F.lit(confidence).alias("confidence"),
        )

    return (
        F.when(article.isNotNull(), made("legislation_article", article, article_law, none, none, none, 0.97))
        .when(ecli.isNotNull(), made("judgment", none, none, none, none, ecli, 0.99))
        .when(
            case_no.isNotNull(),
            made("judgment", none, case_no, case_year, F.concat_ws("/", case_no, case_year), none, 0.8),
        )
        .when(law.isNotNull(), made("legislation", none, law, none, none, none, 0.9))
        .otherwise(made("unknown", none, none, none, none, none, 0.0))
    )


def reference_key(cite: Column) -> Column:
    """Join key of a parsed citation, tagged with its kind; null when unknown."""
    return (
        F.when(cite["kind"] == "legislation_article", F.concat(F.lit("art|"), cite["law"], F.lit("|"), cite["article"]))
        .when((cite["kind"] == "judgment") & cite["ecli"].isNotNull(), F.concat(F.lit("ecli|"), cite["ecli"]))
        .when(cite["kind"] == "judgment", F.concat(F.lit("case|"), cite["case_number"]))
        .when(cite["kind"] == "legislation", F.concat(F.lit("law|"), cite["law"]))
    )


def ref_law(ref: Column | str) -> Column:
    """Law key of a `law-{key}-art-{n}` reference, else null."""
    r = _col(ref)
    return F.when(r.startswith("law-") & r.contains("-art-"), F.substring_index(F.substr(r, F.lit(5)), "-art-", 1))


def ref_article(ref: Column | str) -> Column:
    r = _col(ref)
    return F.when(r.startswith("law-") & r.contains("-art-"), F.element_at(F.split(r, "-art-"), 2))


def judgment_key(ref: Column | str) -> Column:
    r = _col(ref)
    return F.when(r.startswith("judgment-"), F.substr(r, F.lit(10)))
