"""Date parsing over columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed
from .text import blank_to_null


def parse_date(c: Column | str) -> Column:
    """First of d/m/Y, Y-m-d, Y/m/d that parses, else null."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in ("d/M/yyyy", "yyyy-M-d", "yyyy/M/d")])


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """A date from text parts, null when there is no such day."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def detect_query_date(c: Column | str) -> Column:
    """Date named in a query: d/m/Y, else `d Month 20yy`, else 1 June of a bare 20yy."""
    text = F.col(c) if isinstance(c, str) else c

    def part(pattern, group):
        return blank_to_null(F.regexp_extract(text, fixed.FLAGS + pattern, group))

    numeric = safe_date(part(fixed.QUERY_DATE, 3), part(fixed.QUERY_DATE, 2), part(fixed.QUERY_DATE, 1))
    month_names = F.create_map(
        *[F.lit(x) for pair in zip(
            ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
             "november", "december"],
            [str(i) for i in range(1, 13)],
        ) for x in pair]
    )
    named = safe_date(
        part(fixed.QUERY_MONTH_DATE, 3),
        F.element_at(month_names, F.lower(part(fixed.QUERY_MONTH_DATE, 2))),
        part(fixed.QUERY_MONTH_DATE, 1),
    )
    year = part(fixed.QUERY_YEAR, 1)
    return F.coalesce(numeric, named, F.when(year.isNotNull(), F.make_date(year.cast("int"), F.lit(6), F.lit(1))))
