"""Spans of patterns and keywords, found in one pass over Arrow batches of texts.

Keywords of all kinds are found together by one Aho-Corasick automaton over the lower-case
text. A pattern that begins with a keyword is only tried where the automaton
has found one; other patterns are compiled once and run over the texts that hold what they
cannot do without. Offsets are code points, 0-based, end-exclusive, as Spark counts them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import fixed

#: Characters of Unicode white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_INSENSITIVE = regex.IGNORECASE | regex.UNICODE
#: What a mention of a kind begins with, lower-case; the other kinds need a slash before four digits.
STARTERS = {"article": ["άρθρο", "article", "αρ."], "chapter": ["κεφ.", "κεφάλαιο", "chapter"], "judgment_ecli": ["ecli:"]}
MENTION = ("kind", "start", "end", "text", "article", "sub", "para", "chapter", "law", "roman", "year", "ecli", "case_number")
MENTION_TYPE = "kind string, start int, end int, text string, " + ", ".join(f"{c} string" for c in MENTION[4:])


@cache
def pattern(text: str, flags: int = _INSENSITIVE) -> regex.Pattern:
    return regex.compile(text, flags)


class Keywords:
    """All words that begin a hit, by group."""

    def __init__(self, groups: dict[str, list[str]]):
        self.machine = ahocorasick.Automaton()
        for group, words in groups.items():
            for w in words:
                self.machine.add_word(w, (w, group))
        self.machine.make_automaton()
        self.groups = groups

    def starts(self, lowered: str) -> dict[str, list[int]]:
        """Where words of each group begin, ascending; words may overlap others."""
        found: dict[str, list[int]] = {}
        for end, (word, group) in self.machine.iter(lowered):
            found.setdefault(group, []).append(end + 1 - len(word))
        return {g: sorted(at) for g, at in found.items()}

    def each(self, lowered: str) -> list[tuple[str, int]]:
        """Every word with its place; repeats of one word do not overlap."""
        after: dict[str, int] = {}
        out = []
        for end, (word, _) in self.machine.iter(lowered):
            at = end + 1 - len(word)
            if at >= after.get(word, 0):
                out.append((word, at))
                after[word] = end + 1
        return out


@cache
def _starters() -> Keywords:
    return Keywords(STARTERS)


@cache
def _words(words: tuple[str, ...]) -> Keywords:
    return Keywords({w: [w] for w in words})


def _tried(p: regex.Pattern, text: str, places: list[int]) -> Iterator[regex.Match]:
    """Matches of `p` that begin at one of the ascending `places`, leftmost first, without overlap."""
    after = 0
    for at in places:
        if at >= after and (m := p.match(text, at)):
            yield m
            after = m.end()


def mentions(text: str) -> list[tuple]:
    """All references of five kinds, as `MENTION` names their parts."""
    lowered = text.lower()
    even = len(lowered) == len(text)
    starts = _starters().starts(lowered) if even else {}

    def found(kind: str, p: str) -> Iterable[regex.Match]:
        return _tried(pattern(p), text, starts.get(kind, [])) if even else pattern(p).finditer(text)

    # The groups of a match fill the columns of its kind, in order.
    out = [
        ("article", *m.span(), m[0], m[1], m[2] or None, m[3] or None, None, None, None, None, None, None)
        for m in found("article", fixed.MENTION_ARTICLE)
    ]
    out += [
        ("chapter", *m.span(), m[0], None, None, None, m[1], None, None, None, None, None)
        for m in found("chapter", fixed.MENTION_CHAPTER)
    ]
    out += [
        ("judgment_ecli", *m.span(), m[0], None, None, None, None, None, None, None, m[0], None)
        for m in found("judgment_ecli", fixed.ECLI)
    ]
    if "/" in text and pattern(r"/\s*[0-9]{4}").search(text):
        out += [
            ("law", *m.span(), m[0], None, None, None, None, m[1], m[2] or None, m[3], None, None)
            for m in pattern(fixed.MENTION_LAW).finditer(text)
        ]
        out += [
            ("judgment_case", *m.span(), m[0], None, None, None, None, None, None, None, None, f"{m[1]}/{m[2]}")
            for m in pattern(fixed.MENTION_CASE).finditer(text)
        ]
    return out


FACT_TYPE = "kind string, text string, char_start int, char_end int, confidence double"
_LOWER_LETTER = r"\p{Ll}"


def facts(text: str) -> list[tuple]:
    """Money amounts (0.9), obligation phrases with 40 characters around (0.6), capitalised names (0.7), each name once."""
    out: list[tuple] = []
    if any(c in text for c in "€£$"):
        out += [("amount", m.group(), m.start(), m.end(), 0.9) for m in pattern(fixed.AMOUNT, regex.ASCII).finditer(text)]
    for _, at in _words(tuple(fixed.OBLIGATIONS)).each(text.lower()):
        start, end = max(0, at - 40), at + 40
        out.append(("obligation", text[start:end].strip(SPACE), start, end, 0.6))
    seen = set()
    for m in pattern(fixed.CAPITALISED_NAME, regex.UNICODE).finditer(text):
        name = m.group().strip(SPACE)
        key = name.lower()
        if key in seen or name in fixed.NAME_STOP or not pattern(_LOWER_LETTER, 0).search(name, 1):
            continue
        if len(pattern(r"[^ \t\n\x0b\f\r]+", 0).findall(name)) <= 3:
            seen.add(key)
            out.append(("party", name, m.start(), m.end(), 0.7))
    return out


EVENT_TYPE = "year string, month string, day string, description string, char_start int, char_end int, confidence double"


def events(text: str) -> list[tuple]:
    """Dates with the text up to the next stop (0.9), and event verbs with no date in the 30 characters before (0.5)."""
    out: list[tuple] = []
    slash = pattern(fixed.SLASH_DATE, regex.UNICODE)
    if "/" in text:
        for m in slash.finditer(text):
            window = text[m.start() : m.end() + 40].strip(SPACE)
            snippet = pattern("[.;]", 0).split(window, 1)[0]
            out.append((m[3], m[2], m[1], snippet[:160], m.start(), m.end(), 0.9))
    for _, at in _words(tuple(fixed.EVENT_VERBS)).each(text.lower()):
        if slash.search(text[max(0, at - 30) : at]):
            continue
        # Within the first 40 characters the window starts that far from the end of the text.
        start = at - 40 if at >= 40 else max(0, len(text) + at - 40)
        out.append((None, None, None, text[start : at + 40].strip(SPACE)[:160], max(0, at - 40), at + 40, 0.5))
    return out


def scanned(df: DataFrame, text: str, find: Callable[[str], list[tuple]], kind: str) -> DataFrame:
    """The columns of `df` but `text`, once for every tuple that `find` gives for the text, whose fields `kind` declares."""
    kept = [f for f in df.schema.fields if f.name != text]
    fields = [c.strip().split(" ")[0] for c in kind.split(",")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made = [], []
            for i, value in enumerate(batch.column(len(kept)).to_pylist()):
                if value:
                    here = find(value)
                    rows += [i] * len(here)
                    made += here
            at = pa.array(rows, pa.int64())
            types = _types(kind)
            columns = list(zip(*made, strict=True)) if made else [()] * len(fields)
            arrays = [batch.column(i).take(at) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                arrays + [pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.name for f in kept] + fields
            )

    return df.select(*[f"`{f.name}`" for f in kept], text).mapInArrow(run, schema)


def _types(kind: str) -> list[pa.DataType]:
    known = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    return [known[c.strip().split(" ")[1]] for c in kind.split(",")]
