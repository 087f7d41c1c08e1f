"""URL rules as one bit-parallel wildcard automaton.

All patterns are packed behind one another into words of 64 bits: a start bit
for each pattern, then a bit for each of its characters. Reading a character
moves every active bit one place and keeps those whose pattern expects it
(Shift-And); a bit in front of a `*` stays as well. One step advances all
patterns over a whole batch of URLs.

A canonical URL is a dot, the host, the byte FF, which no text holds, and the
path. `*` is any run of characters, `?` any one character.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text as tx

#: Fixed rules: a host with its subdomains, the beginning of a path, a verdict.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Globs over host/path that block where no rule fits.
BLOCKED = ("ads.*", "*.ads.*", "*/ads/*", "*/login*", "*/wp-admin/*", "*.exe", "*.zip", "m.*/*.html", "blog.*/*/99*")
_END = 255
#: Bytes of the padded URLs worked on at once.
RUN_BYTES = 1 << 22


def rule_pattern(rule: str) -> bytes:
    host, slash, path = rule.partition("/")
    return b"*." + host.encode() + bytes([_END]) + (slash + path).encode() + b"*"


def glob_pattern(glob: str) -> bytes:
    """A glob over host/path; without a slash it is over the host, or over the path where it names a file ending."""
    host, slash, path = glob.partition("/")
    if slash:
        return b"." + host.encode() + bytes([_END, 47]) + path.encode()
    if host.startswith("*.") and "*" not in host[1:] and "?" not in host:
        return b"*" + bytes([_END]) + b"*" + host[1:].encode()
    return b"." + host.encode() + bytes([_END]) + b"*"


class Automaton:
    """Masks of all patterns: which bits expect a character, which may wait, where patterns start and end."""

    def __init__(self, patterns: Sequence[bytes]):
        bits = sum(1 + len(p.replace(b"*", b"")) for p in patterns)
        self.words = max(1, -(-bits // 64))
        self.expect = np.zeros((256, self.words), np.uint64)
        self.wait, self.start = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for pattern in patterns:
            self.start[at // 64] |= np.uint64(1 << at % 64)
            for c in pattern:
                if c == ord("*"):
                    self.wait[at // 64] |= np.uint64(1 << at % 64)
                    continue
                at += 1
                chars = slice(None) if c == ord("?") else c
                self.expect[chars, at // 64] |= np.uint64(1 << at % 64)
            self.final.append((at // 64, np.uint64(1 << at % 64)))
            at += 1

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which pattern matches which text."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.final)), bool)
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        i = 0
        while i < n:
            longest = max(1, int(sizes[order[i]]))
            rows = order[i : i + max(1, RUN_BYTES // longest)]
            out[rows] = self._run(data, offsets[rows], sizes[rows])
            i += len(rows)
        return out

    def _run(self, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Texts by falling size, so those still being read come first."""
        state = np.tile(self.start, (len(sizes), 1))
        one, high = np.uint64(1), np.uint64(63)
        alive = len(sizes)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            while sizes[alive - 1] <= t:
                alive -= 1
            now = state[:alive]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> high
            state[:alive] = (moved & self.expect[data[begin[:alive] + t]]) | (now & self.wait)
        if not self.final:
            return np.zeros((len(sizes), 0), bool)
        return np.stack([(state[:, w] & bit) != 0 for w, bit in self.final], 1)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without `://` or for a null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, blocked: Sequence[str] = BLOCKED, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """`id_col`, `host`, `path`, `rule`, `verdict` of every row.

    The longest rule that fits decides (of equally long ones the first); else a matching glob blocks and anything else,
    an empty URL too, is allowed. Repeated rows are judged each.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    by_length = sorted(rules, key=lambda r: -len(r[0]))
    patterns = [rule_pattern(r) for r, _ in by_length] + [glob_pattern(g) for g in blocked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(patterns)
        for batch in batches:
            (hosts, h), (paths, p) = tx.column(batch, "host"), tx.column(batch, "path")
            size = 2 + np.diff(h) + np.diff(p)
            offsets = np.r_[0, np.cumsum(size)]
            data = np.full(offsets[-1], ord("."), np.uint8)
            data[offsets[:-1] + 1 + np.diff(h)] = _END
            for part, o, shift in ((hosts, h, offsets[:-1] + 1), (paths, p, offsets[:-1] + 2 + np.diff(h))):
                data[np.arange(len(part)) + np.repeat(shift - o[:-1], np.diff(o))] = part
            hit = automaton.match(data, offsets)
            ruled, globbed = hit[:, : len(by_length)], hit[:, len(by_length) :].any(axis=1)
            first = ruled.argmax(axis=1) if by_length else np.zeros(len(hit), int)
            any_rule = ruled.any(axis=1)
            rule = [by_length[k][0] if r else None for k, r in zip(first, any_rule, strict=True)]
            verdict = [by_length[k][1] if r else ("block" if b else "allow") for k, r, b in zip(first, any_rule, globbed, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*batch.schema.names, "rule", "verdict"]
            )

    kind = pages.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")
