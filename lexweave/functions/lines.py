"""Shortest line differences, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

CHANGE = "array<struct<sign:string,line_no:int,line:string>>"


def _middle(a: Sequence[int], b: Sequence[int]) -> tuple[int, int, int, int]:
    """A run of equal lines (from x, y to u, v) in the middle of a shortest edit path, found from both ends at once.

    Paths of the same number of edits are kept by their diagonal, as the furthest place they reach.
    """
    n, m = len(a), len(b)
    delta, most = n - m, (n + m + 1) // 2
    fore, back = {1: 0}, {1: 0}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            x = fore[k + 1] if k == -d or (k != d and fore[k - 1] < fore[k + 1]) else fore[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            fore[k] = x
            if delta % 2 and abs(delta - k) <= d - 1 and x + back.get(delta - k, -n - m) >= n:
                return x0, y0, x, y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[k] = x
            if not delta % 2 and abs(delta - k) <= d and x + fore.get(delta - k, -n - m) >= n:
                return n - x, m - y, n - x0, m - y0
    raise AssertionError("two texts always have an edit path")


def changed_lines(old: Sequence, new: Sequence) -> tuple[list[int], list[int]]:
    """Ascending numbers of the lines of `old` that go and of the lines of `new` that come, as few as possible.

    Memory grows with the lines, time with the lines times the changes.
    """
    names: dict = {}
    a, b = ([names.setdefault(x, len(names)) for x in side] for side in (old, new))
    gone, come = [], []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, k, m = work.pop()
        while i < j and k < m and a[i] == b[k]:
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
        if i == j or k == m:
            gone += range(i, j)
            come += range(k, m)
            continue
        x, y, u, v = _middle(a[i:j], b[k:m])
        work += [(i + u, j, k + v, m), (i, i + x, k, k + y)]
    return sorted(gone), sorted(come)


def hunks(old: Sequence[str], new: Sequence[str]) -> list[dict]:
    """The changed lines in order: where both sides change, the old lines come first."""
    gone, come = changed_lines(old, new)
    out, i, k, shift, g, c = [], 0, 0, 0, 0, 0
    while g < len(gone) or c < len(come):
        # A line of `new` stands before the next line of `old` that is kept after it.
        if g < len(gone) and (c == len(come) or gone[g] <= come[c] - shift):
            out.append({"sign": "-", "line_no": gone[g], "line": old[gone[g]]})
            g, shift = g + 1, shift - 1
        else:
            out.append({"sign": "+", "line_no": come[c], "line": new[come[c]]})
            c, shift = c + 1, shift + 1
    return out


def with_changes(df: DataFrame, old: str, new: str) -> DataFrame:
    """Adds `removed_lines`, `added_lines` and `changes` (all changed lines in order) for two array columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (old, new)]
            made = [hunks(a, b) for a, b in zip(*sides, strict=True)]
            lists = [[[c["line"] for c in m if c["sign"] == sign] for m in made] for sign in "-+"]
            kind = pa.list_(pa.struct([("sign", pa.string()), ("line_no", pa.int32()), ("line", pa.string())]))
            arrays = [pa.array(x, pa.list_(pa.string())) for x in lists] + [pa.array(made, kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "removed_lines", "added_lines", "changes"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, removed_lines array<string>, added_lines array<string>, changes {CHANGE}")
