"""A bounded bitmap of 64-bit names that tasks ask before they emit a row.

It may say yes to a name that is not in it, for one name in 150 or fewer as long
as its size is not at the bound, and never no to one that is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

LEAST_BITS, MOST_BITS, BITS_PER_NAME = 16, 28, 24
#: A name has two places, from its last bits and from those before. Its first bits would not do: names that were picked
#: for being the smallest around have few of them.
_SHIFTS = (0, 28)


def bitmap(names: DataFrame, count: int, name: str = "name") -> np.ndarray:
    """64-bit words, a power of two in number, with the bits of every name set; gathered word by word."""
    width = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_NAME * max(1, count)).bit_length()))
    places = F.array(*[F.expr(f"shiftrightunsigned({name}, {s}) & {(1 << width) - 1}L") for s in _SHIFTS])
    placed = names.select(F.explode(places).alias("place"))
    bit = F.expr("shiftleft(1L, cast(place & 63 AS int))")
    words = placed.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (width - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, names: np.ndarray) -> np.ndarray:
    out = np.ones(len(names), bool)
    for s in _SHIFTS:
        place = (names >> np.uint64(s)) & np.uint64(len(words) * 64 - 1)
        out &= (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return out
