"""Near-duplicate groups by SimHash over a Gray-order hierarchical index.

Two fingerprints that differ in at most three bits agree in one of four blocks
of bits, so the distinct fingerprints are dealt into four tables, each cut by
one block. Inside a table Spark sorts them by Gray rank, which brings those with
many common bits together. A group of one block value is a tree: a node keeps
the bits its fingerprints share and that no upper node has shared yet; a search
adds up the differences on the way down and leaves a whole node once they exceed
three. A group above `GROUP_ROWS` is cut by four blocks of its remaining bits in
the same way, so hot block values are split without losing a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable
from . import text as tx
from .components import connected_components

BITS, MOST = 64, 3
#: A larger group of one block value is cut by further blocks.
GROUP_ROWS = 4096
LEAF, FAN, QUERIES = 16, 8, 256
_SEED = 42


def simhash(raw: bytes, shingle_words: int = 3) -> int:
    """The fingerprint of one text: bits set in over half the shingles' XXH64; 0 without words."""
    words = raw.lower().split()
    if not words:
        return 0
    counts, total = np.zeros(BITS, np.int64), max(1, len(words) - shingle_words + 1)
    for at in range(0, total, 1 << 16):
        some = range(at, min(total, at + (1 << 16)))
        names = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle_words]), _SEED) for i in some]
        bits = np.unpackbits(np.array(names, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(counts * 2 > total))


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, `text_hash` and `fp` (the fingerprint as a signed long) of every row; a null text is empty."""
    rows = docs.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_hash"),
        F.col(text_col).cast("string").alias("t"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.column(batch, "t")
            raw = data.tobytes()
            fp = [simhash(raw[offsets[i] : offsets[i + 1]]) for i in range(batch.num_rows)]
            kept = [batch.column(i) for i in range(len(keep) + 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.array(fp, np.uint64).view(np.int64))], [*batch.schema.names[: len(keep) + 1], "fp"]
            )

    schema = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    named = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    return rows.mapInArrow(run, f"{schema}, text_hash bigint, fp bigint").select(*named, "text_hash", "fp")


def as_hex(fp: Column | str) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _gray_rank(x: Column) -> Column:
    """Place of a bit pattern in Gray order, as an unsigned long held in a signed one."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cut(fixed: int) -> list[int]:
    """Four masks, each `fixed` and a quarter of the other bits."""
    free = [i for i in range(BITS) if not fixed >> i & 1]
    return [fixed | sum(1 << int(i) for i in part) for part in np.array_split(free, MOST + 1)]


def _tree(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shared patterns and masks from the leaves upwards."""
    ors, ands, levels = prints, prints, []
    step = LEAF
    while True:
        at = np.arange(0, len(ors), step)
        ors, ands = np.bitwise_or.reduceat(ors, at), np.bitwise_and.reduceat(ands, at)
        mask = ~(ors ^ ands)
        levels.append((ands & mask, mask))
        if len(ors) <= FAN:
            return levels
        step = FAN


def _children(node: np.ndarray, fan: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For every node its children below `count`: position of the node, child."""
    child = (node[:, None] * fan + np.arange(fan)).ravel()
    at = np.repeat(np.arange(len(node)), fan)
    real = child < count
    return at[real], child[real]


def spanning_links(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is within three bits of each other among Gray-sorted distinct fingerprints.

    A star per connected set: its first member and each other one.
    """
    n = len(prints)
    levels = _tree(prints)
    spans = [LEAF * FAN**k for k in range(len(levels))]
    root = np.arange(n)
    for begin in range(0, n, QUERIES):
        mine = np.arange(begin, min(n, begin + QUERIES))
        node = np.tile(np.arange(len(levels[-1][0])), len(mine))
        query = np.repeat(mine, len(levels[-1][0]))
        found = np.zeros(len(query), np.int64)
        above = np.zeros(len(query), np.uint64)
        for k in range(len(levels) - 1, -1, -1):
            pattern, mask = levels[k]
            found = found + np.bitwise_count((prints[query] ^ pattern[node]) & mask[node] & ~above)
            near = (found <= MOST) & ((node + 1) * spans[k] > query)
            query, node, found, above = query[near], node[near], found[near], mask[node[near]]
            at, child = _children(node, FAN if k else LEAF, len(levels[k - 1][0]) if k else n)
            query, node, found, above = query[at], child, found[at], above[at]
        found = found + np.bitwise_count((prints[query] ^ prints[node]) & ~above)
        near = (found <= MOST) & (node > query)
        a, b = root[query[near]], root[node[near]]
        apart = a != b
        if apart.any():
            for x, y in np.unique(np.stack([a[apart], b[apart]], 1), axis=0):
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
            while (root[root] != root).any():
                root = root[root]
    member = np.flatnonzero(root != np.arange(n))
    return root[member], member


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each (table, key) of rows sorted by table, key and Gray rank."""
    rest = np.empty((0, 3), np.int64)

    def done(rows: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        found = []
        for i, j in zip(starts, [*starts[1:], len(rows)], strict=True):
            if j - i > 1:
                prints = rows[i:j, 2].view(np.uint64)
                a, b = spanning_links(prints)
                found.append(np.stack([prints[a], prints[b]], 1).view(np.int64))
        pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    for batch in batches:
        new = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
        rows = np.ascontiguousarray(np.concatenate([rest, new]))
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]) if len(rows) else []
        if len(starts) > 1:
            yield done(np.ascontiguousarray(rows[: starts[-1]]), starts[:-1])
            rest = rows[starts[-1] :]
        else:
            rest = rows
    if len(rest):
        yield done(np.ascontiguousarray(rest), np.array([0]))


def near_links(prints: DataFrame, fp: str = "fp", group_rows: int = GROUP_ROWS) -> DataFrame:
    """`a`, `b`: links that connect exactly what links of at most three differing bits connect.

    `prints` holds distinct fingerprints; runs the counts that find groups above `group_rows`.
    """
    spark = prints.sparkSession
    tables, nxt = {0: 0}, 1
    rows = prints.select(F.col(fp).alias("fp"), F.lit(0).alias("table"))
    found = None
    while True:
        cuts, below = [], {}
        for table, fixed in tables.items():
            for mask in _cut(fixed):
                cuts.append((table, nxt, _signed(mask)))
                below[nxt] = mask
                nxt += 1
        cut = F.broadcast(spark.createDataFrame(cuts, "parent int, child int, mask bigint"))
        rows = rows.join(cut, rows.table == cut.parent).select(
            "fp", F.col("child").alias("table"), F.col("fp").bitwiseAND(F.col("mask")).alias("key")
        )
        sizes = durable(rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1"))
        last = max(bin(m).count("1") for m in below.values()) > 40
        hot = sizes.where(F.col("n") > group_rows)
        deeper = not last and not hot.isEmpty()
        direct = sizes if not deeper else sizes.where(F.col("n") <= group_rows)
        part = (
            rows.join(direct.drop("n"), ["table", "key"])
            .select("table", "key", "fp")
            .repartition("table", "key")
            .withColumn("gray", _gray_rank(F.col("fp")).bitwiseXOR(F.lit(-(2**63))))
            .sortWithinPartitions("table", "key", "gray")
            .select("table", "key", "fp")
            .mapInArrow(_search, "a bigint, b bigint")
        )
        found = part if found is None else found.union(part)
        if not deeper:
            return found
        rows = durable(rows.join(hot.drop("n"), ["table", "key"]).select("fp", "table"))
        tables = below


def near_groups(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`fp`, `root`, `component_id` for every fingerprint in `prints`: the smallest fingerprint and id reachable.

    Equal fingerprints, zero among them, are one node. Null ids never become a component's id unless it has no other.
    """
    distinct = durable(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    parts = connected_components(near_links(distinct))
    rooted = distinct.join(parts, distinct.fp == parts.node, "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `fingerprint` and `component_id` of every row. An empty table gives an empty one."""
    prints = durable(fingerprints(docs, text_col, (id_col,)))
    grouped = near_groups(prints, id_col)
    return prints.join(grouped, "fp").select(F.col(id_col), as_hex("fp").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group: the smallest id, then the smallest text hash; of repeated rows one. Null ids come last."""
    prints = durable(fingerprints(docs, text_col, (id_col,)))
    grouped = near_groups(prints, id_col)
    member = prints.join(grouped, "fp")
    best = member.groupBy("root").agg(
        F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("text_hash").alias("h"))).alias("b")
    )
    best = best.select(F.col("b.i").alias("_near_id"), F.col("b.h").alias("_near_hash")).distinct()
    hashed = docs.withColumn("_near_text", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    kept = hashed.join(
        best, hashed["_near_text"].eqNullSafe(best["_near_hash"]) & hashed[id_col].eqNullSafe(best["_near_id"]), "left_semi"
    )
    return kept.dropDuplicates([id_col, "_near_text"]).drop("_near_text")
