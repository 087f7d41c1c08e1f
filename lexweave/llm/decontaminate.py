"""Benchmark items inside documents by size-partitioned MinHash containment.

An item is contained in a document that holds at least `threshold` of its
distinct five-word shingles, wherever they stand; an item of fewer words is one
shingle of all its words. Items are partitioned by size;
in a partition of items of up to `u` shingles every item is sketched by its
`floor((1 - threshold) * u) + 1` smallest shingle hashes. A document that
contains the item misses fewer shingles than that, so it holds at least one of
the sketch: the search loses no containment, however long the document. Each
document is asked once, in its own task, which of its shingles are in a sketch;
documents smaller than an item needs are left out by size; what is left is
verified on the words themselves.

The items travel to the documents in blocks of at most `BLOCK_SHINGLES`
shingles; more items cost more passes over the documents, never a lost item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import fresh_folder
from . import text as tx

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Of all items in one block, about: items are dealt to blocks by hash.
BLOCK_SHINGLES = 1_000_000
_FILTER_BITS = 20


def plain_words(raw: bytes) -> list[bytes]:
    """Lower-cased runs of letters and digits."""
    table = bytes(c if tx.ALPHANUMERIC[c] else 32 for c in range(256))
    return raw.translate(table).lower().split()


def shingle_set(words: list[bytes], n: int = SHINGLE_WORDS) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = tx.LOWER[data]
    starts, ends, counts = tx.words(data, offsets, tx.ALPHANUMERIC)
    return tx.Names(data).of(starts, ends), counts


def sketch_size(shingles: int, threshold: float) -> int:
    """How many of the smallest hashes stand for an item, by the largest size of its partition (a power of two)."""
    upper = 1 << max(0, shingles - 1).bit_length()
    return min(shingles, math.floor((1 - threshold) * upper + 1e-9) + 1)


class _Items:
    """A block of items: by shingle width sorted sketch hashes with their items; sizes, and the items' shingles."""

    def __init__(self, raw: list[bytes], threshold: float):
        words = [plain_words(r) for r in raw]
        widths = [min(len(w), SHINGLE_WORDS) for w in words]
        self.sets = [shingle_set(w, n) if n else set() for w, n in zip(words, widths, strict=True)]
        self.need = np.array([math.ceil(threshold * len(s) - 1e-9) for s in self.sets])
        self.tables = {}
        for n in sorted(set(widths) - {0}, reverse=True):
            hashes, owner = [], []
            for k, r in enumerate(raw):
                if widths[k] != n:
                    continue
                found = np.unique(tx.shingles(*_words(np.frombuffer(r, np.uint8), np.array([0, len(r)])), n)[0])
                part = found[: sketch_size(len(self.sets[k]), threshold)]
                hashes.append(part)
                owner.append(np.full(len(part), k))
            hashes, owner = np.concatenate(hashes), np.concatenate(owner)
            order = np.argsort(hashes, kind="stable")
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[hashes & np.uint64((1 << _FILTER_BITS) - 1)] = True
            self.tables[n] = hashes[order], owner[order], maybe

    def candidates(self, n: int, names: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Distinct (row, item) whose row has a sketch hash of the item of width `n` and as many shingles as it needs."""
        hashes, owner, held = self.tables[n]
        maybe = np.flatnonzero(held[names & np.uint64((1 << _FILTER_BITS) - 1)])
        low = np.searchsorted(hashes, names[maybe], "left")
        many = np.searchsorted(hashes, names[maybe], "right") - low
        row = np.searchsorted(np.cumsum(counts), maybe, "right")
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        pairs = np.stack([np.repeat(row, many), owner[at]], 1)
        pairs = pairs[counts[pairs[:, 0]] >= self.need[pairs[:, 1]]]
        return np.unique(pairs, axis=0)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """`doc_id`, `item_id`, `shared`, `item_shingles`, `containment` of every item a document contains.

    Repeated items count once, repeated documents each. Texts without words take no part. A null id stays null. No items or no documents give no rows. Runs one count and one collect of the
    items while the plan is built.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).alias("item"), F.coalesce(text_col, F.lit("")).alias("t")).distinct()
    # A shingle begins with a word, and words are two bytes at least with what separates them.
    weight = items.agg(F.sum(F.octet_length("t") / 2)).first()[0] or 0
    blocks = max(1, math.ceil(weight / block_shingles))
    kind = docs.schema[doc_id].dataType
    item_kind = items.schema["item"].dataType
    out = T.StructType(
        [
            T.StructField("doc", kind), T.StructField("item", item_kind), T.StructField("shared", T.LongType()),
            T.StructField("item_shingles", T.LongType()), T.StructField("containment", T.DoubleType()),
        ]
    )
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text_col).cast("string").alias("t"))
    folder, found = fresh_folder(spark, "contained"), None
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == k) if blocks > 1 else items
        part = some.toArrow()
        if not len(part) and blocks > 1:
            continue
        shared = spark.sparkContext.broadcast(([t.encode() for t in part["t"].to_pylist()], part["item"].to_pylist(), threshold))
        matches = rows.mapInArrow(_searcher(shared, item_kind), out)
        if blocks > 1:
            # One block of items at a time lies on the driver and the executors.
            matches.write.parquet(f"{folder}/{k}")
            shared.unpersist()
            matches = spark.read.schema(out).parquet(f"{folder}/{k}")
        found = matches if found is None else found.unionByName(matches)
    return found.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "shared", "item_shingles", "containment")


def _searcher(shared, item_kind: T.DataType):
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(item_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, ids, threshold = shared.value
        items = _Items(raw, threshold) if raw else None
        for batch in batches:
            hits: list[tuple[int, int, int]] = []
            for i, _, data, offsets in tx.texts(batch, "t") if items is not None else ():
                names, counts = _words(data, offsets)
                for width in items.tables:
                    at, have = -1, set()
                    for row, item in items.candidates(width, *tx.shingles(names, counts, width)):
                        if row != at:
                            at, have = row, shingle_set(plain_words(data[offsets[row] : offsets[row + 1]].tobytes()), width)
                        n = len(items.sets[item] & have)
                        if n >= items.need[item]:
                            hits.append((i + row, item, n))
            rows, which, n = (np.array(x, np.int64) for x in zip(*hits, strict=True)) if hits else [np.empty(0, np.int64)] * 3
            sizes = np.array([len(items.sets[k]) for k in which], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)), pa.array([ids[k] for k in which], item_type),
                    pa.array(n), pa.array(sizes), pa.array(n / np.maximum(sizes, 1)),
                ],
                ["doc", "item", "shared", "item_shingles", "containment"],
            )

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that contain no item; the same columns. Rows are decided by their text alone."""
    # Names of their own for all columns, so that none of the caller's can clash.
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    hashed = F.xxhash64(F.coalesce(F.col(f"c{docs.columns.index(text_col)}").cast("string"), F.lit("")))
    keyed = own.select(hashed.alias("hash"), F.col(f"c{docs.columns.index(text_col)}").alias("t"))
    bad = contained_items(keyed, items.withColumnRenamed(text_col, "t"), threshold, "hash", text_col="t")
    bad = bad.select(F.col("hash").alias("bad")).distinct()
    return own.join(bad, hashed == F.col("bad"), "left_anti").toDF(*docs.columns)
