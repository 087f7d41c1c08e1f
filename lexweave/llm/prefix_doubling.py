"""Repeated byte strings by distributed prefix doubling.

Positions are ranked by growing prefixes: two positions share a rank of length
2h if they share the rank of length h at the position and at offset h, so Spark
groups the pairs of ranks at growing offsets. A position whose pair occurs once
leaves; what is left at the threshold is repeated. A rank is the 64-bit name of
its pair, equal for equal pairs, so no numbering has to be joined back.

Not every byte is a position. A window of `LENGTH` bytes is owned by the
smallest hash among its `START`-byte strings, its anchor; equal windows have
equal anchors at equal places. An anchor whose first rank is unique owns only
unique windows and is never emitted. Occurrences with the same whole surroundings
are one row with a count from then on. Pairs of the anchors' ranks with those
beside them, right and left, rule out the windows that reach over a unique one.
The starts of the windows left are doubled from a quarter of the length to the
half and the whole, which decides them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable, fresh_folder
from . import text as tx
from .bitmap import bitmap, may_hold

LENGTH, START = 200, 32
_PLACE = np.uint64((1 << 22) - 1)
#: Bytes around a part of a long text that the ranks of its anchors may read.
_AROUND = 512
#: Spark's setting to remove a query's shuffle files at its end, not when the driver's collector comes to them.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Joins a rank with the rank at the offset.
_PAIR = np.uint64(0xD1342543DE82EF95)
#: Surroundings that are sent to all tasks, at most; each has less than 200 pairs of numbers.
MOST_HOT = 1024
#: Names a task remembers, so as not to send their surroundings again.
SEEN = 1 << 20


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


class Anchors:
    """Anchors of the windows that start in [lo, hi) of each text; texts lie at [begin, end) of `data`."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int):
        self.data, self.length = data, length
        some = np.flatnonzero(hi > lo)
        self.empty = not len(some)
        if self.empty:
            return
        start = min(START, length)
        self.names = tx.Names(data)
        at = np.arange(len(data) - start + 1)
        grams = self.names.of(at, at + start)
        owner = _smallest((grams & ~_PLACE) | at.astype(np.uint64), length - start + 1) & _PLACE
        mark = np.zeros(len(data) + 1, np.int8)
        mark[lo[some]] = 1
        mark[hi[some]] -= 1
        p = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8))
        q = owner[p].astype(np.int64)
        new = np.ones(len(p), bool)
        new[1:] = (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1)
        first = np.flatnonzero(new)
        self.first, self.last, self.q = p[first], p[np.r_[first[1:], len(p)] - 1], q[first]
        self.row = some[np.searchsorted(lo[some], self.first, "right") - 1]
        self.begin, self.end = begin[self.row], end[self.row]
        self.rank = grams[self.q]

    def keep(self, which: np.ndarray) -> None:
        for name in ("first", "last", "q", "row", "begin", "end", "rank"):
            setattr(self, name, getattr(self, name)[which])

    def around(self) -> np.ndarray:
        """Name of all the bytes that the owned windows cover, and of where the anchor lies in them."""
        covered = self.names.of(self.first, self.last + self.length)
        return tx.mix(covered + (self.q - self.first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def beside(self, a: int, b: int, without: np.ndarray) -> pa.Array:
        """Names of the bytes from `a` to `b` relative to the anchors; null where the text does not reach, and `without`."""
        i, j = self.q + a, self.q + b
        inside = (i >= self.begin) & (j <= self.end) & ~without
        out = np.zeros(len(i), np.uint64)
        out[inside] = self.names.of(i[inside], j[inside])
        return pa.array(tx.signed(out), mask=~inside)


def _parts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, int, Anchors]]:
    """First row, offset of the part in its text (0 unless the text is cut into parts), anchors."""
    for i, j, data, offsets in tx.texts(batch, "t"):
        n = len(data)
        if j - i > 1 or n <= 2 * tx.RUN_BYTES:
            yield i, 0, Anchors(data, offsets[:-1], offsets[1:], offsets[:-1], offsets[1:] - length + 1, length)
            continue
        for s in range(0, n - length + 1, tx.RUN_BYTES):
            e = min(n - length + 1, s + tx.RUN_BYTES)
            b, f = max(0, s - _AROUND), min(n, e + length + _AROUND)
            one = [np.array([x]) for x in (0, f - b, s - b, e - b)]
            yield i, b, Anchors(data[b:f], *one, length)


def _first_ranks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [a.rank for _, _, a in _parts(batch, length) if not a.empty]
        names, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(tx.signed(names)), pa.array(counts)], ["name", "n"])


def _steps(length: int) -> list[tuple[str, int, int, int]]:
    """Doubling steps: side, bytes beside the anchor that join the rank (from, to), and the reach that a unique rank rules out."""
    out, h = [], START
    while h < length:
        if 2 * h < length:
            out.append(("right", h, 2 * h, 2 * h))
        out.append(("left", -h, -(h // 2) if h > START else 0, h))
        h *= 2
    return out


def _candidates(batches: Iterator[pa.RecordBatch], shared, length: int) -> Iterator[pa.RecordBatch]:
    """Anchors whose first rank may be repeated; what the later steps need comes with a task's first of equal surroundings."""
    steps, words, seen = _steps(length), shared.value, set()
    for batch in batches:
        keys = batch.column(0)
        for i, shift, a in _parts(batch, length):
            if a.empty:
                continue
            a.keep(may_hold(words, a.rank))
            if not len(a.q):
                continue
            around = tx.signed(a.around())
            if len(seen) > SEEN:
                seen.clear()
            again = np.zeros(len(around), bool)
            for k, name in enumerate(around.tolist()):
                again[k] = name in seen
                seen.add(name)
            raw = a.data.tobytes()
            covers = [None if x else raw[b:e] for x, b, e in zip(again, a.first, a.last + length, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(i + a.row)), pa.array(a.first - a.begin + shift), pa.array(around), pa.array(tx.signed(a.rank), mask=again),
                    pa.array((a.q - a.last).astype(np.int32), mask=again), pa.array((a.q - a.first).astype(np.int32), mask=again),
                    pa.array(covers, pa.binary()), *[a.beside(b, e, again) for _, b, e, _ in steps],
                ],
                ["key", "first", "around", "rank", "near", "far", "cover", *[f"next{k}" for k in range(len(steps))]],
            )


def _offsets(length: int) -> list[int]:
    """Offsets of the doubling of a window's prefix: ranks of a quarter join to a half, two halves (overlapping if need be) to the whole."""
    h = -(-length // 4)
    return [h, length - 2 * h]


def _ranked(batches: Iterator[pa.RecordBatch], length: int, offsets: list[int], repeated=None, n_known: int = 0) -> Iterator[pa.RecordBatch]:
    """Rank of every open window's prefix after the doubling steps of `offsets`.

    A step names the pair of a position's rank and the rank at the offset, so equal pairs and only they share a rank.
    `repeated` is the bitmap of the ranks after `n_known` steps that occur again: a window whose prefix is not in it has left.
    """
    h = -(-length // 4)
    for batch in batches:
        around, times, whole, near, far = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        covers = batch.column(5).cast(pa.large_binary())
        ends = np.frombuffer(covers.buffers()[1], np.int64)[covers.offset : covers.offset + len(covers) + 1]
        raw = np.frombuffer(covers.buffers()[2], np.uint8)
        size = (far - near + 1).astype(np.int64)
        for s in range(0, len(around), 2000):
            e = min(len(around), s + 2000)
            data = raw[ends[s] : ends[e]]
            row = np.repeat(np.arange(s, e), size[s:e])
            d = near[row] + np.arange(len(row)) - np.repeat(np.cumsum(size[s:e]) - size[s:e], size[s:e])
            at = ends[row] - ends[s] + whole[row] - d
            every = np.arange(len(data) - h + 1)
            rank = tx.Names(data).of(every, every + h)
            for k in range(len(offsets) + 1):
                if repeated is not None and k == n_known:
                    some = may_hold(repeated.value, rank[at])
                    row, d, at = row[some], d[some], at[some]
                if k < len(offsets):
                    rank = tx.mix(rank[: len(rank) - offsets[k]] * _PAIR + rank[offsets[k] :])
            yield pa.RecordBatch.from_arrays(
                [pa.array(tx.signed(rank[at])), pa.array(around[row]), pa.array(d.astype(np.int32)), pa.array(times[row])], ["rank", "around", "d", "n"]
            )


def _stored(df: DataFrame, folder: str) -> DataFrame:
    """`df` as a written table. What it shuffled is released at once, since nothing reads it again."""
    conf = df.sparkSession.conf
    before = conf.get(_RELEASE, "false")
    conf.set(_RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        conf.set(_RELEASE, before)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def repeated_spans(docs: DataFrame, key: Column, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """`key`, `spans` (begin and end bytes, which may overlap) of the texts with a string of `length` bytes that also starts elsewhere.

    `key` names a text's row and must differ between rows of different text. Null and shorter texts have none. Rows that
    are equal are elsewhere to one another.
    """
    if length < START or length > _AROUND:
        raise ValueError(f"length must lie between {START} and {_AROUND}")
    spark = docs.sparkSession
    rows = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("t"))
    rows = rows.where(F.octet_length("t") >= length)
    first = rows.mapInArrow(lambda b: _first_ranks(b, length), "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    first = durable(first.where("n > 1").select("name"))
    steps = _steps(length)
    kind = "key bigint, first bigint, around bigint, rank bigint, near int, far int, cover binary"
    kind += "".join(f", next{k} bigint" for k in range(len(steps)))
    shared = spark.sparkContext.broadcast(bitmap(first, first.count()))
    folder = fresh_folder(spark, "doubling")
    anchors = _stored(rows.mapInArrow(lambda b: _candidates(b, shared, length), kind), f"{folder}/anchors")
    shared.unpersist()

    # Occurrences of the same surroundings are one row from here on.
    same = ["rank", "near", "far", *[f"next{k}" for k in range(len(steps))]]
    distinct = anchors.groupBy("around").agg(F.count("*").alias("n"), *[F.first(c, True).alias(c) for c in same])
    distinct = _stored(distinct, f"{folder}/distinct")
    groups = distinct.groupBy("rank").agg(F.count("*").alias("kinds"))
    open_ = distinct.join(groups.where("kinds > 1").select("rank"), "rank")
    open_ = open_.select("around", "n", "near", "far", F.col("far").alias("whole"), F.col("rank").alias("right"), F.col("rank").alias("left"), *same[3:])
    for h in sorted({-b if side == "left" else b for side, b, _, _ in steps}):
        # Both sides of one length are ranked from the same table.
        ranked = open_
        for k, (side, at, _, reach) in enumerate(steps):
            if abs(at) != h:
                continue
            nxt = f"next{k}"
            pairs = open_.where(F.col(side).isNotNull() & F.col(nxt).isNotNull()).groupBy(side, nxt)
            pairs = pairs.agg(F.sum("n").alias("_n"), F.min("around").alias("_rank"))
            pairs = pairs.where("_n > 1").select(F.col(side).alias("_a"), F.col(nxt).alias("_b"), "_rank")
            ranked = ranked.join(pairs, (ranked[side] == pairs["_a"]) & (ranked[nxt] == pairs["_b"]), "left")
            unique = F.col("_rank").isNull()
            near = F.when(unique, F.greatest("near", F.lit(length - reach + 1))).otherwise(F.col("near"))
            far = F.when(unique, F.least("far", F.lit(reach - 1))).otherwise(F.col("far"))
            changed = {"near": near} if side == "right" else {"far": far}
            ranked = ranked.withColumns({**changed, side: F.col("_rank")}).drop("_a", "_b", "_rank", nxt)
        open_ = _stored(ranked.where("near <= far"), f"{folder}/open{h}")
    left = open_.select(F.col("around").alias("_around"), F.col("near").alias("_near"), F.col("far").alias("_far"), F.col("whole").alias("_whole"), "n")
    covers = anchors.where(F.col("cover").isNotNull()).select("around", "cover")
    covers = covers.join(left, covers["around"] == left["_around"]).groupBy("around").agg(
        F.first("n").alias("n"), F.first("_whole").alias("whole"), F.first("_near").alias("near"), F.first("_far").alias("far"), F.first("cover").alias("cover")
    )
    covers = _stored(covers, f"{folder}/covers")
    kind, steps, known = "rank bigint, around bigint, d int, n bigint", _offsets(length), None
    for k in range(len(steps)):
        # The pairs of this step are grouped; those that occur once leave before the next one.
        ranks = covers.mapInArrow(lambda b, k=k, known=known: _ranked(b, length, steps[: k + 1], known, k), kind)
        twice = ranks.groupBy("rank").agg(F.sum("n").alias("_n"))
        twice = _stored(twice.where("_n > 1").select("rank"), f"{folder}/twice{k}")
        if known is not None:
            known.unpersist()
        known = spark.sparkContext.broadcast(bitmap(twice, twice.count(), "rank"))
    # A cover that occurs twice needs no look at its windows.
    windows = covers.where("n = 1").mapInArrow(lambda b: _ranked(b, length, steps, known, len(steps)), kind).select("rank", "around", "d")
    single = windows.join(twice, "rank").groupBy("around").agg(F.collect_set("d").alias("ds"))
    ends = F.filter("ds", lambda d: ~F.array_contains("ds", d + 1))
    begins = F.filter("ds", lambda d: ~F.array_contains("ds", d - 1))
    runs = F.arrays_zip(F.array_sort(begins).alias("near"), F.array_sort(ends).alias("far"))
    runs = runs.cast("array<struct<near:int,far:int>>")
    every = distinct.where("n > 1").select("around", F.array(F.struct("near", "far")).alias("runs"))
    decided = every.unionByName(single.select("around", runs.alias("runs")))
    decided = _stored(decided.join(distinct.select("around", "n", F.col("far").alias("_far")), "around"), f"{folder}/decided")

    # Surroundings with more than one in MOST_HOT of the rows are fewer than MOST_HOT: they go to the rows, the others meet them by a shuffle.
    places = anchors.select("key", "first", "around")
    total = decided.agg(F.sum("n")).first()[0] or 0
    hot = decided.where(F.col("n") > total // MOST_HOT)
    marked = places.join(F.broadcast(hot), "around", "left")
    found = marked.where("runs IS NOT NULL").unionByName(
        marked.where("runs IS NULL").select("key", "first", "around").join(decided.where(F.col("n") <= total // MOST_HOT), "around")
    )
    place = F.col("first") + F.col("_far")
    spans = F.transform("runs", lambda r: F.struct((place - r["far"]).alias("b"), (place - r["near"] + length).alias("e")))
    # Copies of a row have equal spans, which are kept once.
    return found.select("key", spans.alias("spans")).groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tx.column(batch, "t")
        raw = data.tobytes()
        out = []
        for row, spans in enumerate(batch.column(batch.schema.get_field_index("spans")).to_pylist()):
            body = raw[offsets[row] : offsets[row + 1]]
            kept, at, removed, count = [], 0, 0, 0
            for s in sorted((s["b"], s["e"]) for s in spans or ()):
                if s[0] > at or not count:
                    kept.append(body[at : s[0]])
                    count += 1
                    removed += s[1] - s[0]
                elif s[1] > at:
                    removed += s[1] - at
                at = max(at, s[1])
            kept.append(body[at:])
            rest = b"".join(kept)
            out.append((len(body), removed, count, hashlib.sha256(rest).hexdigest() if digest else rest))
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def _pass(batches: Iterator[pa.RecordBatch], shared, with_spans: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose key may have spans, or the others."""
    for batch in batches:
        has = may_hold(shared.value, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
        yield batch.filter(pa.array(has == with_spans))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """`id_col`, `n_bytes`, `n_removed`, `n_spans`, `kept` of every row; `kept` is the remaining bytes or their SHA-256.

    A null text is empty. What is left need not be valid UTF-8. An empty table gives an empty one. Only texts that may
    have spans are shuffled to meet them.
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    folder = fresh_folder(spark, "spans")
    spans = _stored(repeated_spans(docs, key, text_col, length), folder)
    keys = spans.select(F.col("key").alias("name"))
    shared = spark.sparkContext.broadcast(bitmap(keys, keys.count()))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    kind = f"id {docs.schema[id_col].dataType.simpleString()}"
    some, others = (rows.mapInArrow(lambda b, w=w: _pass(b, shared, w), f"{kind}, key bigint, t string") for w in (True, False))
    joined = some.join(spans, "key", "left").select("id", "t", "spans")
    joined = joined.union(others.select("id", "t", F.lit(None).cast(spans.schema["spans"].dataType)))
    out = joined.mapInArrow(lambda b: _cut(b, digest), f"{kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept {'string' if digest else 'binary'}")
    return out.withColumnRenamed("id", id_col)
