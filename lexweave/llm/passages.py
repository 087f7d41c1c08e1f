"""Repeated passages by MinHash banding of paragraphs.

Units are compared. One kind is a paragraph (a line) of at least one shingle. The
other is a passage inside a paragraph: paragraphs are cut where a hash of the
words is smallest among its neighbours, so the same words are cut alike wherever
they stand. A run of pieces each of which occurs again beside the same neighbour
is a unit if it has `MIN_WORDS` words; a piece that is repeated by itself, beside
other words, does not lengthen the run. Runs that stand at most `GAP_WORDS` apart,
as an edit leaves them, are also a unit together. Which pairs of pieces occur
again is decided exactly: a bitmap is asked first, and those that pass it but
occur once are named to the texts, all of them up to `MOST_WRONG`, beyond that to
each text its own by a join.

Equal units are one. Every distinct unit gets MinHash bands; rows and bands are
chosen so that units of the threshold's similarity collide with `RECALL` or more.
Units so short that only equal shingles reach the threshold need one band.
In every bucket each unit is paired with the smallest one, pairs are verified by
the exact Jaccard similarity of their five-word shingles, and verified pairs are
joined into components. A bucket that still holds several components is settled
in full: the units outside its largest component are indexed by their shingles, as many
at a time as have `ROOM` shingles, and all units of the bucket pass by the index once for
each such part. So a star loses no link of a bucket, and a bucket's rows are
not repeated but for what is outside its largest component beyond one part.

Of each component the first unit stays, by document and place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import durable, fresh_folder
from . import text as tx
from .bitmap import bitmap, may_hold
from .components import connected_components

SHINGLE_WORDS, THRESHOLD = 5, 0.8
MIN_WORDS = 20
RECALL = 0.999
BAND_ROWS = 4
#: A word begins a piece if its hash is smallest among so many on either side.
REACH = 4
#: Words between runs of repeated pieces that are also taken together: a changed word and the pieces cut anew around it.
GAP_WORDS = 24
#: Pairs wrongly held for repeated that are broadcast, 32 MB of names.
MOST_WRONG = 1 << 22
#: Shingles of a bucket that are indexed at a time, 16 MB of names.
ROOM = 1 << 21


def tuned_bands(threshold: float = THRESHOLD, rows: int = BAND_ROWS, recall: float = RECALL) -> int:
    """The fewest bands of `rows` rows that catch similarity `threshold` with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


class Words:
    """Words of a run of texts with their line, names and pieces."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = tx.ALPHANUMERIC):
        data = tx.LOWER[data]
        self.starts, self.ends, self.counts = tx.words(data, offsets, kind)
        n = len(self.starts)
        self.names = tx.Names(data).of(self.starts, self.ends) if n else np.empty(0, np.uint64)
        breaks = np.union1d(np.flatnonzero(data == 10), offsets[1:-1])
        line = np.searchsorted(breaks, self.starts, "right")
        new_line = np.ones(n, bool)
        new_line[1:] = line[1:] != line[:-1]
        self.lines = np.flatnonzero(new_line)
        pair = tx.mix(self.names + np.uint64(0x9E3779B97F4A7C15))
        least = np.full(n, True)
        for k in range(1, REACH + 1):
            if n > k:
                least[k:] &= pair[k:] < pair[:-k]
                least[:-k] &= pair[:-k] < pair[k:]
        self.pieces = np.flatnonzero(least | new_line)
        self._sum = np.zeros(n + 1, np.uint64)
        weight = np.cumprod(np.full(max(1, n), 0x9E3779B97F4A7C15, np.uint64))[:n]
        self._down = np.cumprod(np.full(max(1, n), pow(0x9E3779B97F4A7C15, -1, 2**64), np.uint64))[:n]
        np.cumsum(self.names * weight, out=self._sum[1:])

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of runs of words."""
        size = (end - begin).astype(np.uint64)
        return tx.mix((self._sum[end] - self._sum[begin]) * self._down[begin] + size * np.uint64(0xD6E8FEB86659FD93))

    def of(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and name of the runs that `starts` begin."""
        ends = np.r_[starts[1:], len(self.names)] if len(starts) else starts
        return starts, ends, self.spans(starts, ends) if len(starts) else np.empty(0, np.uint64)

    def links(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and name of neighbouring pieces of a line, and of single pieces of `min_words`."""
        pieces, ends, _ = self.of(self.pieces)
        beside = np.flatnonzero(~np.isin(pieces[1:], self.lines))
        long = ends - pieces >= min_words
        begin, end = np.r_[pieces[beside], pieces[long]], np.r_[ends[beside + 1], ends[long]] if len(pieces) else pieces
        return begin, end, self.spans(begin, end) if len(begin) else np.empty(0, np.uint64)

    def units(self, words: np.ndarray, wrong: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of paragraphs, and of runs of repeated pieces that are not a whole paragraph."""
        lines, line_ends, _ = self.of(self.lines)
        begin, end, names = self.links(min_words)
        again = may_hold(words, names) if len(names) else np.empty(0, bool)
        again[again] = ~_holds(wrong, names[again])
        order = np.argsort(begin[again], kind="stable")
        begin, end = begin[again][order], np.maximum.accumulate(end[again][order])
        begin, end = _runs(begin, end, begin[1:] >= end[:-1])
        line = np.searchsorted(lines, begin, "right")
        first, last = _runs(begin, end, (line[1:] != line[:-1]) | (begin[1:] - end[:-1] > GAP_WORDS))
        several = last > end[np.searchsorted(begin, first)]
        begin, end = np.r_[begin, first[several]], np.r_[end, last[several]]
        inner = ~(np.isin(begin, lines) & np.isin(end, line_ends))
        least = np.repeat([SHINGLE_WORDS, min_words], [len(lines), inner.sum()])
        begin, end = np.r_[lines, begin[inner]], np.r_[line_ends, end[inner]]
        long = end - begin >= least
        return begin[long], end[long]


def _runs(begin: np.ndarray, end: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending spans joined but where one is `apart` from that before it."""
    if not len(begin):
        return begin, end
    return begin[np.r_[True, apart]], end[np.r_[apart, True]]


def _holds(ordered: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which names are in an ascending array."""
    if not len(ordered):
        return np.zeros(len(names), bool)
    return ordered[np.minimum(np.searchsorted(ordered, names), len(ordered) - 1)] == names


def _wrong(batch: pa.RecordBatch, everywhere: np.ndarray) -> np.ndarray:
    """Names of the batch that the bitmap wrongly holds for repeated, ascending; they occur nowhere else."""
    if "wrong" not in batch.schema.names:
        return everywhere
    return np.unique(batch.column(batch.schema.get_field_index("wrong")).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _passing(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """The names that the bitmap holds for repeated."""
    for batch in batches:
        names = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(names[may_hold(shared.value, names.view(np.uint64))])], ["name"])


def _passing_pieces(batches: Iterator[pa.RecordBatch], shared, min_words: int) -> Iterator[pa.RecordBatch]:
    """Key of the text and each name that the bitmap holds for repeated."""
    for batch in batches:
        for i, _, data, offsets in tx.texts(batch, "t"):
            w = Words(data, offsets)
            begin, _, names = w.links(min_words)
            mine = may_hold(shared.value, names) if len(names) else np.empty(0, bool)
            row = np.searchsorted(np.cumsum(w.counts), begin[mine], "right")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + row)), pa.array(tx.signed(names[mine]))], ["key", "name"])


def _pieces(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [Words(data, offsets).links(min_words)[2] for _, _, data, offsets in tx.texts(batch, "t")]
        names, counts = np.unique(np.concatenate(names), return_counts=True) if names else (np.empty(0, np.uint64), np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(tx.signed(names)), pa.array(counts)], ["name", "n"])


def _min_hashes(shingles: np.ndarray, counts: np.ndarray, many: int) -> np.ndarray:
    """`many` MinHashes of each unit, a unit a row; every unit has a shingle."""
    begin = np.cumsum(counts) - counts
    out = np.empty((len(counts), many), np.uint64)
    seeds = np.random.Generator(np.random.PCG64(97)).integers(0, 2**63, (many, 2), dtype=np.uint64)
    high = shingles >> np.uint64(32)
    for k, (a, b) in enumerate(seeds):
        # Multiply-shift of both halves: the upper bits are well mixed.
        out[:, k] = np.minimum.reduceat((shingles * (a | np.uint64(1)) + high * (b | np.uint64(1))) >> np.uint64(8), begin)
    return out


def unit_shingles(w: Words, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of the units one behind another, and how many each has."""
    every, _ = tx.shingles(w.names, np.array([len(w.names)]), SHINGLE_WORDS)
    counts = end - begin - SHINGLE_WORDS + 1
    at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return every[at], counts


def unit_bands(w: Words, begin: np.ndarray, end: np.ndarray, names: np.ndarray, bands: int, rows: int, threshold: float) -> pa.ListArray:
    """The bands of each unit at its first place among these, no bands at others."""
    _, first = np.unique(names, return_index=True)
    first.sort()
    shingles, counts = unit_shingles(w, begin[first], end[first])
    least = _min_hashes(shingles, counts, bands * rows).reshape(len(first), bands, rows)
    keys = np.zeros((len(first), bands), np.uint64)
    for r in range(rows):
        keys = tx.mix(keys + least[:, :, r])
    keys = tx.mix(keys + np.arange(bands, dtype=np.uint64))
    # One shingle more or less is already too far.
    many = np.where(counts / (counts + 1) < threshold - 1e-9, 1, bands)
    size = np.zeros(len(names), np.int64)
    size[first] = many
    keys = keys[np.arange(bands) < many[:, None]]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(tx.signed(keys)))


def _units(batches: Iterator[pa.RecordBatch], shared, min_words: int, bands: int, rows: int, threshold: float) -> Iterator[pa.RecordBatch]:
    pieces, everywhere = shared.value
    for batch in batches:
        wrong = _wrong(batch, everywhere)
        for i, _, data, offsets in tx.texts(batch, "t"):
            w = Words(data, offsets)
            begin, end = w.units(pieces, wrong, min_words)
            if not len(begin):
                continue
            row = np.searchsorted(np.cumsum(w.counts), begin, "right")
            names = w.spans(begin, end)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(i + row)), pa.array(tx.signed(names)), pa.array(w.starts[begin] - offsets[row]),
                    pa.array(w.ends[end - 1] - offsets[row]), pa.array(end - begin), unit_bands(w, begin, end, names, bands, rows, threshold),
                ], ["id", "unit", "begin", "end", "n_words", "bands"],
            )


def _shingles(batches: Iterator[pa.RecordBatch], shared, min_words: int) -> Iterator[pa.RecordBatch]:
    """Sorted distinct shingles of the units that may be asked for."""
    pieces, everywhere, asked = shared.value
    for batch in batches:
        wrong = _wrong(batch, everywhere)
        for _, _, data, offsets in tx.texts(batch, "t"):
            w = Words(data, offsets)
            begin, end = w.units(pieces, wrong, min_words)
            names = w.spans(begin, end) if len(begin) else np.empty(0, np.uint64)
            names, first = np.unique(names, return_index=True)
            mine = may_hold(asked, names)
            names, begin, end = names[mine], begin[first[mine]], end[first[mine]]
            if not len(names):
                continue
            every, counts = unit_shingles(w, begin, end)
            sets = [tx.signed(np.unique(x)) for x in np.split(every, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(names)), pa.array(sets, pa.list_(pa.int64()))], ["unit", "shingles"])


def _similar(threshold: float):
    common = F.size(F.array_intersect("x", "y"))
    return common >= threshold * (F.size("x") + F.size("y") - common) - 1e-9


class _Held:
    """Units of a bucket by shingle, and the components that links found so far have joined."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]], root: dict[int, int]):
        self.units, self.parts = [r[0] for r in rows], np.array([r[1] for r in rows])
        self.sizes = np.array([len(r[2]) for r in rows])
        names = np.concatenate([r[2] for r in rows])
        order = np.argsort(names, kind="stable")
        self.of = np.repeat(np.arange(len(rows)), self.sizes)[order]
        self.names, first = np.unique(names[order], return_index=True)
        self.at = np.r_[first, len(names)]
        self.root = root

    def find(self, c: int) -> int:
        while self.root.setdefault(c, c) != c:
            c = self.root[c]
        return c

    def links(self, unit: int, part: int, shingles: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """Links of a passing unit that join two components."""
        i = np.minimum(np.searchsorted(self.names, shingles), len(self.names) - 1)
        i = i[self.names[i] == shingles]
        size = self.at[i + 1] - self.at[i]
        at = np.repeat(self.at[i] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        common = np.bincount(self.of[at], minlength=len(self.units))
        near = (common >= threshold * (self.sizes + len(shingles) - common) - 1e-9) & (self.parts != part)
        out = []
        for k in np.flatnonzero(near).tolist():
            x, y = self.find(int(self.parts[k])), self.find(part)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                out.append((unit, self.units[k]))
        return out


def _met(rows: list[tuple[int, int, np.ndarray]], out: list[tuple[int, int]], threshold: float) -> tuple[_Held, list[tuple[int, int]]]:
    """The index of `rows`, and `out` with the links among them."""
    held = _Held(rows, {})
    for row in rows:
        out += held.links(*row, threshold)
    return held, out


def _settle(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links between components; rows (bucket, chunk, side, unit, component, shingles) by the first three, side 0 is held."""
    key: tuple[int, int] | None = None
    rows: list[tuple[int, int, np.ndarray]] = []
    held: _Held | None = None
    for batch in batches:
        out: list[tuple[int, int]] = []
        plain = [c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns[:5]]
        lists = batch.column(5)
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for r, (bucket, chunk, side, unit, part) in enumerate(zip(*plain, strict=True)):
            shingles = values[ends[r] : ends[r + 1]]
            if key != (bucket, chunk):
                # Units may be held that none has passed by.
                out = _met(rows, out, threshold)[1] if rows else out
                key, rows, held = (bucket, chunk), [], None
            if side == 0:
                rows.append((unit, part, shingles.copy()))
                continue
            if rows:
                held, out = _met(rows, out, threshold)
                rows = []
            if held is not None:
                out += held.links(unit, part, shingles, threshold)
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
    if rows:
        out = _met(rows, [], threshold)[1]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])


def linked(units: DataFrame, shingles_of: Callable[[np.ndarray], DataFrame], folder: str, threshold: float, room: int = ROOM, proposed: DataFrame | None = None) -> DataFrame:
    """`node`, `component` of the `units` (`unit`, `bands`) that are similar to another.

    `proposed` (`a`, `b`, both with shingles) is verified beside the pairs of the bands. `shingles_of` gives `unit` and `shingles` of the units in a bitmap; `folder` takes what is written on the way.
    """
    spark = units.sparkSession
    buckets = units.where("size(bands) > 0").groupBy("unit").agg(F.first("bands").alias("bands")).select("unit", F.explode("bands").alias("bucket"))
    buckets.write.parquet(f"{folder}/buckets")
    buckets = spark.read.schema("unit bigint, bucket bigint").parquet(f"{folder}/buckets")
    # One shuffle finds the first unit of each bucket and whether it holds one unit, two or more (3).
    inside = W.partitionBy("bucket").orderBy("unit")
    after = [F.lead("unit", k).over(inside).isNotNull().cast("int") for k in (1, 2)]
    size = F.least(F.lit(3), F.row_number().over(inside) + after[0] + after[1])
    starred = buckets.select("bucket", "unit", F.first("unit").over(inside).alias("first"), size.alias("size"))
    members = durable(starred.where("size > 1"))
    pairs = members.where("unit > first").select(F.col("first").alias("a"), F.col("unit").alias("b"))
    asked = members.select(F.col("unit").alias("name"))
    if proposed is not None:
        pairs = pairs.union(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        asked = asked.union(proposed.select(F.explode(F.array("a", "b")).alias("name")))
    pairs = durable(pairs.distinct())

    asked = asked.distinct()
    sets = shingles_of(bitmap(asked, asked.count())).groupBy("unit").agg(F.first("shingles").alias("shingles"))
    sets.join(asked, sets["unit"] == asked["name"], "left_semi").write.parquet(f"{folder}/shingles")
    sets = spark.read.schema("unit bigint, shingles array<bigint>").parquet(f"{folder}/shingles")

    def side(unit: str, shingles: str) -> DataFrame:
        return sets.select(F.col("unit").alias(unit), F.col("shingles").alias(shingles))

    verified = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(_similar(threshold)).select("a", "b")
    parts = connected_components(verified)
    held = members.where("size > 2").join(parts, members["unit"] == parts["node"], "left")
    held = held.select("bucket", "unit", F.coalesce("component", "unit").alias("c"))
    sizes = held.groupBy("bucket", "c").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.count("*").alias("parts"), F.max_by("c", F.struct("n", "c")).alias("main"))
    held = durable(held.join(mixed.where("parts > 1").select("bucket", "main"), "bucket"))
    weight = sets.select(F.col("unit").alias("u"), F.size("shingles").alias("many"))
    weight = held.where("c != main").join(weight, F.col("unit") == F.col("u")).groupBy("bucket").agg(F.ceil(F.sum("many") / room).cast("int").alias("chunks"))
    held = held.join(weight, "bucket").withColumn("own", F.when(F.col("c") != F.col("main"), F.pmod(F.xxhash64("unit"), F.col("chunks")).cast("int")))
    every = held.select("bucket", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "own", "unit", "c")
    # A unit outside the largest component is held in a part of its own and passes by the others.
    every = every.withColumn("side", F.when(F.col("own") == F.col("chunk"), 0).otherwise(1))
    settled = every.join(side("unit", "shingles"), "unit").select("bucket", "chunk", "side", "unit", "c", "shingles")
    settled = settled.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "side")
    more = settled.mapInArrow(lambda b: _settle(b, threshold), "a bigint, b bigint")
    more = durable(more.distinct())
    if not more.isEmpty():
        parts = connected_components(verified.union(more))
    return durable(parts)


def _marked(rows: DataFrame, folder: str, min_words: int, most_wrong: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """`rows`, the bitmap of what is repeated and what it wrongly holds; above `most_wrong` names these go with the rows as `wrong`."""
    spark = rows.sparkSession
    pieces = rows.select("t").mapInArrow(lambda b: _pieces(b, min_words), "name bigint, n bigint").groupBy("name").agg((F.sum("n") > 1).alias("again"))
    pieces.write.parquet(f"{folder}/pieces")
    pieces = spark.read.schema("name bigint, again boolean").parquet(f"{folder}/pieces")
    repeated = pieces.where("again").select("name")
    words = bitmap(repeated, repeated.count())
    shared = spark.sparkContext.broadcast(words)
    single = pieces.where("not again").select("name")
    single.mapInArrow(lambda b: _passing(b, shared), "name bigint").write.parquet(f"{folder}/wrong")
    wrong = spark.read.schema("name bigint").parquet(f"{folder}/wrong")
    if wrong.count() <= most_wrong:
        return rows, words, np.sort(wrong.toArrow()["name"].to_numpy().view(np.uint64))
    keyed = rows.withColumn("key", F.xxhash64("t"))
    held = keyed.select("key", "t").mapInArrow(lambda b: _passing_pieces(b, shared, min_words), "key bigint, name bigint")
    held = held.join(wrong, "name", "left_semi")
    held.groupBy("key").agg(F.collect_list("name").alias("wrong")).write.parquet(f"{folder}/wrong-by-text")
    lists = spark.read.schema("key bigint, wrong array<bigint>").parquet(f"{folder}/wrong-by-text")
    return keyed.join(lists, "key", "left").select("id", "t", "wrong"), words, np.empty(0, np.uint64)


def repeated_units(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS,
    room: int = ROOM, most_wrong: int = MOST_WRONG,
) -> DataFrame:
    """A row for every unit of a component of two or more occurrences.

    `id_col`, `begin`, `end` (bytes in the text), `n_words`, `component` (name of its smallest unit), `members`,
    `kept_id` and `removed`: whether the unit is not its component's first by id, place and name. Null ids come last.
    Null and empty texts have no units; repeated rows have units each. Passages inside paragraphs have `min_words`.
    """
    if min_words < max(SHINGLE_WORDS, 1):
        raise ValueError(f"a unit has {SHINGLE_WORDS} words at least")
    spark = docs.sparkSession
    folder = fresh_folder(spark, "passages")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows, words, wrong = _marked(rows, folder, min_words, most_wrong)
    shared = spark.sparkContext.broadcast((words, wrong))
    bands = tuned_bands(threshold)
    kind = f"id {docs.schema[id_col].dataType.simpleString()}, unit bigint, begin bigint, end bigint, n_words bigint, bands array<bigint>"
    rows.mapInArrow(lambda b: _units(b, shared, min_words, bands, BAND_ROWS, threshold), kind).write.parquet(f"{folder}/units")
    units = spark.read.schema(kind).parquet(f"{folder}/units")

    def sets(asked: np.ndarray) -> DataFrame:
        both = spark.sparkContext.broadcast((words, wrong, asked))
        return rows.drop("id").mapInArrow(lambda b: _shingles(b, both, min_words), "unit bigint, shingles array<bigint>")

    parts = linked(units, sets, folder, threshold, room)

    classed = units.drop("bands").join(parts, units["unit"] == parts["node"], "left")
    classed = classed.select("id", "begin", "end", "n_words", "unit", F.coalesce("component", "unit").alias("component"))
    place = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("begin").alias("begin"), F.col("unit").alias("unit"))
    sizes = classed.groupBy("component").agg(F.count("*").alias("members"), F.min(place).alias("first")).where("members > 1")
    out = classed.join(sizes, "component")
    return out.select(
        F.col("id").alias(id_col), "begin", "end", "n_words", "component", "members", F.col("first.id").alias("kept_id"),
        (place != F.col("first")).alias("removed"),
    )
