"""Bigram language model in a log-frequency Bloom filter.

A count is held as its level: 1 + floor(log of the count to `BASE`). A name of
level q is in the filter with each of 1..q; the level is read by asking for 1, 2,
... until one is absent, so a wrong answer of the filter can only raise it, and
rarely by more than one. The filter holds every word and word pair of the
training texts. It is made of segments by hash of the name, each sized by what it
holds; the segments are broadcast, as many at a time as fit `ROUND_BYTES`, and
further ones cost further passes over the texts.

A word's probability after another is smoothed towards its own,

    p(w | v) = (c(v w) + k p(w)) / (c(v) + k),    p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),

with all counts read from the filter, the upper one rounded down and the lower
one up, and k the strength under which all training texts are likeliest, each
token with one occurrence taken off for its text and for each exact copy of it.
Tokens of equal levels are one kind, so every strength is tried, and every text scored under each, in the one pass in which
texts ask the filter. Texts begin after a word of their own and end with `END`.

The base score uses exact counts. Words of at least N / `FREQUENT` occurrences,
of which there are at most `FREQUENT`, are broadcast; the others are joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import fresh_folder
from . import text as tx

BASE = 1.3
BITS_PER_ITEM, PROBES = 8, 5
#: Names a segment holds, about.
SEGMENT_NAMES = 250_000
#: Filter bytes broadcast at a time.
ROUND_BYTES = 128 << 20
FREQUENT = 1 << 21
#: Texts that ask the filter together, each distinct name once.
ASK_BYTES = 1 << 20
#: Names of this level and above are kept by the task that asked for them, about so many (10 MB): they come again and cost most.
KEPT_LEVEL, KEPT_NAMES = 8, 1 << 20
STRENGTHS = (1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0, 16384.0, 65536.0, 1e6)
_BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of all tokens, each text's followed by `END`, and how many tokens each text has."""
    data = tx.LOWER[data]
    starts, ends, counts = tx.words(data, offsets, tx.BLANK_SEPARATED)
    total = counts + 1
    last = np.cumsum(total) - 1
    out = np.empty(int(total.sum()), np.uint64)
    out[last] = END
    is_word = np.ones(len(out), bool)
    is_word[last] = False
    out[is_word] = tx.Names(data).of(starts, ends) if len(starts) else np.empty(0, np.uint64)
    return out, total


def contexts(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What each token follows."""
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[np.cumsum(counts) - counts] = _BEGIN
    return before


def pair_names(before: np.ndarray, names: np.ndarray) -> np.ndarray:
    return tx.mix(tx.mix(before + np.uint64(0x9E3779B97F4A7C15)) ^ names)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Level of each count of at least one."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


_LEAST = np.r_[0.0, BASE ** np.arange(255.0)]
_MOST = np.r_[0.0, BASE ** np.arange(1.0, 256.0)]


def least(levels: np.ndarray) -> np.ndarray:
    return _LEAST[levels]


def most(levels: np.ndarray) -> np.ndarray:
    return _MOST[levels]


def _hashes(names: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a name at a level; its places come from the first and steps of the second."""
    a = tx.mix(names + np.atleast_1d(level) * np.uint64(0xD1342543DE82EF95))
    return a, (a >> np.uint64(17) ^ a * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def _place(a: np.ndarray, b: np.ndarray, k: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    """The kth place below `bits`, which are fewer than 2^32."""
    return ((a + np.uint64(k) * b) >> np.uint64(32)) * bits >> np.uint64(32)


def segment(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter bytes for distinct names."""
    level = levels_of(counts)
    bits = np.uint64(max(64, 8 * -(-int(level.sum()) * BITS_PER_ITEM // 8)))
    out = np.zeros(int(bits) // 8, np.uint8)
    repeated = np.repeat(names, level)
    each = np.arange(len(repeated)) - np.repeat(np.cumsum(level) - level, level) + 1
    for s in range(0, len(repeated), 1 << 20):
        a, b = _hashes(repeated[s : s + (1 << 20)], each[s : s + (1 << 20)].astype(np.uint64))
        for k in range(PROBES):
            place = _place(a, b, k, bits)
            np.bitwise_or.at(out, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    return out


class Filter:
    """Some segments of `parts`, one behind another: where each begins, its bits, all their bytes."""

    def __init__(self, begin: np.ndarray, bits: np.ndarray, raw: bytes):
        self.begin, self.bits, self.data = begin, bits, np.frombuffer(raw, np.uint8)
        self.kept, self.kept_levels = np.empty(0, np.uint64), np.empty(0, np.uint8)

    def levels(self, names: np.ndarray) -> np.ndarray:
        """Level of each of some distinct names; 0 where the filter lacks it or its segment is not here."""
        out = np.zeros(len(names), np.uint8)
        new = np.arange(len(names))
        if len(self.kept):
            at = np.minimum(np.searchsorted(self.kept, names), len(self.kept) - 1)
            known = self.kept[at] == names
            out[known] = self.kept_levels[at[known]]
            new = np.flatnonzero(~known)
        out[new] = found = self._asked_for(names[new])
        often = found >= KEPT_LEVEL
        if often.any() and len(self.kept) < KEPT_NAMES:
            more = names[new[often]]
            order = np.argsort(more)
            at = np.searchsorted(self.kept, more[order])
            self.kept = np.insert(self.kept, at, more[order])
            self.kept_levels = np.insert(self.kept_levels, at, found[often][order])
        return out

    def _asked_for(self, names: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), np.uint8)
        part = ((names >> np.uint64(32)) * np.uint64(len(self.bits)) >> np.uint64(32)).astype(np.int64)
        left = np.flatnonzero(self.bits[part] > 0)
        names, bits, first = names[left], self.bits[part[left]], self.begin[part[left]].astype(np.uint64) << np.uint64(3)
        level = 0
        while len(left) and level < 255:
            level += 1
            a, b = _hashes(names, np.uint64(level))
            # Half of the probes leave few names that are absent; only for the others the rest is asked.
            inside = self._set(a, b, first, bits, range(PROBES // 2))
            some = np.flatnonzero(inside)
            some = some[self._set(a[some], b[some], first[some], bits[some], range(PROBES // 2, PROBES))]
            left, names, bits, first = left[some], names[some], bits[some], first[some]
            out[left] = level
        return out

    def _set(self, a: np.ndarray, b: np.ndarray, first: np.ndarray, bits: np.ndarray, probes: range) -> np.ndarray:
        inside = None
        for k in probes:
            place = first + _place(a, b, k, bits)
            bit = self.data[(place >> np.uint64(3)).view(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)
            inside = bit if inside is None else inside & bit
        return (inside & 1).view(bool)

    def asked(self, names: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Levels of each token, of what it follows and of both; nothing is known of what begins a text."""
        distinct, back = np.unique(names, return_inverse=True)
        word = self.levels(distinct)[back]
        before = np.zeros_like(word)
        before[1:] = word[:-1]
        before[np.cumsum(counts) - counts] = 0
        pairs, at = np.unique(pair_names(contexts(names, counts), names), return_inverse=True)
        return np.concatenate([word, before, self.levels(pairs)[at]])


@dataclass
class Model:
    """Totals of the training tokens, the filter's segments (a table of `part`, `bits`) and the smoothing strength."""

    parts: int
    rounds: list[list[int]]
    segments: str
    words: str
    n: int
    v: int
    texts: int
    strength: float = 64.0


def _count(batches: Iterator[pa.RecordBatch], pairs: bool) -> Iterator[pa.RecordBatch]:
    """Distinct names of a batch with their counts."""
    for batch in batches:
        held = []
        for _, _, data, offsets in tx.texts(batch, "t"):
            names, counts = tokens(data, offsets)
            held.append(np.unique(pair_names(contexts(names, counts), names) if pairs else names, return_counts=True))
        if held:
            names, which = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            counts = np.bincount(which, weights=np.concatenate([h[1] for h in held])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(names)), pa.array(counts)], ["name", "n"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part among the rows (part, name, n) of a task."""
    held: dict[int, list] = {}
    for batch in batches:
        part, name, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        for k in np.unique(part):
            mine = part == k
            held.setdefault(int(k), []).append((name[mine].view(np.uint64), n[mine]))
    for k, rows in held.items():
        raw = segment(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([raw], pa.binary())], ["part", "bits"])


def _filled(rows: DataFrame, segment_names: int, round_bytes: int) -> Model:
    """The counts of the texts `t` and the filter, without a strength."""
    spark = rows.sparkSession
    words, segments = fresh_folder(spark, "lm-words"), fresh_folder(spark, "lm-filter")
    counted = rows.mapInArrow(lambda b: _count(b, False), "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    counted.write.parquet(words)
    known = spark.read.schema("name bigint, n bigint").parquet(words)
    n, v, texts = known.agg(
        F.sum("n"), F.count("*"), F.max(F.when(F.col("name") == int(tx.signed(np.array([END]))[0]), F.col("n")))
    ).first()
    n, v, texts = n or 0, v, texts or 0
    # A pair has a pair of tokens, so the tokens bound the names; half of them is the usual share.
    parts = max(1, -(-(v + n // 2) // segment_names))
    pairs = rows.mapInArrow(lambda b: _count(b, True), "name bigint, n bigint")
    # Ascending names go from segment to segment, so a task that asks them in order stays in one that its cache holds.
    part = F.shiftright(F.shiftrightunsigned("name", 32) * F.lit(parts).cast("bigint"), 32).cast("int")
    whole = known.union(pairs).withColumn("part", part).repartition(-(-parts // 4), "part")
    summed = whole.groupBy("part", "name").agg(F.sum("n").alias("n"))
    summed.mapInArrow(_segments, "part int, bits binary").write.parquet(segments)
    sizes = spark.read.schema("part int, bits binary").parquet(segments).select("part", F.octet_length("bits").alias("size"))
    rounds, held = [[]], 0
    for r in sizes.orderBy("part").collect():
        if rounds[-1] and held + r["size"] > round_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append(r["part"])
        held += r["size"]
    return Model(parts, rounds, segments, words, n, v, texts)


def train(docs: DataFrame, text_col: str = "text", segment_names: int = SEGMENT_NAMES, round_bytes: int = ROUND_BYTES) -> Model:
    """The model of all rows of `docs`; null and empty texts are texts of the end alone.

    Writes the word counts and the filter below the shared folder.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("t"))
    model = _filled(rows, segment_names, round_bytes)
    read = _read(_with_copies(rows.select(F.lit(0).alias("id"), F.lit(0).cast("bigint").alias("key"), "t", F.lit(True).alias("training"))), model, STRENGTHS)
    model.strength = _likeliest(read)
    return model


def _sent(spark, model: Model, parts: list[int]):
    """Some segments, broadcast; they come to the driver one file after another."""
    table = spark.read.schema("part int, bits binary").parquet(model.segments).where(F.col("part").isin(parts))
    begin, bits, raw = np.zeros(model.parts, np.int64), np.zeros(model.parts, np.uint64), bytearray()
    for r in table.toLocalIterator():
        begin[r["part"]], bits[r["part"]] = len(raw), len(r["bits"]) * 8
        raw += r["bits"]
    return spark.sparkContext.broadcast((begin, bits, raw))


def _levels(rows: DataFrame, model: Model) -> Iterator[tuple[DataFrame, object]]:
    """The rows before each round with the round's segments; between rounds the levels found go along in `lv`."""
    spark = rows.sparkSession
    for k, parts in enumerate(model.rounds):
        sent = _sent(spark, model, parts)
        if k == len(model.rounds) - 1:
            yield rows, sent
            return
        folder = fresh_folder(spark, "lm-round")
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "lv") + ", lv binary"
        rows.mapInArrow(_round(sent), kind).write.parquet(folder)
        sent.unpersist()
        rows = spark.read.parquet(folder)


def _known_levels(batch: pa.RecordBatch, i: int, counts: np.ndarray) -> np.ndarray | int:
    """Levels that earlier rounds found for the run of rows from `i`."""
    if "lv" not in batch.schema.names:
        return 0
    raw = [np.frombuffer(x, np.uint8).reshape(3, -1) for x in batch.column("lv").slice(i, len(counts)).to_pylist()]
    return np.concatenate(raw, 1).ravel()


def _round(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Filter(*sent.value)
        for batch in batches:
            out = []
            for i, _, data, offsets in tx.texts(batch, "t"):
                names, counts = tokens(data, offsets)
                level = np.maximum(held.asked(names, counts), _known_levels(batch, i, counts)).reshape(3, -1).astype(np.uint8)
                ends = np.cumsum(counts)
                out += [level[:, b:e].tobytes() for b, e in zip(ends - counts, ends, strict=True)]
            kept = [k for k, name in enumerate(batch.schema.names) if name != "lv"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in kept], pa.array(out, pa.binary())], [*[batch.schema.names[k] for k in kept], "lv"]
            )

    return run


def log_probabilities(level: np.ndarray, begins: np.ndarray, model: Model, strength: float, own: int | np.ndarray = 0) -> np.ndarray:
    """log10 p of every token from the levels of itself, what it follows and both; `own` occurrences are taken off."""
    word, before, pair = level.reshape(3, -1)
    alone = (np.maximum(least(word) - own, 0) + 0.1) / (model.n + 0.1 * (model.v + 1))
    below = np.where(begins, float(model.texts), most(before))
    above = np.minimum(np.maximum(least(pair) - own, 0), below)
    return np.log10((above + strength * alone) / (np.maximum(below - own, above) + strength))


def _codes(level: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels and begins of the distinct kinds of tokens, and the kind of each token."""
    word, before, pair = level.reshape(3, -1).astype(np.int64)
    m = int(level.max(initial=0)) + 1
    code = ((pair * m + before) * m + word) * 2 + begins
    if m**3 > 1 << 22:
        kinds, at = np.unique(code, return_inverse=True)
    else:
        here = np.zeros(2 * m**3, bool)
        here[code] = True
        kinds = np.flatnonzero(here)
        at = (np.cumsum(here) - 1)[code]
    rest = kinds >> 1
    return np.concatenate([rest % m, rest // m % m, rest // (m * m)]), (kinds & 1).astype(bool), at


def _reader(sent, model: Model, frequent, strengths: tuple[float, ...]):
    """Of each text the sum of log probabilities under each strength, the base score of frequent words and the other words.

    `trained` stands with the first text of a run: the sums of all its training tokens, each without the occurrences
    in its text and the copies of that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Filter(*sent.value)
        common, occurs = frequent.value
        whole = model.n + 0.1 * (model.v + 1)
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            copies = batch.column(batch.schema.get_field_index("copies")).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in tx.texts(batch, "t", ASK_BYTES):
                names, counts = tokens(data, offsets)
                begin = np.cumsum(counts) - counts
                level = np.maximum(held.asked(names, counts), _known_levels(batch, i, counts))
                first = np.zeros(len(names), bool)
                first[begin] = True
                kinds, begins, at = _codes(level, first)
                own = np.repeat(copies[i:j].astype(np.int64), counts)
                trained = np.zeros(len(strengths))
                for c in np.unique(copies[i:j]).tolist():
                    if c:
                        times = np.bincount(at[own == c], minlength=len(begins))
                        trained += [(times * log_probabilities(kinds, begins, model, s, c)).sum() for s in strengths]
                sums = [np.add.reduceat(log_probabilities(kinds, begins, model, s)[at], begin) for s in strengths]
                cols[0].append(np.stack(sums, 1))
                cols[1] += [trained, *[None] * (j - i - 1)]
                distinct, back = np.unique(names, return_inverse=True)
                at = np.minimum(np.searchsorted(common, distinct), max(0, len(common) - 1))
                held_here = common[at] == distinct if len(common) else np.zeros(len(distinct), bool)
                base = np.where(held_here, np.log10((occurs[at] if len(common) else 0) + 0.1) - np.log10(whole), 0.0)
                is_common, base = held_here[back], base[back]
                cols[2].append(counts)
                cols[3].append(np.add.reduceat(base, begin))
                cols[4].append(np.add.reduceat(is_common.astype(np.int64), begin))
                row = np.repeat(np.arange(len(counts)), counts)[~is_common]
                rare = names[~is_common]
                order = np.lexsort((rare, row))
                rare, row = rare[order], row[order]
                new = np.ones(len(rare), bool)
                new[1:] = (rare[1:] != rare[:-1]) | (row[1:] != row[:-1])
                start = np.flatnonzero(new)
                times = np.diff(np.r_[start, len(rare)]).astype(np.int32)
                cut = np.cumsum(np.bincount(row[start], minlength=len(counts)))[:-1]
                cols[5] += np.split(tx.signed(rare[start]), cut)
                cols[6] += np.split(times, cut)
            scores = np.concatenate(cols[0]) if cols[0] else np.empty((0, len(strengths)))
            counts, base, known = (np.concatenate(c) if c else np.empty(0) for c in cols[2:5])
            size = np.arange(len(scores) + 1, dtype=np.int32) * len(strengths)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(size), pa.array(scores.ravel())),
                    pa.array(cols[1], pa.list_(pa.float64())), pa.array(counts.astype(np.int64)), pa.array(base), pa.array(known.astype(np.int64)),
                    pa.array(cols[5], pa.list_(pa.int64())), pa.array(cols[6], pa.list_(pa.int32())),
                ], ["id", "key", "scores", "trained", "n_tokens", "base", "known", "rare", "times"],
            )

    return run


def _with_copies(rows: DataFrame) -> DataFrame:
    """`rows` (`id`, `key`, `t`, `training`) with `copies`: of a training text how many there are of it, else 0."""
    spark = rows.sparkSession
    keyed = rows.withColumn("text_key", F.xxhash64(F.coalesce("t", F.lit(""))))
    folder = fresh_folder(spark, "lm-copies")
    keyed.where("training").groupBy("text_key").agg(F.count("*").alias("copies")).where("copies > 1").write.parquet(folder)
    # Read from files, so Spark knows their size when it picks the join.
    copied = spark.read.schema("text_key bigint, copies bigint").parquet(folder)
    copies = F.when(F.col("training"), F.coalesce("copies", F.lit(1))).otherwise(0).alias("copies")
    return keyed.join(copied, "text_key", "left").select("id", "key", "t", copies)


def _read(rows: DataFrame, model: Model, strengths: tuple[float, ...]) -> DataFrame:
    """What `_reader` finds of the rows (`id`, `key`, `t`, `copies`): each text asks the filter once."""
    spark = rows.sparkSession
    words = spark.read.schema("name bigint, n bigint").parquet(model.words)
    common = words.where(F.col("n") * FREQUENT >= F.lit(model.n)).toArrow()
    names = common["name"].to_numpy().view(np.uint64)
    order = np.argsort(names)
    frequent = spark.sparkContext.broadcast((names[order], common["n"].to_numpy()[order]))
    *_, (last, sent) = _levels(rows, model)
    kind = (
        f"id {rows.schema['id'].dataType.simpleString()}, key bigint, scores array<double>, trained array<double>, n_tokens bigint, "
        "base double, known bigint, rare array<bigint>, times array<int>"
    )
    folder = fresh_folder(spark, "lm-scored")
    last.mapInArrow(_reader(sent, model, frequent, strengths), kind).write.parquet(folder)
    sent.unpersist()
    return spark.read.schema(kind).parquet(folder)


def _likeliest(read: DataFrame) -> float:
    """The strength under which all training texts are likeliest without the occurrences of a token in its text and its copies."""
    totals = read.agg(*[F.sum(F.get("trained", F.lit(k))) for k in range(len(STRENGTHS))]).first()
    return max(zip(totals, STRENGTHS, strict=True), key=lambda x: x[0])[1] if totals[0] is not None else STRENGTHS[3]


def _keyed(docs: DataFrame, training: Column, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("t"), training.alias("training"))


def train_and_score(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", segment_names: int = SEGMENT_NAMES, round_bytes: int = ROUND_BYTES
) -> DataFrame:
    """As `score` of all `docs` by the model of those that `training` names; every text asks the filter once for both.

    Null and empty texts are texts of the end alone.
    """
    rows = _keyed(docs, training, id_col, text_col)
    model = _filled(rows.where("training").select("t"), segment_names, round_bytes)
    read = _read(_with_copies(rows), model, STRENGTHS)
    model.strength = _likeliest(read)
    return _summed(read.withColumn("score", F.get("scores", F.lit(STRENGTHS.index(model.strength)))), model, id_col)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score` of every row; a null text is empty.

    Repeated rows get a row each. Without training texts every word has probability one.
    """
    rows = _keyed(docs, F.lit(False), id_col, text_col).select("id", "key", "t", F.lit(0).cast("bigint").alias("copies"))
    read = _read(rows, model, (model.strength,))
    return _summed(read.withColumn("score", F.get("scores", F.lit(0))), model, id_col)


def _summed(scored: DataFrame, model: Model, id_col: str) -> DataFrame:
    """The result rows, with the base score of words that are not frequent by a join."""
    spark = scored.sparkSession
    words = spark.read.schema("name bigint, n bigint").parquet(model.words)
    is_common = F.col("n") * FREQUENT >= F.lit(model.n)
    # Equal rows have equal words, so one of each key is enough.
    rare = scored.where(F.size("rare") > 0).select("key", F.explode(F.arrays_zip("rare", "times")).alias("w"))
    rare = rare.select("key", F.col("w.rare").alias("name"), F.col("w.times").alias("times"))
    joined = rare.join(words.where(~is_common), "name", "left")
    whole = model.n + 0.1 * (model.v + 1)
    each = F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 0.1) - math.log10(whole))
    copies = scored.groupBy("key").agg(F.count("*").alias("copies"))
    summed = joined.groupBy("key").agg(
        F.sum(each).alias("rare_base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    summed = copies.join(summed, "key", "left")
    done = scored.drop("rare", "times", "scores", "trained").join(summed, "key")
    return done.select(
        F.col("id").alias(id_col), "n_tokens",
        (F.col("known") + F.coalesce(F.expr("rare_known div copies"), F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("rare_base") / F.col("copies"), F.lit(0.0))).alias("base_score"), "score",
    )


