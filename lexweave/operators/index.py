"""A segmented inverted index of search entries and its reader.

A segment holds the entries of one run of a task's input: no shuffle builds it. In a
segment a word leads to its postings, the entries that hold it in ascending order with
their counts, in blocks of `BLOCK` entries with the block's highest count. The words of a segment, and its titles and
identifiers, have a dictionary of their three-letter pieces, so that "occurs
inside a word" becomes piece, words, postings, without the text.

A query is answered segment by segment. Entries must hold one of its folded words, so
only the postings of those make candidates, and only in blocks whose highest
counts can still reach the k-th best score so far; the query's other words are then added
in falling weight, and candidates that cannot reach it any more are left out. The k-th best score
goes on from segment to segment of a task. What a text alone can tell, whether it holds the whole query, is
asked only of entries that hold all its words and may still be among the best.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed, text as T
from ..scale import query_batches, top_per_key
from ..session import durable

#: A segment ends with the entry that passes one of these.
SEGMENT_ENTRIES, SEGMENT_CHARS = 4096, 4 << 20
BLOCK = 128
WHOLE, TITLE, IDENTIFIER, PER_POSITION = 3.0, 2.0, 4.0, 0.1
#: Scores are compared with this much room, as they are rounded later.
ROOM = 1e-5

_WORD = regex.compile(r"[\p{L}\p{N}_Ͱ-Ͽ]+")
_FOLDED = regex.compile(r"[\p{L}\p{N}_]+")
_FOLD = str.maketrans(fixed.FOLD_FROM, fixed.FOLD_TO)
_IDS = ("ref_article", "ref_law", "ecli", "case_number")
_INTS = (
    "post_at", "posts", "tfs", "block_at", "blocks", "tops", "word_gram_at", "word_gram_to", "fold_at", "fold_words", "fold_counts",
    "field_gram_at", "field_gram_to", "field_at", "field_entries", "field_weights",
)
_LONGS = ("word_grams", "field_grams")
_STRINGS = ("kinds", "refs", "words", "folds", "fields")
SEGMENT = ", ".join(
    [f"{c} array<string>" for c in _STRINGS] + [f"{c} array<bigint>" for c in _LONGS] + [f"{c} array<int>" for c in _INTS]
)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All integers of the half-open ranges, one range behind another."""
    size = ends - starts
    return np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _grouped(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of `n` groups begins among ascending group numbers."""
    return np.searchsorted(keys, np.arange(n + 1)).astype(np.int32)


class Pieces:
    """Which of some strings contain a given one, by the runs of up to three characters in them."""

    def __init__(self, strings: list[str], keys: np.ndarray, at: np.ndarray, to: np.ndarray):
        self.strings, self.keys, self.at, self.to = strings, keys, at, to

    @staticmethod
    def built(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ascending pieces, where the strings of each begin, and the strings of all."""
        c = np.frombuffer("".join(s + "\0\0" for s in strings).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        of = np.repeat(np.arange(len(strings)), np.array([len(s) + 2 for s in strings], np.int64))
        if not len(c):
            return np.empty(0, np.int64), np.zeros(1, np.int32), np.empty(0, np.int32)
        key = c.copy() << 42
        key[:-1] |= c[1:] << 21
        key[:-2] |= c[2:]
        key, of = key[c != 0], of[c != 0]
        order = np.lexsort((of, key))
        key, of = key[order], of[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
        key, of = key[new], of[new]
        keys, first = np.unique(key, return_index=True)
        return keys, np.r_[first, len(key)].astype(np.int32), of.astype(np.int32)

    def holding(self, part: str) -> np.ndarray:
        """The strings that contain `part`, ascending."""
        c = [ord(x) for x in part]
        if not c:
            return np.arange(len(self.strings))
        if len(c) < 3:
            low = c[0] << 42 | (c[1] << 21 if len(c) == 2 else 0)
            i, j = np.searchsorted(self.keys, [low, low + (1 << (21 if len(c) == 2 else 42))])
            return np.unique(self.to[self.at[i] : self.at[j]])
        grams = np.array([a << 42 | b << 21 | d for a, b, d in zip(c, c[1:], c[2:])], np.int64)
        i = np.searchsorted(self.keys, grams)
        if not len(self.keys) or (self.keys[np.minimum(i, len(self.keys) - 1)] != grams).any():
            return np.empty(0, np.int64)
        rarest = i[np.argmin(self.at[i + 1] - self.at[i])]
        found = self.to[self.at[rarest] : self.at[rarest + 1]]
        if len(c) == 3:
            return found
        return found[[part in self.strings[w] for w in found.tolist()]]


def _counted(text: str) -> Counter:
    if len(text) <= SEGMENT_CHARS:
        return Counter(_WORD.findall(text))
    return Counter(m.group() for m in _WORD.finditer(text))


def _folded(word: str) -> list[str]:
    folded = word if word.isascii() else word.translate(_FOLD)
    return [folded] if folded.isascii() or folded.isalnum() else _FOLDED.findall(folded)


class _Segment:
    """Entries being gathered."""

    def __init__(self):
        self.kinds, self.refs, self.chars = [], [], 0
        self.words: dict[str, int] = {}
        self.fields: dict[str, int] = {}
        self.pairs: list[tuple[int, int, int]] = []
        self.named: list[tuple[int, int, int]] = []

    def add(self, kind: str, ref: str, text: str, title: str, ids: list[str]) -> None:
        at = len(self.refs)
        self.kinds.append(kind)
        self.refs.append(ref)
        self.chars += len(text)
        words = self.words
        self.pairs += [(words.setdefault(w, len(words)), at, n) for w, n in _counted(text).items()]
        for field, weight in [(title, TITLE), *[(x, IDENTIFIER) for x in ids if x is not None]]:
            if field:
                self.named.append((self.fields.setdefault(field, len(self.fields)), at, int(weight)))

    def full(self, most: int) -> bool:
        return len(self.refs) >= most or self.chars >= SEGMENT_CHARS

    def row(self) -> dict:
        word, entry, tf = (np.array(x, np.int64) for x in (zip(*self.pairs) if self.pairs else ([], [], [])))
        order = np.argsort(word, kind="stable")
        word, entry, tf = word[order], entry[order], tf[order]
        new = np.ones(len(word), bool)
        new[1:] = (word[1:] != word[:-1]) | (entry[1:] // BLOCK != entry[:-1] // BLOCK)
        first = np.flatnonzero(new)
        folds: dict[str, list[tuple[int, int]]] = {}
        for w, i in self.words.items():
            parts = _folded(w)
            for f in dict.fromkeys(parts):
                folds.setdefault(f, []).append((i, parts.count(f)))
        terms = sorted(folds)
        listed = [x for f in terms for x in folds[f]]
        field, of, weight = (np.array(x, np.int64) for x in (zip(*sorted(self.named)) if self.named else ([], [], [])))
        made = {"kinds": self.kinds, "refs": self.refs, "words": list(self.words), "folds": terms, "fields": list(self.fields)}
        made |= zip(("word_grams", "word_gram_at", "word_gram_to"), Pieces.built(made["words"]))
        made |= zip(("field_grams", "field_gram_at", "field_gram_to"), Pieces.built(made["fields"]))
        return made | {
            "post_at": _grouped(word, len(self.words)), "posts": entry, "tfs": tf, "block_at": _grouped(word[first], len(self.words)),
            "blocks": entry[first] // BLOCK, "tops": np.maximum.reduceat(tf, first) if len(first) else tf,
            "fold_at": np.cumsum([0, *[len(folds[f]) for f in terms]]), "fold_words": np.array([w for w, _ in listed], np.int64),
            "fold_counts": np.array([n for _, n in listed], np.int64), "field_at": _grouped(field, len(self.fields)),
            "field_entries": of, "field_weights": weight,
        }


def _written(segment: _Segment) -> pa.RecordBatch:
    row = segment.row()
    kind = [(c, pa.string()) for c in _STRINGS] + [(c, pa.int64()) for c in _LONGS] + [(c, pa.int32()) for c in _INTS]
    columns = []
    for c, t in kind:
        values = pa.array(row[c], t)
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
    return pa.RecordBatch.from_arrays(columns, [c for c, _ in kind])


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held = _Segment()
    for batch in batches:
        kinds, refs, texts, titles, ids = batch.columns
        for i in range(batch.num_rows):
            held.add(kinds[i].as_py(), refs[i].as_py(), texts[i].as_py(), titles[i].as_py(), ids[i].as_py())
            if held.full(most):
                yield _written(held)
                held = _Segment()
    if held.refs:
        yield _written(held)


def write_index(entries: DataFrame, folder: str, most: int = SEGMENT_ENTRIES) -> DataFrame:
    """The index of `entries` (kind, canonical_ref, title, body and four identifiers), written to `folder` and read back.

    `most` bounds the entries of a segment. Null bodies and titles are empty. An entry that comes twice is found twice.
    """
    rows = entries.select(
        "kind", "canonical_ref", F.lower(F.coalesce("body", F.lit(""))).alias("text"), F.lower(F.coalesce("title", F.lit(""))).alias("title"),
        F.array(*[F.lower(F.col(c)) for c in _IDS]).alias("ids"),
    )
    # A row group each: the writer would else hold a hundred segments before it looks at their size, and the reader as many.
    rows.mapInArrow(lambda b: _segments(b, most), SEGMENT).write.option("parquet.block.row.count.limit", "1").parquet(folder)
    return read_index(entries.sparkSession, folder)


def read_index(spark, folder: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(folder)


class _Reader:
    """One segment and the entries that its words and fields lead to, each looked up once."""

    def __init__(self, row: dict[str, pa.Array]):
        self.a = {c: row[c].to_numpy(zero_copy_only=False) for c in (*_INTS, *_LONGS)}
        self.kinds, self.refs, words, folds, fields = (row[c].to_pylist() for c in _STRINGS)
        self.n, self.n_blocks = len(self.refs), -(-len(self.refs) // BLOCK)
        self.words = Pieces(words, self.a["word_grams"], self.a["word_gram_at"], self.a["word_gram_to"])
        self.fields = Pieces(fields, self.a["field_grams"], self.a["field_gram_at"], self.a["field_gram_to"])
        self.folds = {f: i for i, f in enumerate(folds)}
        self._present: dict[str, np.ndarray] = {}

    def present(self, token: str) -> np.ndarray:
        """Which entries have a word that contains `token`."""
        if token not in self._present:
            w = self.words.holding(token)
            out = np.zeros(self.n, bool)
            out[self.a["posts"][_ranges(self.a["post_at"][w], self.a["post_at"][w + 1])]] = True
            self._present[token] = out
        return self._present[token]

    def named(self, query: str) -> np.ndarray | None:
        """What titles and identifiers that contain the query add to each entry."""
        f = self.fields.holding(query)
        if not len(f):
            return None
        at = _ranges(self.a["field_at"][f], self.a["field_at"][f + 1])
        out = np.zeros(self.n)
        np.add.at(out, self.a["field_entries"][at], self.a["field_weights"][at])
        return out

    def positions(self, folds: list[str], least: float) -> np.ndarray:
        """Positions of the folded words in each entry, of blocks that may hold `least` of them."""
        lists = [self.folds[f] for f in folds if f in self.folds]
        out = np.zeros(self.n)
        if not lists:
            return out
        at = _ranges(self.a["fold_at"][lists], self.a["fold_at"][np.array(lists) + 1])
        words, times = self.a["fold_words"][at], self.a["fold_counts"][at]
        most = np.zeros(self.n_blocks)
        starts, ends = self.a["block_at"][words], self.a["block_at"][words + 1]
        b = _ranges(starts, ends)
        np.add.at(most, self.a["blocks"][b], self.a["tops"][b] * np.repeat(times, ends - starts))
        open_ = (most > 0) & (most >= least)
        starts, ends = self.a["post_at"][words], self.a["post_at"][words + 1]
        p = _ranges(starts, ends)
        entry, count = self.a["posts"][p], self.a["tfs"][p] * np.repeat(times, ends - starts)
        if not open_.all():
            mine = open_[entry // BLOCK]
            entry, count = entry[mine], count[mine]
        np.add.at(out, entry, count)
        return out


def _answers(batches: Iterator[pa.RecordBatch], shared, k: int | None) -> Iterator[pa.RecordBatch]:
    queries, id_type = shared.value
    best = [np.empty(0)] * len(queries)

    def floor(i: int) -> float:
        return best[i][-1] - ROOM if k is not None and len(best[i]) == k else -np.inf

    for batch in batches:
        for r in range(batch.num_rows):
            reader = _Reader({c: batch.column(j)[r].values for j, c in enumerate(batch.schema.names)})
            out = []
            for i, (query_id, q, weights, folds) in enumerate(queries):
                total = sum(n for _, n in weights)
                need, alone = (2 if total >= 2 else 0), len(weights) == 1 and weights[0][0] == q
                extra = reader.named(q)
                room = total + WHOLE + (extra.max() if extra is not None else 0.0)
                hits = reader.positions(folds, (floor(i) - room) / PER_POSITION)
                cand = np.flatnonzero(hits > 0)
                if not len(cand):
                    continue
                known = PER_POSITION * hits[cand] + (extra[cand] if extra is not None else 0.0)
                parts, left = np.zeros(len(cand)), float(total)
                for token, n in weights:
                    parts += n * reader.present(token)[cand]
                    left -= n
                    if len(cand) > 64:
                        stay = known + parts + left + WHOLE >= floor(i)
                        if not stay.all():
                            cand, known, parts = cand[stay], known[stay], parts[stay]
                stay = parts >= need
                cand, known, parts = cand[stay], known[stay], parts[stay]
                whole = parts == total
                sure = known + parts + np.where(whole & alone, WHOLE, 0.0)
                if k is not None and len(sure):
                    both = np.r_[best[i], sure]
                    best[i] = -np.sort(-(both if len(both) <= k else np.partition(both, len(both) - k)[-k:]))
                    stay = sure + np.where(whole & (not alone), WHOLE, 0.0) >= floor(i)
                    cand, parts, whole = cand[stay], parts[stay], whole[stay]
                if len(cand):
                    out.append((query_id, cand, parts, hits[cand], extra[cand] if extra is not None else np.zeros(len(cand)), whole, alone))
            yield _found(reader, out, id_type)


def _found(reader: _Reader, out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    def joined(i: int, kind: type) -> np.ndarray:
        return np.concatenate([x[i] for x in out]).astype(kind) if out else np.empty(0, kind)

    cand, whole = joined(1, np.int64), joined(5, bool)
    sizes = [len(x[1]) for x in out]
    alone = np.repeat(np.array([x[6] for x in out], bool), sizes)
    ids = pa.array([x[0] for x in out], id_type).take(pa.array(np.repeat(np.arange(len(out)), np.array(sizes, np.int64))))
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array([reader.kinds[c] for c in cand.tolist()], pa.string()), pa.array([reader.refs[c] for c in cand.tolist()], pa.string()),
            pa.array(joined(2, float)), pa.array(joined(3, float)), pa.array(joined(4, float)), pa.array(whole & alone), pa.array(whole & ~alone),
        ], ["query_id", "kind", "canonical_ref", "overlap", "hits", "bonus", "phrase", "ask"],
    )


def _asked(queries: DataFrame) -> DataFrame:
    """`query_id`, the query `q`, its words with their number and its folded words; queries without words are left out."""
    asked = queries.select("query_id", T.strip(F.lower("query")).alias("q")).withColumn("tokens", T.tokens("q"))
    folds = F.array_distinct(F.flatten(F.transform("tokens", lambda t: T.folded_tokens(t))))
    return asked.withColumn("folds", folds).filter(F.size("tokens") > 0)


def _candidates(asked: DataFrame, index: DataFrame, k: int | None) -> DataFrame:
    rows = asked.collect()
    queries = []
    for r in rows:
        # The heaviest words first, then the longest, which are in the fewest entries.
        weights = sorted(Counter(r["tokens"]).items(), key=lambda x: (-x[1], -len(x[0]), x[0]))
        queries.append((r["query_id"], r["q"], weights, r["folds"]))
    shared = index.sparkSession.sparkContext.broadcast((queries, to_arrow_type(asked.schema["query_id"].dataType)))
    kind = f"query_id {asked.schema['query_id'].dataType.simpleString()}, kind string, canonical_ref string"
    more = "overlap double, hits double, bonus double, phrase boolean, ask boolean"
    return index.mapInArrow(lambda b: _answers(b, shared, k), f"{kind}, {more}")


def indexed_scores(queries: DataFrame, entries: DataFrame, index: DataFrame, k: int | None) -> DataFrame:
    """(query_id, kind, canonical_ref, score, phrase) of the entries that may be among the best `k` of a query, or of all.

    Queries travel in batches of bounded size. Only `entries` whose text is still to be asked are read again. With `k`
    the candidates, a few k rows a query and task, are kept in the shared folder, as they are read several times.
    """
    asked = _asked(queries)
    parts = [_candidates(b, index, k) for b in query_batches(asked, "query_id")]
    rows = reduce(DataFrame.unionByName, parts)
    rows = durable(rows) if k is not None else rows
    plain = F.col("overlap") + F.col("hits") * PER_POSITION + F.col("bonus")
    rows = rows.withColumn("plain", plain + F.when(F.col("phrase"), WHOLE).otherwise(0.0))
    if k is not None:
        last = top_per_key(rows, ["query_id"], [F.desc("plain")], k).filter(F.col("rank") == k)
        last = last.select("query_id", (F.col("plain") - ROOM).alias("floor"))
        reach = F.col("plain") + F.when(F.col("ask"), WHOLE).otherwise(0.0)
        rows = rows.join(last, "query_id", "left").filter(F.col("floor").isNull() | (reach >= F.col("floor"))).drop("floor")
    texts = entries.select("kind", "canonical_ref", F.lower("body").alias("text"))
    held = rows.filter("ask").join(texts, ["kind", "canonical_ref"], "left").join(asked.select("query_id", "q"), "query_id")
    held = held.withColumn("phrase", F.coalesce(F.contains("text", "q"), F.lit(False))).drop("text", "q")
    both = rows.filter("NOT ask").unionByName(held)
    bonus = F.col("bonus") + F.when(F.col("phrase"), WHOLE).otherwise(0.0)
    score = F.round(F.col("overlap") + F.col("hits") * PER_POSITION + bonus, 6).alias("score")
    return both.select("query_id", "kind", "canonical_ref", score, "phrase")
