"""Near-duplicate texts by SimHash, MinHash banding and exact Jaccard similarity of five-word shingles.

Texts whose fingerprints the index of `simhash` links are proposed. SimHash alone
cannot find similarity 0.8: of 64 bits such texts differ in about ten,
far more than a block index of fingerprints allows for. So whole texts are also
units, with words between blanks as SimHash has them, and are compared as
`passages` compares its units: banded, verified exactly, joined into components.
What fingerprints propose is verified in the same way.
Texts of fewer words than a shingle are near only to texts of the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable, fresh_folder
from . import passages as ps, simhash as sh, text as tx
from .bitmap import may_hold

_NO_WORDS = np.uint64(0)


def _whole(data: np.ndarray, offsets: np.ndarray) -> tuple[ps.Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts, begin and end of each text among them, and its name."""
    w = ps.Words(data, offsets, tx.BLANK_SEPARATED)
    begin, end = tx.groups(w.counts)
    names = np.full(len(begin), _NO_WORDS)
    some = end > begin
    if some.any():
        names[some] = w.spans(begin[some], end[some])
    return w, begin, end, names


def _texts(batches: Iterator[pa.RecordBatch], bands: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in tx.texts(batch, "t"):
            w, begin, end, names = _whole(data, offsets)
            long = end - begin >= ps.SHINGLE_WORDS
            size = np.zeros(j - i, np.int64)
            values = pa.array([], pa.int64())
            if long.any():
                lists = ps.unit_bands(w, begin[long], end[long], names[long], bands, ps.BAND_ROWS, threshold)
                size[long], values = np.diff(lists.offsets.to_numpy()), lists.values
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), values)
            raw = data.tobytes()
            prints = [sh.simhash(raw[offsets[k] : offsets[k + 1]]) if long[k] else 0 for k in range(j - i)]
            fp = pa.array(np.array(prints, np.uint64).view(np.int64), mask=~long)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(tx.signed(names)), fp, lists], ["id", "h", "unit", "fp", "bands"]
            )


def _shingles(batches: Iterator[pa.RecordBatch], asked) -> Iterator[pa.RecordBatch]:
    """Sorted distinct shingles of the texts that may be asked for."""
    for batch in batches:
        for _, _, data, offsets in tx.texts(batch, "t"):
            w, begin, end, names = _whole(data, offsets)
            names, first = np.unique(names, return_index=True)
            mine = (end[first] - begin[first] >= ps.SHINGLE_WORDS) & may_hold(asked.value, names)
            names, begin, end = names[mine], begin[first[mine]], end[first[mine]]
            if not len(names):
                continue
            every, counts = ps.unit_shingles(w, begin, end)
            sets = [tx.signed(np.unique(x)) for x in np.split(every, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(names)), pa.array(sets, pa.list_(pa.int64()))], ["unit", "shingles"])


def _proposed(units: DataFrame) -> DataFrame:
    """`a`, `b`: the least unit of each fingerprint with its other units, and with that of a fingerprint linked to it."""
    prints = units.where("fp IS NOT NULL").select("fp", "unit").distinct()
    first = durable(prints.groupBy("fp").agg(F.min("unit").alias("first")))
    equal = prints.join(first, "fp").where("unit != first").select(F.col("first").alias("a"), F.col("unit").alias("b"))
    links = sh.near_links(first.select("fp")).distinct().withColumnsRenamed({"a": "x", "b": "y"})
    links = links.join(first.select(F.col("fp").alias("x"), F.col("first").alias("a")), "x")
    links = links.join(first.select(F.col("fp").alias("y"), F.col("first").alias("b")), "y")
    return durable(equal.union(links.select("a", "b")))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = ps.THRESHOLD, room: int = ps.ROOM
) -> DataFrame:
    """One row of each component of texts: the smallest id, then the smallest text hash; of repeated rows one.

    Null ids come last. Texts without words, null ones too, are one component.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "near-texts")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), text.alias("t"))
    bands = ps.tuned_bands(threshold)
    kind = f"id {docs.schema[id_col].dataType.simpleString()}, h bigint, unit bigint, fp bigint, bands array<bigint>"
    rows.mapInArrow(lambda b: _texts(b, bands, threshold), kind).write.parquet(f"{folder}/units")
    units = spark.read.schema(kind).parquet(f"{folder}/units")

    def sets(asked: np.ndarray) -> DataFrame:
        held = spark.sparkContext.broadcast(asked)
        return rows.select("t").mapInArrow(lambda b: _shingles(b, held), "unit bigint, shingles array<bigint>")

    parts = ps.linked(units, sets, folder, threshold, room, _proposed(units))
    member = units.select("id", "h", "unit").join(parts, units["unit"] == parts["node"], "left")
    first = F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("h").alias("h")))
    best = member.groupBy(F.coalesce("component", "unit").alias("root")).agg(first.alias("b"))
    best = best.select(F.col("b.i").alias("id"), F.col("b.h").alias("hash")).distinct()
    # Names of their own for all columns, so that none of the caller's can clash.
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at, key = (f"c{docs.columns.index(c)}" for c in (text_col, id_col))
    own = own.withColumn("text_hash", F.xxhash64(F.coalesce(F.col(at), F.lit(""))))
    kept = own.join(best, own["text_hash"].eqNullSafe(best["hash"]) & own[key].eqNullSafe(best["id"]), "left_semi")
    return kept.dropDuplicates([key, "text_hash"]).drop("text_hash").toDF(*docs.columns)
