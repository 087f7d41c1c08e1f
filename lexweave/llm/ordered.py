"""Rows numbered within their key by one range sort, however many rows a key has.

The rows are dealt by ranges of (key, order), so a key of a third of all rows spans
many tasks. Each task numbers the runs of a key it holds; only the first run of a
task can continue one of the task before, so one record a task is carried over.
Running sums of hashed elements are carried alike: element i counts with the i-th
power of an odd base modulo 2^64, which lets a sum be moved along by one product.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Odd bases of the two running sums.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MASK = 2**64 - 1


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """`base` to each exponent modulo 2^64; negative exponents are powers of the inverse."""
    out = np.ones(len(exponents), np.uint64)
    size = np.abs(exponents).astype(np.uint64)
    for sign in (1, -1):
        mine = exponents * sign > 0
        square = pow(base, sign, 2**64)
        left = np.where(mine, size, np.uint64(0))
        while left.any():
            out[(left & np.uint64(1)) == 1] *= np.uint64(square)
            left >>= np.uint64(1)
            square = square * square & MASK
    return out


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def _number(batches: Iterator[pa.RecordBatch], key: str, hashes: Sequence[str]) -> Iterator[pa.RecordBatch]:
    last, count, sums = None, 0, [np.uint64(0)] * len(hashes)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(batch.schema.get_field_index(key))
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = last is None or keys[0] != last
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        at = np.arange(n)
        from_start = np.r_[at[starts], 0][run] if len(starts) else np.zeros(n, np.int64)
        lp = at - np.where(run >= 0, from_start, -count)
        columns = [*batch.columns, pa.array(lp)]
        carried = []
        for name, base, held in zip(hashes, BASES, sums, strict=False):
            value = longs(batch, name).view(np.uint64) * power(base, lp)
            total = np.cumsum(value, dtype=np.uint64)
            at_start = np.r_[(total - value)[starts], np.uint64(0)][run] if len(starts) else np.zeros(n, np.uint64)
            total = total - np.where(run >= 0, at_start, np.uint64(0)) + np.where(run >= 0, np.uint64(0), held)
            columns.append(pa.array(total.view(np.int64)))
            carried.append(total[-1])
        last, count, sums = keys[n - 1], int(lp[-1]) + 1, carried
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lp", *[f"l{i}" for i in range(len(hashes))]])


def _join(count: int, sums: Sequence[int], more: int, local: Sequence[int]) -> tuple[int, list[int]]:
    return count + more, [(s + pow(b, count, 2**64) * x) & MASK for s, x, b in zip(sums, local, BASES, strict=False)]


def numbered(rows: DataFrame, key: str, deal: Sequence[Column], order: Sequence[Column], folder: str, hashes: Sequence[str] = ()) -> DataFrame:
    """`rows` with `p`, the place in the order of its non-null `key` from 0, written to `folder` in that order.

    `deal` are the columns of the range partitions, a prefix of `order` in meaning; both begin with the key. With
    `hashes` (long columns) also `off`, `c0`.. and `l0`..: the running sum is c + base^off * l, see `running`.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*deal).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    more = "".join(f", l{i} bigint" for i in range(len(hashes)))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + f", lp bigint{more}"
    dealt.mapInArrow(lambda b: _number(b, key, hashes), kind).write.parquet(folder)
    dealt = spark.read.schema(kind).parquet(folder)

    end = F.struct("lp", *[f"l{i}" for i in range(len(hashes))])
    parts = dealt.groupBy("part").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(end, F.struct(key, "lp")).alias("end"))
    # One record a task of the sort.
    carries, held = [], None
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        continues = held is not None and held[0] == r["first"]
        if continues:
            carries.append((r["part"], r["first"], held[1], *[s - 2**64 if s >= 2**63 else s for s in held[2]]))
        here = r["end"]["lp"] + 1, [r["end"][f"l{i}"] & MASK for i in range(len(hashes))]
        whole = continues and r["first"] == r["last"]
        held = (r["last"], *(_join(held[1], held[2], *here) if whole else here))
    names = [f"c{i}" for i in range(len(hashes))]
    kind = f"_part int, _key {rows.schema[key].dataType.simpleString()}, off bigint" + "".join(f", {c} bigint" for c in names)
    carried = spark.createDataFrame(carries, kind)
    joined = dealt.join(F.broadcast(carried), (dealt["part"] == F.col("_part")) & (dealt[key] == F.col("_key")), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("off", *names)]
    out = joined.select(*[c for c in dealt.columns if c != "part"], *zero).withColumn("p", F.col("lp") + F.col("off")).drop("lp")
    return out if hashes else out.drop("off")


def running(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """The running sum of hash column `i` of rows from `numbered`."""
    shift = power(BASES[i], longs(batch, "off"))
    return longs(batch, f"c{i}").view(np.uint64) + shift * longs(batch, f"l{i}").view(np.uint64)
