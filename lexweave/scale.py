"""Skew-safe building blocks shared by the operators.

A key may own a third of all rows, so nothing here sorts or collects a whole key
in one task. Ordered logic runs per (key, block), where a block is a slice of
the ordering column (a calendar month, a run of line numbers). One small summary
row per (key, block) carries the state from block to block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key. `row_number() = 1` lets Spark drop the rest before the shuffle."""
    return top_per_key(df, keys, order, 1, "_rn").drop("_rn")


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank"
) -> DataFrame:
    """The first `k` rows of each key with their rank."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def sequence_in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    *,
    number: str | None = None,
    totals: dict[str, Column] | None = None,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
) -> DataFrame:
    """Row numbers, running totals and neighbours over a key's order, one block at a time.

    `block` must not decrease along `order`. `totals` maps output name to the summed
    expression (inclusive), `previous`/`following` map output name to the column whose
    neighbouring value is wanted. `order` must be unique within a key.
    """
    totals, previous, following = totals or {}, previous or {}, following or {}
    keyed = df.withColumn("_block", block)
    for name, expr in totals.items():
        keyed = keyed.withColumn(f"_t_{name}", expr)
    order_struct = F.struct(*order)

    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(f"_t_{name}").alias(f"_s_{name}") for name in totals]
    if previous:
        aggs.append(F.max_by(F.struct(*[F.col(c).alias(n) for n, c in previous.items()]), order_struct).alias("_last"))
    if following:
        aggs.append(F.min_by(F.struct(*[F.col(c).alias(n) for n, c in following.items()]), order_struct).alias("_first"))
    summary = keyed.groupBy(*keys, "_block").agg(*aggs)

    across = W.partitionBy(*keys).orderBy("_block")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before")]
    carried += [F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s_{n}_before") for n in totals]
    if previous:
        carried.append(F.lag("_last").over(across).alias("_last_before"))
    if following:
        carried.append(F.lead("_first").over(across).alias("_first_after"))
    summary = summary.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_k_block"), *carried)

    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = [F.row_number().over(inside).alias("_rn")]
    local += [F.sum(f"_t_{n}").over(upto).alias(f"_r_{n}") for n in totals]
    local += [F.lag(c).over(inside).alias(f"_p_{n}") for n, c in previous.items()]
    local += [F.lead(c).over(inside).alias(f"_f_{n}") for n, c in following.items()]
    if following:
        local.append((F.lead(F.lit(1)).over(inside).isNull()).alias("_is_last"))
    rows = keyed.select("*", *local)

    on = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_block") == F.col("_k_block")]
    joined = rows.join(summary, on, "left")
    out = [F.col(c) for c in df.columns]
    if number:
        out.append((F.col("_rn") + F.col("_n_before")).cast("bigint").alias(number))
    out += [(F.col(f"_r_{n}") + F.col(f"_s_{n}_before")).alias(n) for n in totals]
    out += [
        F.when(F.col("_rn") == 1, F.col(f"_last_before.{n}")).otherwise(F.col(f"_p_{n}")).alias(n) for n in previous
    ]
    out += [
        F.when(F.col("_is_last"), F.col(f"_first_after.{n}")).otherwise(F.col(f"_f_{n}")).alias(n) for n in following
    ]
    return joined.select(*out)


def last_known_in_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    values: dict[str, Column],
    include_current: bool = True,
    per_key: DataFrame | None = None,
) -> DataFrame:
    """For each name, the last non-null value up to (or only before) each row of a key's order.

    `per_key`, at most a row a key, adds its other columns to the rows of the key.
    """
    # Rows without a place in the order come first, in a block of their own.
    keyed = df.withColumn("_block", F.coalesce(block, F.lit(-(2**31)).cast("int")))
    for name, value in values.items():
        keyed = keyed.withColumn(f"_v_{name}", value)

    def last_in_block(name: str) -> Column:
        v = F.col(f"_v_{name}")
        return F.max_by(v, F.when(v.isNotNull(), F.struct(*order))).alias(f"_l_{name}")

    summary = keyed.groupBy(*keys, "_block").agg(*[last_in_block(n) for n in values])
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(*keys, "_block", *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values])
    added = []
    if per_key is not None:
        carried = carried.join(per_key, list(keys), "left")
        added = [c for c in per_key.columns if c not in keys]
    carried = carried.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_block": "_k_block"})
    end = W.currentRow if include_current else -1
    upto = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, end)
    rows = keyed.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(upto).alias(f"_h_{n}") for n in values])
    on = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_block") == F.col("_k_block")]
    return rows.join(carried, on, "left").select(
        *[F.col(c) for c in df.columns], *[F.coalesce(f"_h_{n}", f"_c_{n}").alias(n) for n in values], *added
    )


#: Rows of a side of a tile, and pairs of a task, in a join that makes many more pairs than it has rows.
TILE_ROWS, TASK_PAIRS = 1024, 4_000_000


def tiled_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on `key` whose tasks grow in number with the pairs, where few keys have many rows on both sides.

    The rows of a key are cut into slices by their content, and each two slices meet in a tile that is dealt by itself. Bytes tell
    nothing here: both sides are small beside what they make. Both are read twice.
    """
    counts = [side.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for side, n in ((left, "_nl"), (right, "_nr"))]
    sizes = counts[0].join(counts[1], key)
    pairs = sizes.agg(F.sum(F.col("_nl").cast("double") * F.col("_nr"))).first()[0] or 0
    if pairs <= TASK_PAIRS:
        return left.join(right, key)
    slices = [F.ceil(F.col(n) / TILE_ROWS).cast("int").alias(s) for n, s in (("_nl", "_sl"), ("_nr", "_sr"))]
    slices, n = sizes.select(key, *slices), -int(-pairs // TASK_PAIRS)

    def dealt(side: DataFrame, own: str, other: str, names: list[str]) -> DataFrame:
        slice_no = F.pmod(F.xxhash64(*side.columns), F.col(own)).cast("int").alias(names[0])
        opposite = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(names[1])
        return side.join(slices, key).select(*side.columns, slice_no, opposite).repartition(n, key, "_i", "_j")

    return dealt(left, "_sl", "_sr", ["_i", "_j"]).join(dealt(right, "_sr", "_sl", ["_j", "_i"]), [key, "_i", "_j"]).drop("_i", "_j")


QUERY_BATCH = 2000


def query_batches(queries: DataFrame, key: str, size: int = QUERY_BATCH) -> list[DataFrame]:
    """Queries in batches of about `size`, so what each scan of the corpus carries stays bounded.

    The usual case is one batch; every further batch costs another scan, never a lost query.
    """
    n = -(-queries.count() // size)
    if n <= 1:
        return [queries]
    return [queries.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


#: Rows of a task with costly work a row.
SPREAD_ROWS = 50_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Use every core for costly per-row work, with tasks of about `rows` rows if given.

    Small columns can make large texts, so neither the splits of a table nor the bytes of a shuffle say how long a task is.
    A plain scan with enough splits, as every large one has without `rows`, passes unchanged.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        n = max(n, -(-df.count() // rows))
        # To ask for the partitions of more than a scan runs it.
        if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
            return df.repartition(n)
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def month_block(ts: Column | str) -> Column:
    """Calendar month number, the usual block of a date or timestamp order."""
    return F.year(ts) * 12 + F.month(ts)


def quarter_block(ts: Column | str) -> Column:
    """Calendar quarter number, where a key has too few rows for months to be worth a summary row each."""
    return F.year(ts) * 4 + F.quarter(ts)


def position_block(pos: Column | str, size: int = 4096) -> Column:
    """Block of an integer position."""
    return F.floor(F.col(pos) / size if isinstance(pos, str) else pos / size)
