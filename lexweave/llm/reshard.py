"""Resharding by minimum-cost flow.

Old shards hold bytes, new shards have capacities. A byte that stays in its shard
costs nothing, a byte that moves costs one; the flow of least cost says how many
bytes go from where to where. An old shard is a sequence of blocks of documents;
its flows cut that sequence into pieces, the piece that stays first. Only the
blocks that a cut falls into are looked into document by document.

The driver sees one number for every pair of old and new shard and the blocks
with a cut, never a list of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import durable

#: Documents of a block, about.
BLOCK_ROWS = 20_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from each supply to each capacity at least total cost; successive shortest paths.

    The capacities must hold the supplies.
    """
    if sum(capacity) < sum(supply):
        raise ValueError("the new capacities are smaller than what they must hold")
    o, n = len(supply), len(capacity)
    flow = [[0] * n for _ in range(o)]
    left, room = list(supply), list(capacity)
    while any(left):
        # Distances over old shards (0..o-1) and new shards (o..o+n-1) in the residual graph.
        far = float("inf")
        dist = [0 if left[i] else far for i in range(o)] + [far] * n
        came: list[int | None] = [None] * (o + n)
        changed = True
        while changed:
            changed = False
            for i in range(o):
                for j in range(n):
                    if dist[i] + cost[i][j] < dist[o + j]:
                        dist[o + j], came[o + j], changed = dist[i] + cost[i][j], i, True
                    if flow[i][j] and dist[o + j] - cost[i][j] < dist[i]:
                        dist[i], came[i], changed = dist[o + j] - cost[i][j], o + j, True
        end = min((o + j for j in range(n) if room[j]), key=lambda v: dist[v])
        path, v = [], end
        while came[v] is not None:
            path.append((came[v], v))
            v = came[v]
        most = min([left[v], room[end - o], *(flow[b][a - o] for a, b in path if a >= o)])
        for a, b in path:
            if a < o:
                flow[a][b - o] += most
            else:
                flow[b][a - o] -= most
        left[v] -= most
        room[end - o] -= most
    return flow


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most."""
    return [total // shards + (k < total % shards) for k in range(shards)]


@dataclass
class Plan:
    """`moves[i][j]`: bytes planned from old shard i to new shard j; `pieces[i]`: (begin byte, target, first row, first slot)."""

    blocks: int
    block_table: DataFrame
    olds: list[int]
    moves: list[list[int]]
    pieces: dict[int, list[tuple[int, int, int, int]]]

    @property
    def moved_bytes(self) -> int:
        return sum(b for i, row in zip(self.olds, self.moves, strict=True) for j, b in enumerate(row) if j != i)

    @property
    def affected(self) -> list[int]:
        """New shards whose files change: they get or lose bytes, or did not exist."""
        out = set(range(len(self.moves[0]) if self.moves else 0)) - set(self.olds)
        for i, row in zip(self.olds, self.moves, strict=True):
            for j, b in enumerate(row):
                if b and i != j:
                    out |= {i, j}
        return sorted(out)


def _measured(docs: DataFrame, old: Column, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns(
        {
            "_rs_old": F.coalesce(old.cast("int"), F.lit(0)),
            "_rs_size": F.octet_length(text).cast("bigint") + 1,
            "_rs_crc": F.crc32(text.cast("binary")),
            "_rs_key": F.xxhash64(F.col(id_col), text),
        }
    )


def _ordered(rows: DataFrame, plan_blocks: int, id_col: str) -> DataFrame:
    """Bytes before each row and its place inside its block."""
    block = rows.withColumn("_rs_block", F.pmod(F.col("_rs_key"), F.lit(plan_blocks)).cast("int"))
    w = W.partitionBy("_rs_old", "_rs_block").orderBy(F.col(id_col), "_rs_key")
    return block.withColumns(
        {
            "_rs_rn": F.row_number().over(w),
            "_rs_start": F.sum("_rs_size").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_rs_size"),
        }
    )


def plan(
    docs: DataFrame, old: Column, shards: int, id_col: str = "doc_id", text_col: str = "text",
    capacities: list[int] | None = None, block_rows: int = BLOCK_ROWS,
) -> Plan:
    """The transfers from the shards `old` (an integer column) to shards 0 to `shards` - 1; even capacities unless given."""
    rows = _measured(docs, old, id_col, text_col)
    totals = rows.groupBy("_rs_old").agg(F.sum("_rs_size").alias("bytes"), F.count("*").alias("rows")).orderBy("_rs_old").collect()
    olds, sizes = [r["_rs_old"] for r in totals], [r["bytes"] for r in totals]
    blocks = max(16, -(-sum(r["rows"] for r in totals) // block_rows))
    per = rows.groupBy("_rs_old", F.pmod(F.col("_rs_key"), F.lit(blocks)).cast("int").alias("_rs_block"))
    per = per.agg(F.sum("_rs_size").alias("bytes"), F.count("*").alias("rows"))
    before = W.partitionBy("_rs_old").orderBy("_rs_block").rowsBetween(W.unboundedPreceding, -1)
    table = durable(
        per.select(
            "_rs_old", "_rs_block", "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_rs_bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_rs_rows_before"),
        )
    )
    room = capacities or even(sum(sizes), shards)
    moves = min_cost_flow(sizes, room, [[int(i != j) for j in range(shards)] for i in olds])
    order = {i: sorted((j for j in range(shards) if moves[k][j]), key=lambda j: (j != i, j)) for k, i in enumerate(olds)}
    cuts = []
    for k, i in enumerate(olds):
        at = 0
        for j in order[i]:
            cuts.append((i, at, j))
            at += moves[k][j]
    inner = [(i, at, j) for i, at, j in cuts if at]
    first_row = {(i, j): 0 for i, _, j in cuts}
    if inner:
        spark = docs.sparkSession
        lines = F.broadcast(spark.createDataFrame(inner, "_rs_old int, cut bigint, target int"))
        hit = table.join(lines, "_rs_old").where("cut > _rs_bytes_before and cut <= _rs_bytes_before + bytes")
        hit = hit.select("_rs_old", "_rs_block", "_rs_bytes_before", "_rs_rows_before", "cut", "target")
        hit = spark.createDataFrame(hit.collect(), hit.schema)
        lean = rows.select("_rs_old", F.col(id_col), "_rs_size", "_rs_key")
        lean = lean.join(
            F.broadcast(hit.select("_rs_old", "_rs_block").distinct()),
            (lean["_rs_old"] == hit["_rs_old"]) & (F.pmod(lean["_rs_key"], F.lit(blocks)).cast("int") == hit["_rs_block"]), "left_semi",
        )
        inside = _ordered(lean, blocks, id_col).join(F.broadcast(hit), ["_rs_old", "_rs_block"])
        left = F.expr("2 * (_rs_start + _rs_bytes_before) + _rs_size < 2 * cut")
        for r in inside.groupBy("_rs_old", "target", "_rs_rows_before").agg(F.count(F.when(left, 1)).alias("n")).collect():
            first_row[r["_rs_old"], r["target"]] = r["_rs_rows_before"] + r["n"]
    rows_of = {r["_rs_old"]: r["rows"] for r in totals}
    slots, pieces = dict.fromkeys(range(shards), 0), {i: [] for i in olds}
    span = {}
    for i in olds:
        ends = [first_row[i, j] for j in order[i][1:]] + [rows_of[i]]
        span |= {(i, j): end - first_row[i, j] for j, end in zip(order[i], ends, strict=True)}
    at = {(i, j): b for i, b, j in cuts}
    for i, j in sorted(span, key=lambda p: (p[0] != p[1], p)):  # what stays keeps the front of its shard
        pieces[i].append((at[i, j], j, first_row[i, j], slots[j]))
        slots[j] += span[i, j]
    return Plan(blocks, table, olds, moves, {i: sorted(p) for i, p in pieces.items()})


def assign(docs: DataFrame, old: Column, made: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with `size`, `text_crc32`, `old_shard`, `shard`, `slot`; columns of these names are replaced.

    Slots are gapless from 0 in each shard. A null text has size 1; a null shard counts as shard 0. Repeated rows have
    slots of their own.
    """
    spark = docs.sparkSession
    added = ("size", "text_crc32", "old_shard", "shard", "slot")
    rows = _ordered(_measured(docs, old, id_col, text_col), made.blocks, id_col)
    kept = [F.col(c) for c in docs.columns if c not in added]
    kind = "_rs_old int, _rs_pieces array<struct<begin: bigint, target: int, row: bigint, slot: bigint>>"
    pieces = F.broadcast(spark.createDataFrame([(i, p) for i, p in made.pieces.items()], kind))
    placed = rows.join(made.block_table.drop("bytes"), ["_rs_old", "_rs_block"]).join(pieces, "_rs_old")
    middle = F.expr("2 * (_rs_start + _rs_bytes_before) + _rs_size")
    piece = F.element_at(F.filter("_rs_pieces", lambda p: p["begin"] * 2 <= middle), -1)
    placed = placed.withColumn("_rs_piece", piece)
    slot = F.expr("_rs_piece.slot + _rs_rows_before + _rs_rn - 1 - _rs_piece.row")
    return placed.select(
        *kept, F.col("_rs_size").alias("size"), F.col("_rs_crc").alias("text_crc32"), F.col("_rs_old").alias("old_shard"),
        F.col("_rs_piece.target").alias("shard"), slot.alias("slot"),
    )


def reshard(docs: DataFrame, old: Column, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plan and assignment in one call."""
    return assign(docs, old, plan(docs, old, shards, id_col, text_col), id_col, text_col)


def rewrite(assigned: DataFrame, made: Plan, folder: str) -> list[int]:
    """Write the files of the affected shards below `folder`, in slot order; returns their numbers.

    A shard that nothing enters or leaves keeps its old files.
    """
    changed = assigned.where(F.col("shard").isin(made.affected))
    parts = changed.withColumn("part", F.floor(F.col("slot") / BLOCK_ROWS)).repartition("shard", "part")
    parts.sortWithinPartitions("shard", "slot").drop("part").write.mode("overwrite").partitionBy("shard").parquet(folder)
    return made.affected
