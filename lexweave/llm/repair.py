"""Repair of conversations that break the turn order, by an auction algorithm for shortest paths.

A conversation may be empty or hold one system turn, then pairs of user and
assistant. Its turns are kept (cost 0), given the other role (1), deleted (2, required for
blank and repeated turns), and turns may be inserted (5); a cut-off turn that is not
deleted adds 5. The cheapest edits are a shortest path in a lattice of four states
(nothing yet, after system, after user, after assistant) by turns.

Auction: every node has a price, first 0, never above the cost of any arc plus the
price at its end. A path starts at an origin. If the price of its last node is below
the least cost-plus-price over its arcs, the price rises to that and the path
contracts by the node; else the path is extended along the arc that attains it.
Origins are taken from the last turn to the first and prices persist, so a path
ends at the first node that an earlier path has converged. Converged prices are the exact
costs to the end; arcs whose cost is the fall in price are tight, and the trace takes the
tight arc of the least letter (D, I, K, R) from the start on.

Nothing but one character a turn, its fault and the initial of its role, goes to
the auction; prices are kept at the edges of blocks and raised anew inside one block at
a time. Turns are numbered and joined to their edits by blocks, so a conversation with a
third of all turns is spread over tasks; only its characters and edits meet in one,
and its repaired texts pass through one task's digest in order, unheld.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import fresh_folder
from . import ordered

#: Turns of a block: what one task reads as one string and what prices are kept for at a time.
BLOCK = 4096

RETITLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may follow each state.
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
TITLES = {"u": "user", "a": "assistant"}
ROLE = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
#: States in which a conversation may end.
WHOLE = (EMPTY, ASSISTANT)
FAR = 1 << 60
#: One character a turn: the initial of its role (`o` for any other), sound, cut off, blank, repeated.
SOUND, CUT, BLANK, REPEATED = "suao", "SUAO", "0123", "4567"
INITIALS = {c: "suao"[i] for kind in (SOUND, CUT, BLANK, REPEATED) for i, c in enumerate(kind)}
LEGAL = {"su", "ua", "au"}


@lru_cache(maxsize=None)
def _steps(code: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """Letter, cost and next state of what may be done to a turn in `state`, letters ascending."""
    steps = [("D", DELETE, state)]
    if code in SOUND + CUT:
        extra = CUT_OFF if code in CUT else 0
        role = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(INITIALS[code])
        if role is not None and (role == NEXT[state] or (role == SYSTEM and state == EMPTY)):
            steps.append(("K", extra, role))
        steps.append(("R", RETITLE + extra, NEXT[state]))
    return tuple(steps)


def _arcs(code: str | None, state: int) -> list[tuple[str, int, int, int]]:
    """Letter, cost, turns passed and next state of the arcs of a node; `code` None is the end of the turns."""
    arcs = [("I", INSERT, 0, NEXT[state])]
    if code is not None:
        arcs += [(letter, cost, 1, to) for letter, cost, to in _steps(code, state)]
    return sorted(arcs)


ARCS = {(c, s): tuple(_arcs(c, s)) for c in (None, *SOUND, *CUT, *BLANK, *REPEATED) for s in range(4)}


def _auction(codes: str, end: list[int] | None) -> list[list[int]]:
    """Converged prices of every node before each turn of `codes` and after the last.

    `end` are the converged prices after the last turn; without it the conversation ends there.
    """
    n = len(codes)
    prices = [[0] * 4 for _ in range(n)] + [end or [0] * 4]
    done = [[False] * 4 for _ in range(n)] + [[end is not None] * 4]
    for at in range(n if end is None else n - 1, -1, -1):
        for origin in range(4):
            path = [(at, origin)]
            while path:
                i, state = path[-1]
                if done[i][state]:
                    break
                best, to = FAR, None
                for _, cost, passed, after in ARCS[codes[i] if i < n else None, state]:
                    if cost + prices[i + passed][after] < best:
                        best, to = cost + prices[i + passed][after], (i + passed, after)
                if i == n and end is None and state in WHOLE:
                    best, to = 0, None
                if prices[i][state] < best:
                    prices[i][state] = best
                    if len(path) > 1:
                        path.pop()
                elif to is None:
                    break
                else:
                    path.append(to)
            # The path is tight to a converged node, so all on it have converged.
            for i, state in path:
                done[i][state] = True
    return prices


def _trace(codes: str, prices: list[list[int]], state: int, last: bool) -> tuple[list[str], int]:
    """Letters of the least tight path from `state`, those of a turn together, and the state it ends in.

    Every letter is followed by the initial of the role that stands there then (`-`: none). Insertions stand with the turn they precede; those after the last turn of the `last` block are one more entry.
    """
    out, letters, i, n = [], "", 0, len(codes)
    while i < n or last:
        price = prices[i][state]
        if i == n and price == 0:
            break
        for letter, cost, passed, to in ARCS[codes[i] if i < n else None, state]:
            if price == cost + prices[i + passed][to]:
                break
        letters, state, i = letters + letter + (ROLE[to] if letter != "D" else "-"), to, i + passed
        if passed:
            out.append(letters)
            letters = ""
    return out + [letters] if last else out, state


def _whole(codes: str) -> tuple[int, tuple[str, ...]]:
    prices = _auction(codes, None)
    return prices[0][EMPTY], tuple(_trace(codes, prices, EMPTY, True)[0])


#: Short conversations repeat each other's characters.
SHORT = 64
_known = lru_cache(maxsize=1 << 14)(_whole)


def _solve(blocks: list[str]) -> tuple[int, Iterator[tuple[int, list[str]]]]:
    """The cost, and for each block its number and the edits of its turns."""
    if len(blocks) == 1:
        cost, edits = (_known if len(blocks[0]) <= SHORT else _whole)(blocks[0])
        return cost, iter([(0, list(edits))])
    edges: list[list[int] | None] = [None] * len(blocks)
    for k in range(len(blocks) - 1, 0, -1):
        edges[k - 1] = _auction(blocks[k], edges[k])[0]
    first = _auction(blocks[0], edges[0])

    def traced() -> Iterator[tuple[int, list[str]]]:
        state = EMPTY
        for k, codes in enumerate(blocks):
            prices = first if k == 0 else _auction(codes, edges[k])
            edits, state = _trace(codes, prices, state, k == len(blocks) - 1)
            yield k, edits

    return first[0][EMPTY], traced()


_SOLVED = (
    "key string, blk bigint, edits array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
)


def _illegal(blocks: list[str]) -> int:
    bad, before = 0, None
    for codes in blocks:
        for c in codes:
            if before is not None and before + INITIALS[c] not in LEGAL:
                bad += 1
            before = INITIALS[c]
    return bad


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and figures by block; rows are `key`, `blk`, `codes`, sorted by the first two. Figures stand with block 0."""
    kind = pa.schema([
        ("key", pa.string()), ("blk", pa.int64()), ("edits", pa.list_(pa.string())),
        *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
    ])
    key: str | None = None
    blocks: list[str] = []
    out: list[tuple] = []

    def solved() -> Iterator[tuple]:
        cost, made = _solve(blocks)
        figures = [sum(codes.count(c) for codes in blocks for c in k) for k in (BLANK, REPEATED, CUT)]
        for k, edits in made:
            mine = [*figures, _illegal(blocks), cost] if k == 0 else [0] * 5
            yield key, k, edits, *mine

    def written() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * len(kind)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    for batch in batches:
        for name, _, codes in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if blocks and name != key:
                out += solved()
                blocks = []
                if len(out) >= 4096:
                    yield written()
                    out = []
            key = name
            blocks.append(codes)
    if blocks:
        for row in solved():
            out.append(row)
            if len(out) >= 256 and row[1]:
                yield written()
                out = []
    yield written()


_LINES = pa.schema([("key", pa.string()), ("p", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that remain, in order, from edits and turns sorted by `key`, `p`, an edit before its turn."""
    held = ""
    for batch in batches:
        out = []
        for key, p, edits, role, text in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "p", "edits", "role", "text")], strict=True):
            if edits is not None:
                for k in range(0, len(edits), 2):
                    if edits[k] == "I":
                        out.append((key, p, "I", TITLES[edits[k + 1]], ""))
                held = edits[-2:]
            elif held[0] != "D":
                out.append((key, p, held[0], role if held[0] == "K" else TITLES[held[1]], text))
        columns = list(zip(*out, strict=True)) if out else [()] * len(_LINES)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINES, strict=True)], schema=_LINES)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the `role:text` lines of each key, newline-joined; the lines of a key come one behind another."""
    key, digest, done = None, None, []

    def written() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([s for _, s in done], pa.string())], ["key", "sha"])

    for batch in batches:
        for name, role, text in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "role", "text")], strict=True):
            if digest is not None and name == key:
                digest.update(b"\n")
            else:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = name, hashlib.sha256()
            digest.update(f"{role}:{text}".encode())
        yield written()
        done = []
    if digest is not None:
        done = [(key, digest.hexdigest())]
        yield written()


def damage(conversations: DataFrame) -> DataFrame:
    """`conv_id`, `turn`, `role`, `text` with faults dealt by crc32 of `conv_id:turn`; nulls count as one space."""
    space = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(name.cast("binary")) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), space) for c in ("text", "role"))
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("_f") == 4, "user").otherwise(role)
    rows = conversations.select("conv_id", "turn", "role", "text", fault.alias("_f")).where("_f != 0")
    times = F.explode(F.when(F.col("_f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_n")).drop("_n")


class Repaired(NamedTuple):
    """`figures` by conversation and the `turns` that remain, both keyed by `key` (see `keyed`)."""

    figures: DataFrame
    turns: DataFrame

    def digests(self) -> DataFrame:
        """`key` and `sha`: SHA-256 of the `role:text` lines of every conversation that has turns left."""
        return self.turns.mapInArrow(_digest, "key string, sha string")


def keyed(conv_id: Column) -> Column:
    """A non-null name of a conversation id; that of null is empty."""
    return F.when(conv_id.isNull(), F.lit("")).otherwise(F.concat(F.lit("c"), conv_id.cast("string")))


def repair(conversations: DataFrame) -> Repaired:
    """Repairs `conversations` (`conv_id`, `turn`, `role`, `text`; other columns take no part).

    `figures`: `key`, `gaps`, `blank`, `duplicate`, `truncated`, `illegal`, `cost`, `audit` (letters of all edits). `turns`:
    `key`, `p` (place of the turn, or of the turn it is inserted before), `edit` (K, R or I), `role`, `text`, in order within a
    partition. A conversation left without turns has no row in `turns`.

    Turns go by `turn` (null first), then role and text. Nulls in role and text are one space. Rows without `conv_id` are
    one conversation. An empty table has no figures.
    """
    spark = conversations.sparkSession
    folder = fresh_folder(spark, "repair")
    space = F.lit(" ")
    rows = conversations.select(
        keyed(F.col("conv_id")).alias("key"), F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")],
    )
    turn = F.col("turn").asc_nulls_first()
    deal = [F.col("key"), turn, F.col("role"), F.substring("text", 1, 32)]
    turns = ordered.numbered(rows, "key", deal, [F.col("key"), turn, F.col("role"), F.col("text")], f"{folder}/sorted")

    brief = turns.select(
        "key", "p", "turn", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2"),
        F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    kind = "key string, p bigint, turn bigint, h1 bigint, h2 bigint, initial string, blank boolean, cut boolean"
    brief.write.parquet(f"{folder}/brief")
    brief = spark.read.schema(kind).parquet(f"{folder}/brief")
    firsts = brief.groupBy("key", "h1", "h2").agg(F.min("p").alias("p")).select("key", "p", F.lit(True).alias("new"))
    role = F.when(F.col("initial").isin("s", "u", "a"), F.instr(F.lit("sua"), F.col("initial"))).otherwise(4)
    kinds = (
        F.when(F.col("blank"), BLANK).when(F.col("new").isNull(), REPEATED).when(F.col("cut"), CUT).otherwise(SOUND)
    )
    coded = brief.join(firsts, ["key", "p"], "left").select(
        "key", F.floor(F.col("p") / BLOCK).alias("blk"), F.struct("p", F.substr(kinds, role, F.lit(1)).alias("c")).alias("x")
    )
    blocks = coded.groupBy("key", "blk").agg(F.array_sort(F.collect_list("x")).alias("x"))
    blocks = blocks.select("key", "blk", F.array_join("x.c", "").alias("codes"))
    blocks = blocks.repartition("key").sortWithinPartitions("key", "blk")
    blocks.mapInArrow(_repairs, _SOLVED).write.parquet(f"{folder}/edits")
    solved = spark.read.schema(_SOLVED).parquet(f"{folder}/edits")

    missing = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    gaps = brief.select("key", "turn").distinct().groupBy("key").agg(F.coalesce(missing, F.lit(0)).alias("gaps"))
    piece = F.struct("blk", F.array_join("edits", "").alias("a"))
    audits = solved.groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], F.array_sort(F.collect_list(piece)).alias("x")
    )
    figures = audits.join(gaps, "key").select(
        "key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.regexp_replace(F.array_join("x.a", ""), "[^DIKR]", "").alias("audit")
    )
    return Repaired(figures, _edited(turns, solved))


def _edited(turns: DataFrame, solved: DataFrame) -> DataFrame:
    """The turns that remain: edits and turns meet in the order of both, so texts are dealt once and none is held."""
    edits = solved.select("key", "blk", F.posexplode("edits").alias("i", "edits")).where("edits != ''")
    none = F.lit(None).cast("string")
    edits = edits.select("key", (F.col("blk") * BLOCK + F.col("i")).alias("p"), F.lit(0).alias("n"), "edits", none.alias("role"), none.alias("text"))
    both = edits.union(turns.select("key", "p", F.lit(1).alias("n"), none.alias("edits"), "role", "text"))
    both = both.repartition("key").sortWithinPartitions("key", "p", "n")
    return both.mapInArrow(_apply, "key string, p bigint, edit string, role string, text string")
