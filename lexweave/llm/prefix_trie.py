"""The trie of conversations by their first turns, its subtree totals by time-forward processing.

Conversations that begin with the same turns share the nodes of those turns. Nodes
have names: the running sum of the hashed turns (`ordered`), 128 bits, so a
conversation of any length is named in many tasks at once and no text is sorted.

Totals of a subtree are passed from nodes to parents. Nodes are sorted outside
memory in reverse level order, deepest first; a node's totals wait in a priority
queue under its parent's name until the parent's turn comes. The queue keeps
`MOST_HELD` messages in memory and writes sorted runs of the rest to the shared
folder, so a task's memory does not depend on the shape of the trie.

Shards are whole subtrees. A node with more rows below it than a share of the input
belongs to the crown; the tops of what hangs from the crown are the shard roots, and
every shard fits one task. What the shard roots send up is summed by parent, and the
crown, at most `SHARDS` nodes a level, goes through a queue of its own.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, functions as F

from ..session import fresh_folder
from . import ordered
from .ordered import longs

#: A subtree with more than the SHARDS-th part of all turns, and than LEAST of them, is divided.
SHARDS, LEAST = 4096, 1 << 10
#: Messages that a queue holds in memory, and messages read at a time from a written run.
MOST_HELD, READ = 1 << 20, 1 << 14
#: Turns of a conversation that one task joins to what is known of the conversation.
BLOCK = 1024
#: Copies of the crown, which is small, for its children, who may be a third of all nodes.
SALTS = 16
NAME = ["depth", "n1", "n2"]
WORD = r"[^\x20\x09-\x0D]+"


class SpillingQueue:
    """Messages (level, name, name, leaves, saved) by key; beyond `most` they are written as sorted runs."""

    def __init__(self, folder: str, most: int = MOST_HELD):
        self.folder, self.most = folder, most
        self.heap: list[tuple[int, ...]] = []
        self.runs: list[tuple[tuple[int, ...], int, Iterator[tuple[int, ...]]]] = []
        self.written: list[str] = []
        self.fs = None

    def push(self, message: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.most:
            self._spill()

    def pop(self, key: tuple[int, int, int]) -> tuple[int, int, int]:
        """How many messages wait for `key`, and the sums of their leaves and savings."""
        n = leaves = saved = 0
        while True:
            if self.heap and self.heap[0][:3] == key:
                m = heapq.heappop(self.heap)
            elif self.runs and self.runs[0][0][:3] == key:
                m, i, rest = self.runs[0]
                after = next(rest, None)
                if after is None:
                    heapq.heappop(self.runs)
                else:
                    heapq.heapreplace(self.runs, (after, i, rest))
            else:
                return n, leaves, saved
            n, leaves, saved = n + m[3], leaves + m[4], saved + m[5]

    def _spill(self) -> None:
        if self.fs is None:
            self.fs, path = pafs.FileSystem.from_uri(self.folder)
            self.path = f"{path}/{uuid.uuid4().hex}"
            self.fs.create_dir(self.path, recursive=True)
        name = f"{self.path}/{len(self.written)}.arrow"
        self.written.append(name)
        rows = sorted(self.heap)
        self.heap = []
        names = [f"c{i}" for i in range(6)]
        with self.fs.open_output_stream(name) as out, pa.ipc.new_stream(out, pa.schema([(c, pa.int64()) for c in names])) as to:
            for i in range(0, len(rows), READ):
                to.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + READ], strict=True)], names))
        rest = self._read(name)
        heapq.heappush(self.runs, (next(rest), len(self.written), rest))

    def _read(self, name: str) -> Iterator[tuple[int, ...]]:
        with self.fs.open_input_stream(name) as source:
            for batch in pa.ipc.open_stream(source):
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def close(self) -> None:
        for name in self.written:
            self.fs.delete_file(name)


def _time_forward(batches: Iterator[pa.RecordBatch], folder: str, most: int) -> Iterator[pa.RecordBatch]:
    """`n_children`, `n_leaves`, `saved` of nodes that come deepest level first, by name within a level.

    `kids`, `leaves` and `owed` of a node are what it has from outside; the totals of a `top` go outside.
    """
    queue = SpillingQueue(folder, most)
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        cols = [longs(batch, c).tolist() for c in ("depth", "n1", "n2", "p1", "p2", "value", "top", "kids", "leaves", "owed")]
        for depth, n1, n2, p1, p2, value, top, kids, leaves, owed in zip(*cols, strict=True):
            n, below, saved = queue.pop((-depth, n1, n2))
            n, below, saved = n + kids, below + leaves, saved + owed + value
            below = below or 1
            out.append((n, below, saved))
            if not top:
                queue.push((1 - depth, p1, p2, 1, below, saved))
        made = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3
        names = [*NAME, "p1", "p2", "conv", "n_convs", "words", "top"]
        kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
        yield pa.RecordBatch.from_arrays([*kept, *made], [*names, "n_children", "n_leaves", "saved"])
    queue.close()


_TOTALS = (
    "depth bigint, n1 bigint, n2 bigint, p1 bigint, p2 bigint, conv bigint, n_convs bigint, words bigint, top boolean, "
    "n_children bigint, n_leaves bigint, saved bigint"
)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest of the ids of each name; rows come by name, then id, and are not held."""
    key, digest = None, None
    for batch in batches:
        done = []
        for *name, conv in zip(*[longs(batch, c).tolist() for c in (*NAME, "conv")], strict=True):
            if name == key:
                digest.update(b",%d" % conv)
                continue
            if key is not None:
                done.append((*key, digest.hexdigest()))
            key, digest = name, hashlib.sha256(b"%d" % conv)
        yield _digests(done)
    if key is not None:
        yield _digests([(*key, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], [*NAME, "ends_sha256"])


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns with their running sums s0 and s1."""
    for batch in batches:
        keep = ["conv", "p", "t0", "t1", "words"]
        cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
        sums = [pa.array(ordered.running(batch, i).view(np.int64)) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*cols, *sums], [*keep, "s0", "s1"])


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of the nodes of turns and of their parents.

    The name at depth d is the sum of hash(j) * base^j over turns j = 1..d: `d0` moved by one, and what the own
    running sum has beyond `b0` moved by `move`.
    """
    for batch in batches:
        depth, move = longs(batch, "depth"), longs(batch, "move")
        made = {}
        for i, base in enumerate(ordered.BASES):
            s, b, d, t = (longs(batch, f"{c}{i}").view(np.uint64) for c in "sbdt")
            name = d * np.uint64(base) + ordered.power(base, move) * (s - b)
            made[f"n{i + 1}"] = name
            made[f"p{i + 1}"] = name - t * ordered.power(base, depth)
        names = ["conv", "depth", "words", "length"]
        cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
        yield pa.RecordBatch.from_arrays([*cols, *[pa.array(x.view(np.int64)) for x in made.values()]], [*names, *made])


def _turns(conversations: DataFrame, folder: str) -> DataFrame:
    """`conv`, `p`, hashes `t0`, `t1`, `words`, running sums `s0`, `s1` of every turn."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.xxhash64(role, text).alias("t0"),
        F.xxhash64(F.lit(1), role, text).alias("t1"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    rows.write.parquet(f"{folder}/hashed")
    kind = "conv bigint, turn bigint, t0 bigint, t1 bigint, words bigint"
    rows = spark.read.schema(kind).parquet(f"{folder}/hashed")
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("t0"), F.col("t1")]
    placed = ordered.numbered(rows, "conv", order, order, f"{folder}/sorted", ["t0", "t1"])
    kind = "conv bigint, p bigint, t0 bigint, t1 bigint, words bigint, s0 bigint, s1 bigint"
    placed.mapInArrow(_final, kind).write.parquet(f"{folder}/turns")
    return spark.read.schema(kind).parquet(f"{folder}/turns")


def _conversations(turns: DataFrame, grafted: bool) -> DataFrame:
    """A row a conversation: its donor's first `m` turns, `h` own turns that fall away, `length` after that, sums on the way."""
    head = F.struct("p", "t0", "t1", "words", "s0", "s1")
    own = turns.groupBy("conv").agg(
        (F.max("p") + 1).alias("n"), F.array_sort(F.collect_list(F.when(F.col("p") < 3, head))).alias("head")
    )
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 4 if grafted else F.lit(0)
    own = own.withColumn("h", h.cast("bigint")).withColumn("donor", F.col("conv") - F.col("conv") % 20)
    donors = own.select(F.col("conv").alias("donor"), F.col("head").alias("dhead"))
    both = own.join(donors, "donor", "left")
    both = both.withColumn("m", F.least("h", F.coalesce(F.size("dhead"), F.lit(0)).cast("bigint")))

    def at(array: str, place: str, i: int) -> Column:
        return F.coalesce(F.get(array, (F.col(place) - 1).cast("int"))[f"s{i}"], F.lit(0))

    return both.select(
        "conv", "n", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
        F.slice("dhead", F.lit(1), F.col("m").cast("int")).alias("graft"),
        *[at("head", "h", i).alias(f"b{i}") for i in (0, 1)], *[at("dhead", "m", i).alias(f"d{i}") for i in (0, 1)],
    )


def _named(turns: DataFrame, convs: DataFrame, folder: str) -> DataFrame:
    """`conv`, `depth`, `words`, `length`, names `n1`, `n2` and of the parent `p1`, `p2` of every rebuilt turn."""
    blocks = convs.select(
        "conv", "h", "m", "length", "b0", "b1", "d0", "d1", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int"))).alias("blk"),
    )
    own = turns.withColumn("blk", F.floor(F.col("p") / BLOCK).cast("int")).join(blocks, ["conv", "blk"]).where("p >= h")
    columns = ["conv", "depth", "move", "words", "length", "t0", "t1", "s0", "s1", "b0", "b1", "d0", "d1"]
    own = own.withColumn("move", F.col("m") - F.col("h") + 1).withColumn("depth", F.col("p") + F.col("move")).select(*columns)
    zero = F.lit(0).cast("bigint")
    graft = convs.select("conv", "length", F.explode("graft").alias("x")).select("conv", "length", "x.*")
    graft = graft.select(
        "conv", (F.col("p") + 1).alias("depth"), F.lit(1).cast("bigint").alias("move"), "words", "length", "t0", "t1", "s0", "s1",
        *[zero.alias(c) for c in columns[-4:]],
    )
    kind = "conv bigint, depth bigint, words bigint, length bigint, n1 bigint, p1 bigint, n2 bigint, p2 bigint"
    own.union(graft).mapInArrow(_name, kind).write.parquet(f"{folder}/named")
    return turns.sparkSession.read.schema(kind).parquet(f"{folder}/named")


def trie(conversations: DataFrame, grafted: bool = False, shards: int = SHARDS, least: int = LEAST, most_held: int = MOST_HELD) -> DataFrame:
    """A row a node of the trie of `conversations` (`conv_id`, `turn`, `role`, `text`; other columns take no part).

    `conv_id` (smallest member), `depth`, `parent_conv_id` (null at the root), `n_convs`, `n_children`, `n_leaves`,
    `saved_tokens`, `ends_sha256`, and `words`, those of the node's last text. `grafted` gives every conversation the
    first turns of another before the trie is built: the first h of conversation c - c % 20 for its own first h, where
    h = crc32(c) % 4.

    Turns go by `turn`, null first, then by a hash of role and text; a repeated row is a turn of its own. Null roles and
    texts are empty. Rows without `conv_id` take no part. An empty table has no nodes, not even a root.
    """
    spark = conversations.sparkSession
    folder = fresh_folder(spark, "prefix-trie")
    turns = _turns(conversations, folder)
    _conversations(turns, grafted).write.parquet(f"{folder}/conversations")
    convs = spark.read.schema(_conversations(turns, grafted).schema).parquet(f"{folder}/conversations")
    named = _named(turns, convs, folder)

    beneath = F.sum(F.col("length") - F.col("depth") + 1).alias("below")
    nodes = named.groupBy(*NAME).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min("p1").alias("p1"),
        F.min("p2").alias("p2"), beneath,
    )
    nodes = nodes.withColumn("value", (F.col("n_convs") - 1) * F.col("words"))
    kind = nodes.schema
    nodes.write.parquet(f"{folder}/nodes")
    nodes = spark.read.schema(kind).parquet(f"{folder}/nodes")
    limit = max(least, named.count() // shards)
    crown, lower = nodes.where(F.col("below") > limit), nodes.where(F.col("below") <= limit)

    # Every lower node follows the conversation that represents it to the first node below the crown.
    is_crown = crown.select(*NAME, F.lit(True).alias("crowned"))
    under = named.join(is_crown, NAME, "left").where("crowned is null")
    tops = under.groupBy("conv").agg(F.min(F.struct(*NAME)).alias("top"), F.max("length").alias("length"))
    tops = tops.select("conv", "top", F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / BLOCK).cast("int"))).alias("blk"))
    sharded = lower.withColumn("blk", F.floor(F.col("depth") / BLOCK).cast("int")).join(tops, ["conv", "blk"])
    zero = F.lit(0).cast("bigint")
    sharded = sharded.select(
        *NAME, "p1", "p2", "conv", "n_convs", "words", "value", (F.struct(*NAME) == F.col("top")).alias("top"), zero.alias("kids"),
        zero.alias("leaves"), zero.alias("owed"), F.col("top.n1").alias("t1"), F.col("top.n2").alias("t2"),
    )
    level = [F.desc("depth"), "n1", "n2"]
    spill = f"{folder}/queues"
    sharded = sharded.repartition("t1", "t2").sortWithinPartitions(*level).drop("t1", "t2")
    sharded.mapInArrow(lambda b: _time_forward(b, spill, most_held), _TOTALS).write.parquet(f"{folder}/within")
    within = spark.read.schema(_TOTALS).parquet(f"{folder}/within")

    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(
        *[zero.alias(c) for c in (*NAME, "p1", "p2")], "conv", "n_convs", zero.alias("words"), zero.alias("value"), F.lit(True).alias("top"),
    )
    sent = within.where("top").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(
        F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("owed")
    )
    upper = crown.select(*NAME, "p1", "p2", "conv", "n_convs", "words", "value", F.lit(False).alias("top")).union(root)
    upper = upper.join(sent, NAME, "left").fillna(0, ["kids", "leaves", "owed"])
    upper = upper.repartition(1).sortWithinPartitions(*level)
    upper.mapInArrow(lambda b: _time_forward(b, spill, most_held), _TOTALS).write.parquet(f"{folder}/across")
    across = spark.read.schema(_TOTALS).parquet(f"{folder}/across")

    def parents(of: DataFrame) -> DataFrame:
        return of.select((F.col("depth") + 1).alias("depth"), F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv").alias("parent"))

    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    hanging = within.where("top").union(across.where("depth > 0")).withColumn("salt", F.pmod(F.xxhash64("n1", "n2"), F.lit(SALTS)).cast("int"))
    hanging = hanging.join(parents(across).select("*", salt), ["depth", "p1", "p2", "salt"], "left").drop("salt")
    inside = within.where("not top").join(parents(within), ["depth", "p1", "p2"], "left")
    every = inside.unionByName(hanging).unionByName(across.where("depth = 0").withColumn("parent", F.lit(None).cast("bigint")))

    last = named.where("depth = length").select(*NAME, "conv")
    last = last.union(convs.where("length = 0").select(*[zero.alias(c) for c in NAME], "conv"))
    ends = last.repartition(*NAME).sortWithinPartitions(*NAME, "conv")
    ends = ends.mapInArrow(_hash_ends, "depth bigint, n1 bigint, n2 bigint, ends_sha256 string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(ends, NAME, "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"), "words",
    )
