"""Exact top-k inner products by ball trees.

Every task cuts its rows into shards and builds a ball tree over each. A node
bounds the inner product of a query with anything below it by the product with
its centre plus the query's length times its radius. A search goes down into the
child of the larger bound first and leaves every node whose bound is below the
query's present kth score. That score is shared: it starts from the kth score
over a small sample of real candidates, which can only be too low, and is handed
on from shard to shard of a task.

Queries travel in blocks of at most `QUERY_ROWS`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import durable

QUERY_ROWS = 2048
SHARD_ROWS = 32_768
LEAF_ROWS = 128
#: Candidates the first bounds come from, about.
SAMPLE_ROWS = 4096
SCALE = 256


def whole(vector: Column | str) -> Column:
    """floor(256 x) of every component as a double; null for null vectors and those with null or non-finite components."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE).cast("double"))
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.when(fine & (F.size(vector) > 0), x)


class Tree:
    """Ball tree over the rows of `x`; `order` is where they came from."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.centre, self.radius, self.child, self.span = [], [], [], []
        self._grow(x, 0, len(x))
        self.x = x[self.order]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _grow(self, x: np.ndarray, i: int, j: int) -> int:
        mine = x[self.order[i:j]]
        centre = mine.mean(axis=0)
        away = np.sqrt(((mine - centre) ** 2).sum(axis=1))
        node = len(self.radius)
        self.centre.append(centre)
        self.radius.append(float(away.max()) * (1 + 1e-9) + 1e-6)
        self.child.append(None)
        self.span.append((i, j))
        if j - i > LEAF_ROWS and away.max() > 0:
            a = mine[away.argmax()]
            b = mine[((mine - a) ** 2).sum(axis=1).argmax()]
            side = np.argsort(mine @ (b - a), kind="stable")
            self.order[i:j] = self.order[i:j][side]
            middle = (i + j) // 2
            self.child[node] = (self._grow(x, i, middle), self._grow(x, middle, j))
        return node


class Search:
    """Best k of every query so far: scores (falling) and ids (rising among equals)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, bound: np.ndarray | None):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.length = np.sqrt((vectors**2).sum(axis=1))
        self.bound = np.full(len(ids), -np.inf) if bound is None else bound
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def kth(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.bound[q], self.score[q, -1])

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.rows, self.tree = ids[order], Tree(x[order])
        q = np.arange(len(self.ids))
        if len(q):
            self._visit(0, q, self._upper(0, q))

    def _upper(self, node: int, q: np.ndarray) -> np.ndarray:
        upper = self.vectors[q] @ self.tree.centre[node] + self.length[q] * self.tree.radius[node]
        return upper + np.abs(upper) * 1e-9 + 1e-6

    def _visit(self, node: int, q: np.ndarray, upper: np.ndarray) -> None:
        q = q[upper >= self.kth(q)]
        if not len(q):
            return
        if self.tree.child[node] is None:
            self._leaf(node, q)
            return
        left, right = self.tree.child[node]
        a, b = self._upper(left, q), self._upper(right, q)
        first = a >= b
        self._visit(left, q[first], a[first])
        self._visit(right, q, b)
        self._visit(left, q[~first], a[~first])

    def _leaf(self, node: int, q: np.ndarray) -> None:
        i, j = self.tree.span[node]
        ids = self.rows[self.tree.order[i:j]]
        for s in range(i, j, LEAF_ROWS * 8):  # rows that are all equal make one large leaf
            part = slice(s, min(j, s + LEAF_ROWS * 8))
            self._take(q, ids[part.start - i : part.stop - i], self.tree.x[part])

    def _take(self, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        score = products(self.vectors[q], x)
        score[ids[None, :] == self.ids[q][:, None]] = -np.inf
        useful = (score >= self.kth(q)[:, None]) & (score > -np.inf)
        some = useful.any(axis=1)
        if not some.any():
            return
        q, score = q[some], np.where(useful[some], score[some], -np.inf)
        scores = np.concatenate([self.score[q], score], 1)
        found = np.concatenate([self.found[q], np.broadcast_to(ids, score.shape)], 1)
        found = np.where(scores == -np.inf, np.iinfo(np.int64).max, found)
        by_id = np.argsort(found, axis=1, kind="stable")
        scores, found = np.take_along_axis(scores, by_id, 1), np.take_along_axis(found, by_id, 1)
        best = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        self.score[q], self.found[q] = np.take_along_axis(scores, best, 1), np.take_along_axis(found, best, 1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; beyond 2^53 the nearest double."""
    return q @ x.T


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, all components and the offsets of the vectors."""
    vectors = batch.column(1)
    offsets = np.asarray(vectors.offsets).astype(np.int64)
    return batch.column(0).to_numpy(zero_copy_only=False), np.asarray(vectors.values), offsets


def _searcher(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {d: Search(ids, x, k, bound) for d, (ids, x, bound) in shared.value.items()}
        held: dict[int, list] = {d: [] for d in searches}

        def flush(d: int) -> None:
            if held[d]:
                searches[d].add(np.concatenate([i for i, _ in held[d]]), np.concatenate([x for _, x in held[d]]))
                held[d] = []

        for batch in batches:
            ids, values, offsets = _rows(batch)
            sizes = np.diff(offsets)
            for d in searches:
                mine = np.flatnonzero(sizes == d)
                for s in range(0, len(mine), SHARD_ROWS):
                    some = mine[s : s + SHARD_ROWS]
                    held[d].append((ids[some], values[offsets[some][:, None] + np.arange(d)]))
                    if sum(len(i) for i, _ in held[d]) >= SHARD_ROWS:
                        flush(d)
        for d, search in searches.items():
            flush(d)
            q, place = np.nonzero(search.score > -np.inf)
            if len(q):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(search.ids[q]), pa.array(search.found[q, place]), pa.array(search.score[q, place].astype(np.int64))],
                    ["query_id", "vec_id", "score"],
                )

    return run


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = QUERY_ROWS
) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: each query's k largest inner products with the rows of other ids.

    Ties go to the smaller id. Null ids, invalid vectors and vectors of another length take no part; repeated rows count
    each as a candidate and once as a query. Runs jobs for the queries and the first bounds while the plan is built.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), whole(vector_col).alias("v")).dropna()
    asked = queries.select(F.col(id_col).cast("bigint").alias("id"), whole(vector_col).alias("v")).dropna().distinct()
    total, asked_total = rows.count(), asked.count()
    every = max(1, total // SAMPLE_ROWS)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0) if every > 1 else None
    blocks = max(1, -(-asked_total // query_rows))
    kind = "query_id bigint, vec_id bigint, score bigint"
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        part = part.toPandas()
        block = {}
        for d, group in part.groupby(part["v"].map(len)):
            block[d] = (group["id"].to_numpy(np.int64), np.stack(list(group["v"])).astype(float), None)
        bound: dict[int, int] = {}
        if sample is not None and block:
            sent = spark.sparkContext.broadcast(block)
            first = sample.mapInArrow(_searcher(sent, k), kind).withColumn("rank", F.row_number().over(best))
            bound = {r["query_id"]: r["score"] for r in first.where(F.col("rank") == k).select("query_id", "score").collect()}
            sent.unpersist()
        for d, (ids, x, _) in block.items():
            block[d] = (ids, x, np.array([bound.get(i, -np.inf) for i in ids], float))
        sent = spark.sparkContext.broadcast(block)
        near = rows.mapInArrow(_searcher(sent, k), kind).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if blocks > 1:
            near = durable(near)
            sent.unpersist()
        found = near if found is None else found.union(near)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
