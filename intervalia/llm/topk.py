"""Exact top-k inner product search: a ball tree for each shard, branch and bound.

A shard is what one task reads, SHARD vectors at a time. Its tree splits at the median of the widest direction; each
node keeps its centre and radius, so q.c + |q| r bounds every inner product below it. A query visits nodes in the
order of that bound and stops when the bound is under its current k-th score. That score starts from a pilot: a bounded sample
of vectors searched first, whose k-th score for each query is shared with all shards, so that most of each tree is never opened.
Scores are inner products of integers, computed exactly.

The query set grows with the data, so it is dealt into blocks of BLOCK queries; each block is sent to the shards in turn,
and each shard returns at most k rows a query. What is sent at once is bounded by BLOCK.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, as query or as
candidate; shorter vectors count as padded with zeros; a query's own row is every row with its id; rows that repeat a query's id are
one query, for the smallest such vector; fewer candidates than k give fewer rows; equal scores go by the smaller id; rows with a null id take no
part; scores beyond 64 bits are clipped to them; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

K = 10
SCALE = 1024
LEAF = 64
SHARD = 16384
PILOT = 2048
BLOCK = 8192
EXACT = 2.0**53
LONG = 2**63


class BallTree:
    """Nodes in arrays; leaves are ranges of the reordered rows."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.centres, self.radii, self.children, self.ranges = [], [], [], []
        self.x = x
        self._grow(0, len(x), leaf)
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)
        self.x = x[self.order]

    def _grow(self, a: int, b: int, leaf: int) -> int:
        rows = self.x[self.order[a:b]]
        centre = rows.mean(axis=0)
        node = len(self.radii)
        self.centres.append(centre)
        self.radii.append(float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9))
        self.ranges.append((a, b))
        self.children.append(None)
        if b - a > leaf and self.radii[node] > 0:
            far = rows[((rows - centre) ** 2).sum(axis=1).argmax()] - centre
            mid = (b - a) // 2
            part = np.argpartition(rows @ far, mid)
            self.order[a:b] = self.order[a:b][part]
            self.children[node] = (self._grow(a, a + mid, leaf), self._grow(a + mid, b, leaf))
        return node


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray | list[int]:
    """Inner products of rows of whole numbers with q: in doubles while every partial sum is exact, else in Python integers."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q)) < EXACT:
        return (x @ q).astype(np.int64)
    w = [int(v) for v in q]
    return np.array([max(-LONG, min(LONG - 1, sum(int(a) * b for a, b in zip(row, w, strict=True)))) for row in x.tolist()], np.int64)


def search(tree: BallTree, ids: np.ndarray, q: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
    """The k best (score, -id) of this shard, none under the shared k-th score."""
    best: list[tuple[int, int]] = []
    norm = float(np.sqrt((q**2).sum()))
    slack = 1e-9 * (norm + 1)
    bounds = tree.centres @ q + norm * tree.radii
    heap = [(-bounds[0], 0)]
    limit = -np.inf if floor is None else floor
    while heap:
        bound, node = heapq.heappop(heap)
        bound = -bound
        if bound + slack * (abs(bound) + 1) < limit:
            break
        if tree.children[node]:
            for c in tree.children[node]:
                if bounds[c] + slack * (abs(bounds[c]) + 1) >= limit:
                    heapq.heappush(heap, (-bounds[c], c))
            continue
        a, b = tree.ranges[node]
        scores = exact_scores(tree.x[a:b], q)
        for i in np.flatnonzero(scores >= limit):
            vec = int(ids[a + i])
            if vec == own:
                continue
            entry = (int(scores[i]), -vec)
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
        if len(best) == k:
            limit = max(limit, best[0][0])
    return best


def padded(rows: list[list[float]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """_id, _v array<double>: floor(scale * component), rows that can take part only."""
    v = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(usable).select(F.col("vec_id").cast("bigint").alias("_id"), F.transform(v, lambda c: F.floor(c * F.lit(float(scale))).cast("double")).alias("_v"))


def top_k(vectors: DataFrame, every: int = 100, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for the queries whose id is divisible by `every`, against all rows."""
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, scale)
    pilot = [(r._id, list(r._v)) for r in rows.orderBy(F.xxhash64("_id"), "_id", "_v").limit(PILOT).collect()]
    queries = rows.where(F.col("_id") % every == 0).groupBy("_id").agg(F.min("_v").alias("_v"))
    queries = checkpointed(queries.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(1 << 30))))
    count = queries.count()
    blocks = max(1, -(-count // BLOCK))
    found = None
    for b in range(blocks):
        block = [(r._id, list(r._v)) for r in queries.where(F.col("_block") % blocks == b).orderBy("_id").collect()]
        part = _search_block(rows, block, pilot, k)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search_block(rows: DataFrame, block: list[tuple[int, list[float]]], pilot: list[tuple[int, list[float]]], k: int) -> DataFrame:
    width = max([1, *(len(v) for _, v in block)])
    floors: list[int | None] = [None] * len(block)
    if block and pilot:
        tree, ids = shard_of(pilot, width)
        for i, (own, q) in enumerate(block):
            best = search(tree, ids, padded([q], tree.x.shape[1])[0], own, k, None)
            floors[i] = best[0][0] if len(best) == k else None
    shared = rows.sparkSession.sparkContext.broadcast((block, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, least = shared.value
        least = list(least)
        held: list[tuple[int, list[float]]] = []
        best: list[list[tuple[int, int]]] = [[] for _ in queries]

        def flush() -> None:
            tree, ids = shard_of(held, width)
            for i, (own, q) in enumerate(queries):
                best[i] = heapq.nlargest(k, best[i] + search(tree, ids, padded([q], tree.x.shape[1])[0], own, k, least[i]))
                if len(best[i]) == k:
                    least[i] = max(best[i][-1][0], least[i]) if least[i] is not None else best[i][-1][0]
            held.clear()

        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(held) >= SHARD:
                flush()
        if held:
            flush()
        out = [(q, -v, s) for (q, _), b in zip(queries, best, strict=True) for s, v in b]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def shard_of(held: list[tuple[int, list[float]]], width: int) -> tuple[BallTree, np.ndarray]:
    x = padded([v for _, v in held], max(width, max(len(v) for _, v in held)))
    tree = BallTree(x)
    return tree, np.array([i for i, _ in held], np.int64)[tree.order]
