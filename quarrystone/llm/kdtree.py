"""Exact top-k by inner product with KD-trees: each shard splits at medians and keeps tight boxes, searched best box first.

A node's box bounds every product with a query: the sum over components of the larger of query * low and query * high. Nodes
are taken from a heap by that bound; a search ends where the bound falls below the k-th best score so far. That score starts
at the query's k-th best over a bounded sample of all rows, which no shard's answer can fall below, so every shard prunes
from the start. Bounds equal to it are still searched, so ties go to the smaller id everywhere.

Components become floor(scale * x), whole numbers; products are exact, in float64 as long as they fit and in whole numbers
of any size beyond, in the same tree (scores are cut to 64 bits, and ranked as cut).

Edge cases. Vectors null or with null or non-finite components take no part. Vectors of unequal length are multiplied over
the components that both have; an empty vector scores 0. Of rows that share an id one takes part (least bytes), and it is no
candidate of its own. Fewer candidates than k: all of them. Empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import documents, stored
from quarrystone.llm.vectors import matrix, prepared, sampled, searched, whole

LEAF, SAMPLE = 64, 1_024
EXACT = 2.0**53


def cut(scores: np.ndarray) -> np.ndarray:
    """Whole numbers of any size, cut to 64 bits; float64 ones are below 2^53."""
    return np.clip(scores, -(2**63), 2**63 - 1) if scores.dtype == object else scores


class Tree:
    """Median splits along the widest side of each box, down to leaves."""

    def __init__(self, x: np.ndarray, ids: np.ndarray) -> None:
        order, self.low, self.high, self.children, self.spans = np.arange(len(x)), [], [], [], []

        def build(a: int, b: int) -> int:
            own = x[order[a:b]]
            node, low, high = len(self.low), own.min(0), own.max(0)
            self.low.append(low)
            self.high.append(high)
            self.spans.append((a, b))
            self.children.append(())
            if b - a > LEAF and (side := int(np.argmax(high - low)) if len(low) else -1) >= 0 and high[side] > low[side]:
                m = (a + b) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, side], m - a)]
                self.children[node] = build(a, m), build(m, b)
            return node

        if len(x):
            build(0, len(x))
        self.x, self.ids = x[order], ids[order]
        self.low, self.high = np.array(self.low).reshape(-1, x.shape[1]), np.array(self.high).reshape(-1, x.shape[1])

    def search(self, q: np.ndarray, own: int, k: int, floor: float) -> list[tuple[float, int]]:
        """(score, id), at most k, none below floor."""
        if not len(self.x):
            return []
        bound = cut(np.maximum(q * self.low, q * self.high).sum(1)).tolist()
        heap, best = [(-bound[0], 0)], []  # best: a heap of (score, -id)
        while heap:
            b, node = heapq.heappop(heap)
            if -b < floor:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bound[child] >= floor:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, z = self.spans[node]
            scores = cut(self.x[a:z] @ q)
            for i in np.flatnonzero(scores >= floor).tolist():
                if (vec := int(self.ids[a + i])) != own:
                    item = (scores[i], -vec)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    else:
                        heapq.heappushpop(best, item)
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(s, -v) for s, v in best]


def fits(x: np.ndarray, q: np.ndarray, scale: float) -> bool:
    """Whether float64 holds all products of scaled rows of x and q."""
    x_most, q_most = (scale * min(float(np.abs(v).max(initial=0)), EXACT) + 1 for v in (x, q))
    return x_most * q_most * max(1, x.shape[1]) < EXACT


def top_k(df: DataFrame, every: int, k: int, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of df (vec_id, embedding) whose id is divisible by `every`."""
    rows = prepared(df, lambda v: v, False)
    sample = sampled(rows, SAMPLE)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column(1), sample.shape[1])
            x = np.pad(sample, ((0, 0), (0, q.shape[1] - sample.shape[1])))
            out = np.full(len(q), -np.inf)
            if len(x) > k and len(q) and fits(x, q, scale):
                x, q = whole(x, scale, False), whole(q, scale, False)
                out = np.partition(q @ x.T, -(k + 1), axis=1)[:, -(k + 1)]  # one more, as the query itself may be in the sample
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["query_id", "v", "floor"])

    queries = stored(rows.where(F.col("vec_id") % every == 0).mapInArrow(floors, "query_id long, v binary, floor double"), "queries")

    def solve(own: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and asked.num_rows:
            x = matrix(own["v"])
            q = matrix(asked["v"], x.shape[1])
            x = np.pad(x, ((0, 0), (0, q.shape[1] - x.shape[1])))
            ids = own["vec_id"].to_numpy()
            wide = not fits(x, q, scale)
            x, q = whole(x, scale, wide), whole(q, scale, wide)
            tree = Tree(x, ids)
            for i, v, floor in zip(asked["query_id"].to_pylist(), q, asked["floor"].to_pylist(), strict=True):
                found = tree.search(v, i, k, floor)
                out += [(i, vec, int(s)) for s, vec in found]
        return pa.table([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    return searched(rows, queries, solve, k, "long")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(documents(spark, sf_dir, "embeddings"), 50, 5)


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
