"""Approximate nearest neighbours by permutations: vectors are known by the order in which they are near a set of pivots.

Pivots are chosen from a bounded sample, each the one farthest from those before, so that a dense region doesn't take them
all. A vector's permutation lists its `PREFIX` nearest pivots of `PIVOTS`; it is computed once and stored beside the vector.
Each shard has an inverted file: for every pivot the rows that list it and where. A query goes through the files of its own
pivots only. The footrule distance adds up how far a row's place for a pivot is from the query's, `PREFIX` where the row
doesn't list it, so rows that share no pivot are equally far and need no look. The `SHARE` of a shard's rows with the least
distance are ranked again by the exact inner product of the original vectors, in double precision and in one fixed order of
summation, so equal vectors score alike to the last bit.

Every row is indexed and every query sees every shard; only the pivots come from a sample. On average a query meets
PREFIX * PREFIX / PIVOTS postings a row. The vectors here spread in all directions, where no index can look at few rows
and find most neighbours: `SHARE` is set for a recall over 0.9 on them, which tests measure against brute force. On
vectors that lie in clusters a much smaller share does.

Edge cases. Vectors null, zero or with null or non-finite components take no part. Vectors of unequal length are multiplied
over the components that both have. Of rows that share an id one takes part (least bytes). Fewer candidates than k: all of
them. Ties go to the smaller id. Empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import documents, stored
from quarrystone.llm.vectors import matrix, prepared, sampled, searched

PIVOTS, PREFIX, SAMPLE, SHARE = 512, 48, 4_096, 0.22
#: Rows of a shard that are ranked again at least, in multiples of k: small shards have few pivots.
AGAIN = 15


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True, initial=0), 1e-300)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Farthest-first traversal of the sample's directions; fewer if the rest are the same ones."""
    x = unit(sample)
    chosen = []
    if len(x):
        chosen, near = [0], x @ x[0]
        while len(chosen) < min(most, len(x)) and near[i := int(near.argmin())] < 1 - 1e-9:
            chosen.append(i)
            near = np.maximum(near, x @ x[i])
    return x[chosen]


def permutations(x: np.ndarray, pivot: np.ndarray, prefix: int) -> np.ndarray:
    """Of each row the pivots, nearest first; equally near ones in order."""
    width = max(x.shape[1], pivot.shape[1])
    x, p = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (x, pivot))
    return np.argsort(-(unit(x) @ p.T), axis=1, kind="stable")[:, :prefix]


def indexed(rows: DataFrame, pivot: np.ndarray, prefix: int) -> DataFrame:
    """rows (vec_id, v) with order, the permutation as int16 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                order = permutations(matrix(part.column(1), pivot.shape[1]), pivot, prefix).astype(np.int16)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in order], pa.binary())], ["vec_id", "v", "order"])

    return rows.mapInArrow(run, "vec_id long, v binary, order binary")


class Postings:
    """A shard's inverted file: the rows that list each pivot, and at which place."""

    def __init__(self, order: np.ndarray, count: int) -> None:
        """order: (rows, prefix) pivots; count: of all pivots."""
        self.rows, self.prefix = order.shape
        by = np.argsort(order.reshape(-1), kind="stable")
        self.row, self.place = by // max(1, self.prefix), (by % max(1, self.prefix)).astype(np.int16)
        self.cut = np.searchsorted(order.reshape(-1)[by], np.arange(count + 1)).tolist()

    def nearness(self, mine: list[int]) -> np.ndarray:
        """Of each row the greatest footrule distance from the permutation `mine`, less its own; 0 for rows that share no pivot."""
        spans = [(self.cut[p], self.cut[p + 1]) for p in mine]
        row = np.concatenate([self.row[a:b] for a, b in spans]) if spans else np.zeros(0, np.int64)
        gain = np.concatenate([self.prefix - np.abs(self.place[a:b] - np.int16(j)) for j, (a, b) in enumerate(spans)]) if spans else row
        return np.bincount(row, gain, minlength=self.rows)


def nearest(df: DataFrame, every: int, k: int, prefix: int = PREFIX, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of df (vec_id, embedding) whose id is divisible by `every`."""
    plain = prepared(df, lambda v: v, True)
    pivot = pivots(sampled(plain, SAMPLE))
    rows = stored(indexed(plain, pivot, prefix), "permutations")
    queries = rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")

    def solve(own: pa.Table, asked: pa.Table) -> pa.Table:
        ids, scores, of = [], [], []
        if own.num_rows and asked.num_rows:
            own = own.sort_by("vec_id")
            q = matrix(asked["v"])
            x = matrix(own["v"], q.shape[1])
            q = np.pad(q, ((0, 0), (0, x.shape[1] - q.shape[1])))
            names = own["vec_id"].to_numpy()
            order, orders = (np.frombuffer(b"".join(t["order"].to_pylist()), np.int16).reshape(t.num_rows, -1) for t in (own, asked))
            index = Postings(order, len(pivot))
            most = min(len(x), max(AGAIN * k, int(np.ceil(share * len(x)))) + 1)
            for i, v, mine in zip(asked["query_id"].to_pylist(), q, orders.tolist(), strict=True):
                near = index.nearness(mine)
                close = np.flatnonzero(near >= np.partition(near, len(x) - most)[len(x) - most])
                close = close[names[close] != i]
                product = (x[close] * v).sum(1)
                best = np.lexsort((names[close], -product))[:k]
                ids.append(names[close][best])
                scores.append(product[best])
                of.append(np.full(len(best), i, np.int64))
        none = np.zeros(0, np.int64)
        return pa.table([pa.array(np.concatenate([none, *of])), pa.array(np.concatenate([none, *ids])), pa.array(np.concatenate([none.astype(float), *scores]))], names=["query_id", "vec_id", "score"])

    return searched(rows, queries, solve, k, "double")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(documents(spark, sf_dir, "embeddings"), 20, 20)
