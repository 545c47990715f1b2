"""What vector searches share: rows that take part, cells of a shard and a block of queries, and the best of all cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import parts, stored

#: Rows of a shard and queries of a block, at most, about. Every shard meets every block, so large blocks mean few copies.
SHARD, BLOCK = 20_000, 20_000
#: Rows of a shard of a small table, about: enough to be worth a task.
LEAST = 2_000


def packed(df: DataFrame, change: Callable[[np.ndarray], np.ndarray], nonzero: bool) -> DataFrame:
    """vec_id, v (float64 bytes): rows with an id whose vector is whole and finite, and not zero if asked for; of rows that share an id the one of least bytes. change works on components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is NaN here
            ends = np.cumsum(sizes)
            among = lambda flags, a=ends - sizes, b=ends: (lambda c: c[b] - c[a])(np.concatenate([[0], np.cumsum(flags)]))
            good = (ids.is_valid().to_numpy(zero_copy_only=False)) & lists.is_valid().to_numpy(zero_copy_only=False) & (among(~np.isfinite(flat)) == 0)
            if nonzero:
                good &= among(flat != 0) > 0
            sent = change(flat[np.repeat(good, sizes)]).astype(np.float64).tobytes()
            cuts = np.concatenate([[0], 8 * np.cumsum(sizes[good])]).astype(np.int32)
            out = pa.Array.from_buffers(pa.binary(), int(good.sum()), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(sent)])
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), out], ["vec_id", "v"])

    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    packs = rows.mapInArrow(run, "vec_id long, v binary")
    if rows.where("vec_id is not null").groupBy("vec_id").count().where("count > 1").limit(1).count():  # ids alone are cheap to compare
        return packs.groupBy("vec_id").agg(F.min("v").alias("v"))
    return packs


def whole(v: np.ndarray, scale: float, wide: bool) -> np.ndarray:
    """floor(scale * x) of finite x: float64, or Python's numbers if wide."""
    if not wide:
        return np.floor(scale * v)
    out, (up, down) = np.empty(v.shape, object), float(scale).as_integer_ratio()
    flat = out.reshape(-1)
    for i, x in enumerate(v.reshape(-1).tolist()):
        top, below = x.as_integer_ratio()
        flat[i] = up * top // (down * below)
    return out


def matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Rows of float64; shorter ones are filled with zeros, so that a product covers the components that both have."""
    raw = column.to_pylist()
    width = max(width, max(map(len, raw), default=0) // 8)
    if all(len(x) == 8 * width for x in raw):
        return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), width)
    out = np.zeros((len(raw), width))
    for row, x in zip(out, raw, strict=True):
        row[: len(x) // 8] = np.frombuffer(x, np.float64)
    return out


def searched(rows: DataFrame, queries: DataFrame, solve: Callable[[pa.Table, pa.Table], pa.Table], k: int, score: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of what solve finds in each cell, ties to the smaller vec_id.

    rows: vec_id, v and more columns; queries: query_id and more. A cell is a shard of rows with a block of queries, both
    bounded. solve gets both and returns query_id, vec_id, score, at most a few rows a query.
    """
    n, q = rows.count(), queries.count()
    tasks = parts(rows.sparkSession)
    shards = max(1, -(-n // SHARD) if n > SHARD * tasks else min(tasks, -(-n // LEAST)))
    groups = max(1, -(-q // BLOCK))
    own = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = own.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(lambda a, b: solve(a, b), f"query_id long, vec_id long, score {score}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def sampled(rows: DataFrame, most: int) -> np.ndarray:
    """Vectors of the rows whose ids hash lowest, at most so many."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("v").toArrow()
    return matrix(got.column(0))


def prepared(df: DataFrame, change: Callable[[np.ndarray], np.ndarray], nonzero: bool) -> DataFrame:
    return stored(packed(df, change, nonzero), "vectors")
