"""Vectors in packs: matrices of a few megabytes that tasks multiply with each other, instead of pairs of rows.

A pack is a row: its ids in order, the number of dimensions and the vectors as bytes. Vectors of one pack have the same length; null
vectors and those with a null are in packs without a matrix (dimensions -1), and have no score, as vectors of unlike length have none.
Products choose candidates with a margin; these are scored again term by term, so results don't depend on the order of a product's sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows and queries of a pack, and the distance below the k-th product within which candidates are scored again.
ROWS, QUERIES, MARGIN = 2_048, 1_024, 2e-6


def packed(df: DataFrame, name: str, column: str, ids: str, size: int) -> DataFrame:
    """ids, <ids>_d, <ids>_m: packs of at most so many rows of df (name, column of doubles)."""
    kind = df.schema[name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                part = part.take(pc.sort_indices(part.column(0), null_placement="at_start"))
                lists = part.column(1)
                lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                parents = pc.list_parent_indices(lists)
                holes = parents.filter(pc.is_null(lists.flatten())).to_numpy(zero_copy_only=False)
                lengths[holes] = -1
                for d in np.unique(lengths):
                    at_d = pa.array(np.flatnonzero(lengths == d))
                    some = part.column(0).take(at_d)
                    body = lists.take(at_d).flatten().to_numpy(zero_copy_only=False).astype("<f8").tobytes() if d > 0 else b""
                    one = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)
                    yield pa.RecordBatch.from_arrays([one, pa.array([int(d)], pa.int32()), pa.array([body], pa.binary())], [ids, f"{ids}_d", f"{ids}_m"])

    return df.select(name, column).mapInArrow(run, f"{ids} array<{kind}>, {ids}_d int, {ids}_m binary")


def summed(terms: Callable[[int], np.ndarray], d: int, n: int) -> np.ndarray:
    """Sums over dimensions in their order."""
    out = np.zeros(n)
    for j in range(d):
        out += terms(j)
    return out


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(summed(lambda j: m[:, j] * m[:, j], m.shape[1], len(m)))


def _best(v: np.ndarray, q: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries and rows, and cosines, of each query's k best rows by cosine to six digits, then by position.

    same: for each query the position of its own row, which is left out; -1 for none. NaN goes before all numbers.
    """
    with np.errstate(all="ignore"):
        vn, qn = _norms(v), _norms(q)
        near = (q @ v.T) / qn[:, None] / vn[None, :]
        near[np.isnan(near)] = np.inf
        own = np.flatnonzero(same >= 0)
        near[own, same[own]] = -np.inf
        least = np.partition(near, len(v) - k, axis=1)[:, len(v) - k] if k < len(v) else np.full(len(q), -np.inf)
        a, b = np.nonzero(near >= (least - MARGIN)[:, None])
        keep = b != same[a]
        a, b = a[keep], b[keep]
        score = summed(lambda j: v[b, j] * q[a, j], v.shape[1], len(a)) / (vn[b] * qn[a])
        rank = np.where(np.isnan(score), np.inf, np.sign(score) * np.floor(np.abs(score) * 1e6 + 0.5))
    order = np.lexsort((b, -rank, a))
    a, b, score = a[order], b[order], score[order]
    first = np.searchsorted(a, a)  # the place of the query's first row
    keep = np.arange(len(a)) - first < k
    return a[keep], b[keep], score[keep]


def best(pairs: DataFrame, k: int, own: bool) -> DataFrame:
    """query_id, vec_id, score of pairs of packs (qs, vs): each query's k best of each pack; score is null where there is none."""
    kinds = [pairs.schema[c].dataType.elementType.simpleString() for c in ("qs", "vs")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                vs, vd, vm, qs, qd, qm = (batch.column(c)[i] for c in ("vs", "vs_d", "vs_m", "qs", "qs_d", "qs_m"))
                rows, asked, d = vs.values, qs.values, vd.as_py()
                same = pc.index_in(asked, rows).fill_null(-1).to_numpy(zero_copy_only=False) if not own else np.full(len(asked), -1)
                if d > 0 and d == qd.as_py():
                    v, q = (np.frombuffer(m.as_py(), "<f8").reshape(-1, d) for m in (vm, qm))
                    a, b, score = _best(v, q, same, k)
                    score = pa.array(score, pa.float64())
                else:  # the first rows stand for all: nothing has a score
                    n = min(len(rows), k + 1)
                    a, b = np.repeat(np.arange(len(asked)), n), np.tile(np.arange(n), len(asked))
                    a, b = a[b != same[a]], b[b != same[a]]
                    score = pa.nulls(len(a), pa.float64())
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(a)), rows.take(pa.array(b)), score], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
