"""What the operators share: reading, shared scratch space, size-checked joins, word splitting."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words: space and tab to carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Words as the contracts write them; a Java and a Python pattern alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a side of a join may be broadcast.
BROADCAST_ROWS = 50_000
#: Of each Spark application the tables that its operators have stored.
_stored: dict[str, set[str]] = {}


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. A session on one machine may do without: there /tmp is shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if re.match(r"local($|\[)", spark.sparkContext.master):
        return "file:///tmp/checkpoints"
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here, and a lost executor costs nothing.

    Operators drop what they no longer read with `forget`; tables that a returned plan reads stay until `forget_all`.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/quarrystone-{name}-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
    except BaseException:
        _delete(spark, path)
        raise
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    _stored.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _stored.get(spark.sparkContext.applicationId, set()).discard(path)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that `stored` returned; no plan may read them afterwards."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)


def forget_all(spark: SparkSession) -> None:
    """Deletes all that operators of this session have stored; call it when their results are written."""
    for path in list(_stored.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_small(df: DataFrame) -> bool:
    """Whether a count shows few enough rows to broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small_join(big: DataFrame, small: DataFrame, key: str, how: str, fits: bool, salts: int = 64) -> DataFrame:
    """Joins on one key that may be null and may hold a third of big's rows; small has each key once.

    small is broadcast if its count has been found to fit; else both sides are salted, so that no key lands in one task.
    """
    right = small.withColumnRenamed(key, "_key")
    if fits:
        return big.join(F.broadcast(right), F.col(key).eqNullSafe(F.col("_key")), how).drop("_key")
    left = big.withColumn("_salt", F.floor(F.rand(7) * salts).cast("int"))
    right = right.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_salt2")), how).drop("_key", "_salt", "_salt2")


def fold(column: str = "doc_id") -> Column:
    """crc32 of an id as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def trim() -> None:
    """Give a worker's freed memory back to the system: workers live on between stages, and what they keep stands beside the next stage's."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def trimmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at their end the worker gives back what it has freed."""
    yield from batches
    trim()


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds few texts at a time."""
    for batch in trimmed(batches):
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class RollingHash:
    """64-bit hashes of any slices of a byte array, from prefix sums modulo 2**64; the same slice hashes alike everywhere."""

    PRIME = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self.table = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.up = self.down = np.zeros(0, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = (n + (1 << 20) - 1) >> 20 << 20
            for name, base in (("up", self.PRIME), ("down", pow(self.PRIME, -1, 2**64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums of table[byte] * prime**position; entry i covers data[:i]."""
        self.powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def slices(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start])


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a slice beyond which it is hashed alone.
_LONG = 512


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of a byte array; the same bytes hash alike everywhere.

    Eight bytes at a time are mixed in by steps that are one to one for given bytes before them, so slices of up to eight
    bytes never collide and no structure of longer ones (as of sums of powers) makes them.
    """
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    n = end - start

    def part(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return eights[at].view("<u8")[:, 0] & _MASKS[np.minimum(left, 8)]

    out = mixed(part(start, n) + mixed(n.astype(np.uint64)))
    open_ = np.flatnonzero((n > 8) & (n <= _LONG))
    at, left = start[open_] + 8, n[open_] - 8
    while len(open_):
        out[open_] = mixed(out[open_] * np.uint64(0x9E3779B97F4A7C15) + part(at, left))
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return out
