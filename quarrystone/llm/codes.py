"""Compression of vectors to codes: a codebook for each part of a vector, learned by rounds of assignment and averaging.

Norm-of-sum bounds spare exact distances. Codebooks of all rounds so far are kept. A part keeps, for each group of
codebook entries, a lower bound on its distance to the group's entries other than its own, and the round in which that
bound was measured. Later the bound falls by the greatest net displacement of the group's entries since that round: the norm
of the sum of their moves, read from the kept codebooks, which is never more than the sum of the norms of the moves that
drifting bounds add up. A part's distance to its own entry is always measured; a group whose bound stays above it holds no
nearer and no equal entry. Only other groups are scanned again, exactly.

Rows, codes, bounds and stamps are one stored table a round. Entries are averaged from sums that each task has added up, one
row an entry and task, so what moves doesn't grow with the rows of an entry. Codebooks (entries times components, whatever
the number of rows) are on the driver and go to every task.

Components become floor(scale * x), whole numbers. Squared distances are exact: in float64 while they fit into 2^53, in
whole numbers of any size beyond. Errors are cut to 64 bits.

Edge cases. Rows whose vector is null or has null or non-finite components are left out. Vectors of unequal length get zeros
up to the longest one's, rounded up to a multiple of the number of parts; empty vectors are zeros. The codebook starts from
rows in order of id, null ids last, rows of one id in order of their components; fewer rows than entries make a smaller
codebook. Repeated rows and ids stay rows of their own. Ties go to the lower index; entries without parts stay. An empty
table gives an empty result and empty codebooks. Without a column `label` all labels are null; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import documents, forget, is_small, small_join, stored, trimmed
from quarrystone.llm.vectors import whole

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a group that shares a bound, about.
GROUP = 16
EXACT = 2**53
#: Relative room for the rounding of square roots.
SLACK = 1e-9
#: Whole numbers travel as digits of so many bits; sums of two billion of them fit into 63.
DIGIT = 31


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all of c."""
    if x.dtype == object:
        return ((x[:, None, :] - c[None]) ** 2).sum(2) if x.shape[1] else np.zeros((len(x), len(c)), object)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]


class Lengths:
    """Square roots as float64, in units of a power of two so that any size fits."""

    def __init__(self, most: int) -> None:
        self.shift = max(0, most.bit_length() // 2 - 100)

    def __call__(self, squared: np.ndarray) -> np.ndarray:
        if squared.dtype != object:
            return np.sqrt(np.maximum(squared, 0))
        out = np.empty(squared.shape)
        out.reshape(-1)[:] = [float(math.isqrt(max(0, int(s)) >> 2 * self.shift)) for s in squared.reshape(-1).tolist()]
        return out


def groups(c: np.ndarray, lengths: Lengths) -> np.ndarray:
    """The group of each entry: that of the nearest of some entries far from one another."""
    if not len(c):
        return np.zeros(0, np.int64)
    chosen, away = [0], lengths(squares(c, c[:1]))[:, 0]
    while len(chosen) < -(-len(c) // GROUP) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, lengths(squares(c, c[chosen[-1:]]))[:, 0])
    near = lengths(squares(c, c[chosen])).argmin(1)
    return np.unique(near, return_inverse=True)[1]


class Part:
    """Assignment of one part position in one round, given the codebooks of all rounds up to it."""

    def __init__(self, history: list[np.ndarray], group: np.ndarray, lengths: Lengths) -> None:
        self.now, self.round, self.lengths = history[-1], len(history) - 1, lengths
        self.of, self.members = group, [np.flatnonzero(group == g) for g in range(int(group.max()) + 1 if len(group) else 0)]
        #: By round and group, the greatest net displacement of the group's entries from that round to this.
        self.moved = np.zeros((len(history), len(self.members)))
        for t, then in enumerate(history[:-1]):
            net = (((self.now - then) ** 2).sum(1)).reshape(-1, 1)
            step = lengths(net)[:, 0] if len(net) else np.zeros(0)
            self.moved[t] = [(step[m].max() + (step[m].max() > 0) * lengths_room(lengths)) * (1 + SLACK) for m in self.members]
        self.scanned = 0

    def start(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, squared distances, bounds and stamps from a full scan."""
        n = len(x)
        code, bound, stamp = np.zeros(n, np.int64), np.full((n, len(self.members)), -np.inf, np.float32), np.zeros((n, len(self.members)), np.uint8)
        return self.again(x, code, bound, stamp)

    def again(self, x: np.ndarray, code: np.ndarray, bound: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own = ((x - self.now[code]) ** 2).sum(1) if x.shape[1] else np.zeros(len(x), x.dtype)
        apart = self.lengths(own)
        lower = bound.astype(np.float64) - np.take_along_axis(self.moved, stamp.astype(np.int64), 0) if len(self.members) else bound.astype(np.float64)
        look = ~(apart[:, None] * (1 + SLACK) + lengths_room(self.lengths) < lower)
        best, least, first = code.copy(), own.copy(), apart.copy()
        bound, stamp = bound.copy(), stamp.copy()
        for g, members in enumerate(self.members):
            at = np.flatnonzero(look[:, g])
            if not len(at):
                continue
            self.scanned += len(at) * len(members)
            far = squares(x[at], self.now[members])
            rest = np.where(best[at][:, None] == members[None], np.inf, self.lengths(far))
            bound[at, g], stamp[at, g] = down(rest.min(1) * (1 - SLACK) - lengths_room(self.lengths)), self.round
            index = far.argmin(1) if far.dtype != object else np.array([min(range(len(members)), key=r.__getitem__) for r in far.tolist()])
            value, entry = far[np.arange(len(at)), index], members[index]
            wins = (value < least[at]) | ((value == least[at]) & (entry < best[at]))
            w, old = at[wins], best[at[wins]]
            # a bound leaves out the entry that the part has: the winner now, while the one before counts again
            self._counted(bound, stamp, w, old, first[w], lower)
            without = np.where(members[None] == old[:, None], first[w][:, None], rest[wins])
            without[np.arange(len(w)), index[wins]] = np.inf
            bound[w, g] = down(without.min(1) * (1 - SLACK) - lengths_room(self.lengths))
            best[w], least[w], first[w] = entry[wins], value[wins], self.lengths(value[wins])
        return best, least, bound, stamp

    def _counted(self, bound: np.ndarray, stamp: np.ndarray, rows: np.ndarray, entry: np.ndarray, length: np.ndarray, lower: np.ndarray) -> None:
        g = self.of[entry]
        fresh = stamp[rows, g] == self.round
        now = np.where(fresh, bound[rows, g].astype(np.float64), lower[rows, g])
        bound[rows, g] = down(np.minimum(now, length * (1 - SLACK) - lengths_room(self.lengths)))
        stamp[rows, g] = self.round


def lengths_room(lengths: Lengths) -> float:
    """What a length in units may be short of, from whole square roots."""
    return 2.0 if lengths.shift else 1e-6


def down(x: np.ndarray) -> np.ndarray:
    """float32 not above x."""
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


class Layout:
    """How rows are read: components of a vector, parts, and whether float64 holds squared distances."""

    def __init__(self, length: int, most: float, parts: int, scale: int) -> None:
        self.parts, self.scale = parts, scale
        self.part = -(-length // parts)
        high = scale * (int(math.ceil(most)) + 1)
        self.wide = 8 * max(1, self.part) * high * high >= EXACT
        self.lengths = Lengths(4 * max(1, self.part) * high * high if self.wide else 0)
        self.digits = -(-(high.bit_length() + 1) // DIGIT)

    def matrix(self, column: pa.Array) -> np.ndarray:
        """(rows, parts, components) of whole numbers from lists of doubles."""
        sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(column), self.parts * self.part))
        row = np.repeat(np.arange(len(column)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        return whole(out, self.scale, self.wide).reshape(len(column), self.parts, self.part)

    def split(self, x: np.ndarray) -> np.ndarray:
        """Whole numbers as digits, lowest first; the last one has the sign."""
        if not self.wide and self.digits == 1:
            return x.astype(np.int64)[..., None]
        x, out = x.astype(object) if x.dtype == object else x.astype(np.int64).astype(object), []
        for _ in range(self.digits - 1):
            out.append((x & ((1 << DIGIT) - 1)).astype(np.int64))
            x = x >> DIGIT
        return np.stack([*out, x.astype(np.int64)], -1)


def added(layout: Layout, x: np.ndarray, code: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Count (parts, entries) and sums of digits (parts, entries, components * digits) of rows x."""
    digits = layout.split(x).reshape(len(x), layout.parts, -1)
    count, total = np.zeros((layout.parts, entries), np.int64), np.zeros((layout.parts, entries, digits.shape[2]), np.int64)
    for p in range(layout.parts):
        count[p] = np.bincount(code[:, p], minlength=entries)
        np.add.at(total[p], code[:, p], digits[:, p])
    return count, total


SMALL = 4_096  # rows that are compared at once


def learned(rows: DataFrame, layout: Layout, start: np.ndarray, rounds: int) -> tuple[DataFrame, list[list[np.ndarray]], list[DataFrame]]:
    """(rows with code and error, the codebooks of all rounds by part, tables to forget). rows: vec_id, label, v."""
    parts, k = layout.parts, len(start)
    books = [[start[:, p]] for p in range(parts)]
    group = [groups(start[:, p], layout.lengths) for p in range(parts)]
    at = [0, *np.cumsum([int(g.max()) + 1 if len(g) else 0 for g in group]).tolist()]
    schema = "vec_id long, label int, v array<double>, code binary, error decimal(38,0), bounds binary, stamps binary"
    names = ["vec_id", "label", "v", "code", "error", "bounds", "stamps"]

    def assign(history: list[list[np.ndarray]]):
        first = len(history[0]) == 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = [Part(h, g, layout.lengths) for h, g in zip(history, group, strict=True)]
            for batch in trimmed(batches):
                for a in range(0, batch.num_rows, SMALL):
                    some = batch.slice(a, SMALL)
                    n, x = some.num_rows, layout.matrix(some.column(2))
                    code, error = np.zeros((n, parts), np.int64), np.zeros(n, object if layout.wide else np.float64)
                    bounds, stamps = np.empty((n, at[-1]), np.float32), np.empty((n, at[-1]), np.uint8)
                    if not first:
                        code = np.frombuffer(b"".join(some.column(3).to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                        bounds = np.frombuffer(b"".join(some.column(5).to_pylist()), np.float32).reshape(n, -1).copy()
                        stamps = np.frombuffer(b"".join(some.column(6).to_pylist()), np.uint8).reshape(n, -1).copy()
                    for p in range(parts):
                        own = slice(at[p], at[p + 1])
                        got = part[p].start(x[:, p]) if first else part[p].again(x[:, p], code[:, p], bounds[:, own], stamps[:, own])
                        code[:, p], bounds[:, own], stamps[:, own] = got[0], got[2], got[3]
                        error = error + got[1]
                    cut = [min(2**63 - 1, int(e)) for e in error.tolist()]
                    packed = [pa.array([r.tobytes() for r in t], pa.binary()) for t in (code.astype(np.uint8), bounds, stamps)]
                    yield pa.RecordBatch.from_arrays([*some.columns[:3], packed[0], pa.array(cut, pa.decimal128(38, 0)), *packed[1:]], names)

        return run

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, layout.part * layout.digits), np.int64)
        for batch in trimmed(batches):
            for a in range(0, batch.num_rows, SMALL):
                some = batch.slice(a, SMALL)
                code = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
                more = added(layout, layout.matrix(some.column(0)), code, k)
                count += more[0]
                total += more[1]
        p, e = np.nonzero(count)
        lists = pa.array(total[p, e].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), lists], ["part", "entry", "n", "total"])

    table, used = rows, []
    for round_ in range(rounds + 1):
        table = stored(table.mapInArrow(assign([list(b) for b in books]), schema), "codes")
        used.append(table)
        if round_ == rounds or not k:
            break
        task = table.select("v", "code").mapInArrow(sums, "part int, entry int, n long, total array<long>")
        width = layout.part * layout.digits
        # digits summed over all tasks may pass 63 bits, so their sums are decimals
        found = task.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i)).cast("decimal(19,0)")).alias(f"t{i}") for i in range(width)])
        after = [b[-1].copy() for b in books]
        for row in found.collect():
            total = [int(t) for t in row[3:]]
            for c in range(layout.part):
                value = sum(t << DIGIT * d for d, t in enumerate(total[c * layout.digits : (c + 1) * layout.digits]))
                after[row["part"]][row["entry"], c] = value // row["n"]
        for b, a in zip(books, after, strict=True):
            b.append(a)
        for old in used[:-1]:
            forget(old)
        del used[:-1]
    return table, books, used


def compressed(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code binary with a byte a part, error; codebooks by part) of df (vec_id, embedding, label)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    v = F.col("embedding").cast("array<double>")
    label = F.col("label").cast("int") if "label" in df.columns else F.lit(None).cast("int")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = rows.where(F.col("v").isNotNull()).where(~bad)
    seen = rows.select(F.size("v").alias("n"), F.array_max(F.transform("v", F.abs)).alias("most")).agg(F.max("n"), F.max("most")).first()
    layout = Layout(seen[0] or 0, seen[1] or 0.0, parts, scale)
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), F.transform("v", lambda x: F.floor(x * scale).cast("double")), "v").limit(entries).select("v").toArrow()
    start = layout.matrix(least.column(0).combine_chunks() if least.num_rows else pa.array([], pa.list_(pa.float64())))
    table, books, _ = learned(rows, layout, start, rounds)
    return table.select("vec_id", "label", "code", F.col("error").cast("long").alias("error")), [b[-1] for b in books]


def decoded(code: bytes, books: list[np.ndarray], scale: int = SCALE) -> list[float]:
    """The vector that a code stands for, components in the middle of their steps."""
    return [(float(x) + 0.5) / scale for p, book in zip(code, books, strict=True) for x in book[p].tolist()]


def digest(books: list[np.ndarray]) -> str:
    numbers = (str(int(x)) for book in books for x in book.reshape(-1).tolist())
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compressed(documents(spark, sf_dir, "embeddings"))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    labels = rows.groupBy("label").agg(F.least(total, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = small_join(rows, labels, "label", "left", is_small(labels))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """Rounds written out; parts of vectors of one length."""
    steps = [f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS i, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT i, vec_id, label, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS v
  FROM kept, (SELECT unnest(range({parts})) AS p)
), book0 AS MATERIALIZED (
  SELECT p, i - 1 AS e, v AS c FROM cut WHERE i <= {entries}
)"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT i, p, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT t.i, t.p, b.e, CAST(list_sum(list_transform(list_zip(t.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM cut t JOIN book{r} b ON t.p = b.p) GROUP BY i, p
)""")  # fmt: skip
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT p, e, list(x ORDER BY k) AS c FROM (
      SELECT p, e, k, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x FROM (
        SELECT t.p, n.best.e AS e, unnest(t.v) AS x, unnest(range(len(t.v))) AS k FROM cut t JOIN near{r} n ON t.i = n.i AND t.p = n.p)
      GROUP BY p, e, k) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e
)""")  # fmt: skip
    return ", ".join(steps) + f""", coded AS (
  SELECT k.vec_id, k.label, string_agg(printf('%02x', n.best.e), '' ORDER BY n.p) AS code, CAST(sum(n.best.d) AS BIGINT) AS error
  FROM kept k JOIN near{rounds} n ON n.i = k.i GROUP BY k.i, k.vec_id, k.label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM coded
"""


ORACLE = _oracle()
