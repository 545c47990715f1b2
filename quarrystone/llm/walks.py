"""Fingerprints of documents by a randomised edit embedding: a shared random walk over the characters of each text.

The walk reads a text one output symbol at a time. Whether it then goes on to the next character or writes the same one
again is a coin that all texts share, tossed for each step and character. Texts that differ by an edit part there, and then
meet again after a few steps, as their walks move independently until they stand on the same character at the same step.
So the number of steps at which two outputs differ (their Hamming distance) follows the edit distance of the texts. Coins repeat after `PERIOD` steps.

Steps are sampled by shared hashes: level k keeps each step with chance 2**-k, level k + 1 is a subset of level k. A text
keeps the finest level with fewer than `SYMBOLS` samples expected; texts of different length are compared on the coarser of
their two levels, where both have the same steps. Four bits of each sampled symbol (hashed with its step) are the fingerprint,
as text: two digits for the level, then one a sample. The likeness of two is the share of samples that agree, less what
chance gives, over the longer of the two walks: 1 for equal texts, near 0 for unrelated ones.

`near` finds near copies: samples are dealt into `BANDS` bands; texts that agree in a whole band at one level are candidates,
verified by likeness and then by the exact edit distance of the whole texts. Exact copies meet as one text, and in a band each
text is compared with the one of least id, so a group costs as many comparisons as texts.

Whole documents go through one shuffle, by ranges of doc_id, and meet the next document as its range is read in order.

Edge cases. Null texts are empty; an empty text has the fingerprint '' and is as like to an empty one as can be (1), to any
other not at all (0). Rows of one doc_id are in order of their texts (by hash, then text), rows without one come after all ids.
A single document is its own next. Repeated rows stay rows. Very long texts take memory in their task for their own walk.
An empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import documents, mixed, parts, sliced, stored, trimmed

PERIOD, SYMBOLS, BANDS, SIMILARITY = 1_024, 256, 24, 0.8
#: Likeness of fingerprints from which whole texts are compared; unrelated ones stay below.
LIKE = 0.25
#: Characters that one call walks through at once, about: enough to fill numpy's loops.
TOGETHER = 3_000_000
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _coins() -> np.ndarray:
    """Steps that a walk stays on a character: by class of character (code point modulo 256) and step modulo PERIOD."""
    toss = np.random.default_rng(20250131).integers(0, 2, (256, PERIOD), dtype=np.uint8)
    toss[:, 0] = 1
    stay, ahead = np.zeros((256, PERIOD), np.uint16), np.ones(256, np.int64)
    ahead += np.argmax(toss, 1)
    for at in range(PERIOD - 1, -1, -1):
        ahead = np.where(toss[:, at] == 1, 1, ahead + 1)
        stay[:, at] = ahead
    return stay.reshape(-1)


def _hash(x: np.ndarray) -> np.ndarray:
    return mixed(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))


class Samples:
    """The sampled steps of each level, in order, as far as asked for."""

    def __init__(self) -> None:
        self.known: dict[int, tuple[int, np.ndarray]] = {}

    def steps(self, level: int, end: int) -> np.ndarray:
        """Sampled steps below end."""
        upto, found = self.known.get(level, (0, np.zeros(0, np.int64)))
        if upto < end:
            more, block = [found], 1 << 20
            want = max(end, 2 * upto, 1 << 12)
            for a in range(upto, want, block):
                j = np.arange(a, min(want, a + block), dtype=np.int64)
                more.append(j[_hash(j) & np.uint64((1 << level) - 1) == 0])
            found = np.concatenate(more)
            self.known[level] = (want, found)
        return found[: np.searchsorted(found, end)]

    def first(self, level: int, count: int) -> np.ndarray:
        """The first so many sampled steps."""
        found = self.known.get(level, (0, np.zeros(0, np.int64)))[1]
        while len(found) < count:
            self.steps(level, max(1 << 12, 2 * self.known.get(level, (0, None))[0]))
            found = self.known[level][1]
        return found[:count]


def level_of(steps: int) -> int:
    return max(0, math.ceil(math.log2(steps / SYMBOLS))) if steps > SYMBOLS else 0


class Walker:
    def __init__(self) -> None:
        self.stay, self.samples = _coins(), Samples()

    def arrivals(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Of each text (code points) the step at which the walk reaches each character, and last the step at which it ends. Texts walk side by side."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        flat = np.zeros(int(begin[-1]), np.int64)
        for i, a in zip(order, begin.tolist(), strict=False):
            flat[a : a + len(texts[i])] = (texts[i] & 255).astype(np.int64) * PERIOD
        at, step, arrived = begin[:-1].copy(), np.zeros(len(order), np.int64), np.zeros(int(begin[-1]), np.int64)
        active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right").tolist()
        for m in active:
            if m < len(at):
                arrived[at[m:]] = step[m:]
                at, step = at[:m], step[:m]
            arrived[at] = step
            step = step + self.stay[flat[at] + (step & (PERIOD - 1))]
            at = at + 1
        arrived[at] = step
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        for i, a, b in zip(order, begin.tolist(), begin[1:].tolist(), strict=False):
            out[i] = arrived[a:b]
        return out

    def fingerprints(self, texts: list[str]) -> list[str]:
        """Fingerprints; texts are walked in portions of bounded size."""
        out, portion, size = [], [], 0
        for text in texts:
            portion.append(text)
            size += len(text)
            if size >= TOGETHER:
                out += self._portion(portion)
                portion, size = [], 0
        return out + self._portion(portion)

    def _portion(self, texts: list[str]) -> list[str]:
        points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        out = []
        for point, arrived in zip(points, self.arrivals(points), strict=True):
            if not len(point):
                out.append("")
                continue
            steps = int(arrived[-1])
            level = level_of(steps)
            j = self.samples.steps(level, steps)
            symbol = point[np.searchsorted(arrived, j, side="right") - 1]
            bits = mixed(_hash(j) ^ _hash(symbol)) >> np.uint64(60)
            out.append(f"{level:02x}" + _HEX[bits].tobytes().decode())
        return out

    def digits(self, fingerprint: str, level: int) -> np.ndarray:
        """The samples of a fingerprint that belong to a level not finer than its own."""
        own, marks = int(fingerprint[:2], 16), np.frombuffer(fingerprint[2:].encode(), np.uint8)
        if own == level:
            return marks
        j = self.samples.first(own, len(marks))
        return marks[_hash(j) & np.uint64((1 << level) - 1) == 0]

    def likeness(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        if not a or not b:
            return 0.0
        level = max(int(a[:2], 16), int(b[:2], 16))
        x, y = self.digits(a, level), self.digits(b, level)
        n = min(len(x), len(y))
        if not max(len(x), len(y)):
            return 0.0
        same = float(np.count_nonzero(x[:n] == y[:n])) / max(len(x), len(y))
        return min(1.0, max(0.0, (same - 1 / 16) / (15 / 16)))

    def bands(self, fingerprint: str) -> list[tuple[int, int, bytes]]:
        """(level, band, samples) at the text's own level and the next one, which texts a little longer have."""
        out = []
        for level in {int(fingerprint[:2], 16), int(fingerprint[:2], 16) + 1} if fingerprint else ():
            marks = self.digits(fingerprint, level)
            band = (_hash(self.samples.first(level, len(marks))) >> np.uint64(32)) % np.uint64(BANDS)
            for b in range(BANDS):
                if len(own := marks[band == b]):
                    out.append((level, b, own.tobytes()))
        return out


def edited(text: str, other: str) -> str:
    """The text with its last third replaced by as many first characters of the other, or all it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + other[:cut]


def distance(a: str, b: str, most: int) -> int:
    """Edit distance (insert, delete, replace), or most + 1 if greater: bit columns of the matrix as one whole number."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    short = min(len(a), len(b))
    while i < short and a[i] == b[i]:
        i += 1
    j = 0
    while j < short - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return min(len(b), most + 1)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for k, c in enumerate(b):
        eq = where.get(c, 0)
        level = (((eq & up) + up) ^ up) | eq
        right, left = down | (full & ~(level | up)), up & level
        if right & last:
            score += 1
        elif left & last:
            score -= 1
        if score - (len(b) - 1 - k) > most:
            return most + 1
        right = (right << 1 | 1) & full
        left = left << 1 & full
        cross = eq | down
        up, down = left | (full & ~(cross | right)), right & cross
    return min(score, most + 1)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [f.split(" ")[0] for f in RESULT.split(", ")]


def _finished(walker: Walker, rows: list[tuple]) -> pa.RecordBatch:
    """RESULT rows of (doc_id, text, next text)."""
    texts = [t for _, t, _ in rows]
    after = [edited(t, o) for _, t, o in rows]
    # the next text of most rows is the next row's own: walk each once
    unlike = [o for (_, _, o), t in zip(rows, [*texts[1:], None], strict=True) if o is not t]
    found = walker.fingerprints([*texts, *after, *unlike])
    own, changed, others = found[: len(rows)], found[len(rows) : 2 * len(rows)], iter(found[2 * len(rows) :])
    following = [n if o is t else next(others) for (_, _, o), t, n in zip(rows, [*texts[1:], None], [*own[1:], None], strict=True)]
    columns = [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in after], pa.string()),
        pa.array(own, pa.string()),
        pa.array(changed, pa.string()),
        pa.array([walker.likeness(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()),
        pa.array([walker.likeness(a, b) for a, b in zip(own, following, strict=True)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def compared(df: DataFrame) -> DataFrame:
    """RESULT for each row of df (doc_id, text): its fingerprint beside that of its edited text and of the next document."""
    spark = df.sparkSession
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    ranges = rows.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order, "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: finished rows; 1 and 2: the last and the first row of a range, with their texts."""
        walker, part, last = Walker(), TaskContext.get().partitionId(), None

        def edge(kind: int, doc: int | None, text: str) -> pa.RecordBatch:
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([text], pa.string()), pa.array([doc], pa.int64()), *none], ["kind", "range", "text", *NAMES])

        def done(some: list[tuple]) -> pa.RecordBatch:
            got = _finished(walker, some)
            n = got.num_rows
            return pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), *got.columns], ["kind", "range", "text", *NAMES])

        waiting, size = [], 0
        for batch in sliced(batches, 500):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if last is None:
                    yield edge(2, doc, text)
                else:
                    waiting.append((*last, text))
                    size += len(text)
                    if size >= TOGETHER:
                        yield done(waiting)
                        waiting, size = [], 0
                last = (doc, text)
        if waiting:
            yield done(waiting)
        if last is not None:
            yield edge(1, *last)

    table = stored(ranges.mapInArrow(run, f"kind int, range int, text string, {RESULT}"), "walks")
    found = sorted(r[0] for r in table.where("kind = 2").select("range").collect())  # one number a range
    after = spark.createDataFrame(list(zip(found, [*found[1:], *found[:1]], strict=True)), "range int, following int")
    heads = table.where("kind = 2").select(F.col("range").alias("following"), F.col("text").alias("head"))
    ends = table.where("kind = 1").select("doc_id", "text", "range").join(after, "range").join(heads.hint("shuffle_hash"), "following").select("doc_id", "text", "head")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker()
        for batch in trimmed(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _finished(walker, [row])

    return table.where("kind = 0").select(*NAMES).unionByName(ends.mapInArrow(finish, RESULT))


def near(df: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, near_id, distance: rows of df whose text is near that of another, near_id its least id among texts it was verified with.

    Near: edit distance at most (1 - similarity) times the longer length; exact copies have distance 0. Candidates agree in a
    band; each text is compared with one text a band and with no text twice. Rows without an id or text don't take part.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text <> ''")
    names = stored(rows.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.reverse("text")).alias("b")), "names")
    twins = names.groupBy("a", "b").agg(F.min("doc_id").alias("least"))
    unlike = rows.withColumn("a", F.xxhash64("text")).withColumn("b", F.xxhash64(F.reverse("text"))).groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.any_value("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker()
        for batch in sliced(batches, 500):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(walker.fingerprints(batch.column(1).to_pylist()), pa.string())], ["least", "text", "print"])

    texts = stored(unlike.select("least", "text").mapInArrow(run, "least long, text string, print string"), "texts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker()
        for batch in sliced(batches, 2_000):
            found = [(i, b"%d.%d." % (level, band) + own) for i, f in zip(*(c.to_pylist() for c in batch.columns), strict=True) for level, band, own in walker.bands(f)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.binary())], ["least", "band"])

    prints = texts.select("least", "print")
    bands = stored(prints.mapInArrow(cut, "least long, band binary").select("least", F.xxhash64("band").alias("band")), "bands")
    heads = bands.groupBy("band").agg(F.min("least").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head")
    pairs = bands.join(heads, "band").where("least <> head").select("least", "head").distinct()
    other = texts.select(F.col("least").alias("head"), F.col("print").alias("other"))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker()
        for batch in trimmed(batches):
            keep = [walker.likeness(x, y) >= LIKE for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["least", "head"]).filter(pa.array(keep, pa.bool_()))

    printed = pairs.join(prints, "least").join(other, "head").select("least", "head", "print", "other")
    likely = stored(printed.mapInArrow(alike, "least long, head long"), "likely")
    both = likely.join(texts.select("least", "text"), "least").join(texts.select(F.col("least").alias("head"), F.col("text").alias("other")), "head").select("least", "head", "text", "other")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                most = int((1 - similarity) * max(len(x), len(y)) + 1e-9)
                if (d := distance(x, y, most)) <= most:
                    out.append((a, b, d))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["least", "near_id", "distance"])

    links = both.mapInArrow(verify, "least long, near_id long, distance long")
    best = links.groupBy("least").agg(F.min(F.struct("near_id", "distance")).alias("x")).select("least", "x.*")
    owned = names.join(twins, ["a", "b"]).select("doc_id", "least").distinct()
    copies = owned.where("doc_id <> least").select("doc_id", F.col("least").alias("near_id"), F.lit(0).cast("long").alias("distance"))
    return copies.unionByName(owned.where("doc_id = least").join(best, "least").select("doc_id", "near_id", "distance"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))
