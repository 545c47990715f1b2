"""Toxicity: a linear-chain conditional random field marks toxic words; marginals become scores of documents and spans.

Learning. Labels say which documents are toxic. Of the labelled rows outside the held-out fold, at most `SAMPLE` of either
label are taken, those whose ids hash lowest; that bound is the only sample here. Of their words and word beginnings those
become features that together single out the toxic rows: again and again the one that marks most rows not yet marked, clean
ones counting against it, and then those that are as frequent. Words of one text and its copies drop out: they share their
rows. Words of toxic documents with such a feature are the words labelled toxic,
all other words the words labelled clean. The field has one weight per feature, a bias, and transition weights; its
likelihood over runs of `RUN` words is climbed with exact forward-backward gradients, equal runs taken once with their count.

Scoring. Words without features share one transfer matrix, so a gap of any length is a power of it, and forward-backward
over a whole document costs only as much as its words with features. The document's score is a logistic function, fitted on
the sampled rows and weighted back to the shares of the labels, of the sum and of the largest of the words' marginals.

Edge cases. Null or empty text: no words, the score of a text without features. Null ids are never held out nor learned
from. Null labels are left out; of several labels of a document the toxic one counts, of several texts of an id the least is
learned from. Without toxic or without clean labels
every score is the share of toxic ones (0 without labels). Repeated rows score alike; extra columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import documents, fold, sliced

#: Labelled rows of either label to learn from, at most.
SAMPLE = 5_000
#: Features considered at most, the least share of toxic rows and the least number of rows among those that have one.
FEATURES, SHARE, ROWS = 3_000, 0.9, 2
#: Rows that one more feature has to mark, as a share of the toxic ones and at least; what marking a clean row costs.
MARKS, LEAST, COST = 0.002, 2, 3.0
#: Features that mark no clean row and so many rows, as a share of the most that one marks, count even if others mark the same rows.
OFTEN = 0.25
BEGINNINGS = (3, 4, 5, 6)
RUN = 64
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
CACHED = 150_000
SPANS = "array<struct<start:int,end:int,marginal:double>>"
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))


def features(word: str) -> list[str]:
    """The word itself, and the beginnings that are shorter than it."""
    w = word.lower()
    return ["=" + w, *(w[:k] for k in BEGINNINGS if len(w) > k)]


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, toxic of the rows to learn from, and how many rows each label has."""
    known = labels.where("toxic is not null and doc_id is not null").where(fold() % 3 != 1)
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("toxic = 1").orderBy(*order).limit(most).unionByName(known.where("toxic = 0").orderBy(*order).limit(most))
    # copies of a row teach nothing new; they'd also make the sample as large as a repeated id makes it
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), counts


def counted(rows: DataFrame) -> list[tuple[str, int, int]]:
    """The most telling features with the toxic and clean rows that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = Counter(), Counter()
        for batch in sliced(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[toxic].update({f for w in set(WORD.findall(text or "")) for f in features(w)})
        names = [*found[1]]  # what no toxic row of this part has, only matters where another part's toxic rows have it
        clean = [x for x in found[0] if x not in found[1]]
        yield pa.RecordBatch.from_arrays([pa.array(names + clean, pa.string()), pa.array([found[1][x] for x in names] + [0] * len(clean), pa.int64()), pa.array([found[0][x] for x in names + clean], pa.int64())], ["feature", "toxic", "clean"])

    sums = rows.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    telling = sums.where((F.col("toxic") >= ROWS) & (F.col("toxic") >= SHARE * (F.col("toxic") + F.col("clean"))))
    return [(r.feature, r.toxic, r.clean) for r in telling.orderBy(F.desc("toxic"), "feature").limit(FEATURES).collect()]


def hits_of(rows: DataFrame, index: dict[str, int]) -> list[tuple[int, int, list[list[int]]]]:
    """Of each sampled row: toxic, number of words, and position and features of the words that have some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {}
        for batch in sliced(batches):
            out = []
            for text in batch.column(0).to_pylist():
                words, hits = WORD.findall(text or ""), []
                for i, w in enumerate(words):
                    if (f := own.get(w)) is None:
                        f = own[w] = [index[x] for x in features(w) if x in index]
                    if f:
                        hits.append([i, *f])
                out.append((len(words), hits))
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array([n for n, _ in out], pa.int32()), pa.array([h for _, h in out], pa.list_(pa.list_(pa.int32())))], ["toxic", "n", "hits"])

    found = rows.select("text", "toxic").mapInArrow(run, "toxic int, n int, hits array<array<int>>").collect()
    return sorted((r.toxic, r.n, r.hits) for r in found)


def chosen(rows: list[tuple[int, int, list[list[int]]]], size: int, names: list[str], weight: float) -> list[int]:
    """Features that single out toxic rows, greedily; of equal ones the longest. weight: of a clean row."""
    of = [{f for _, *fs in hits for f in fs} for _, _, hits in rows]
    values = [1.0 if toxic else -COST * weight for toxic, _, _ in rows]
    by: list[list[int]] = [[] for _ in range(size)]
    gain = np.zeros(size)
    for r, fs in enumerate(of):
        for f in fs:
            by[f].append(r)
            gain[f] += values[r]
    sharing: dict[tuple, set[str]] = {}
    for f, rs in enumerate(by):
        sharing.setdefault(tuple(rs), set()).add(names[f].lstrip("=")[: BEGINNINGS[0]])
    copied = [len(sharing[tuple(rs)]) > 2 for rs in by]  # unlike words in just the same rows: those rows are copies
    toxic = sum(t for t, _, _ in rows)
    chance = math.log(max(2, size)) / -math.log(min(0.9, toxic / max(1, len(rows)) + 1e-9))  # fewer toxic rows and no clean one may be luck
    least = max(LEAST, MARKS * toxic)
    length = np.array([len(x) for x in names]) / 1e3
    may = np.array([not c and len(rs) >= chance for c, rs in zip(copied, by, strict=True)], bool)
    out, marked = [], set()
    while may.any() and gain[f := int(np.argmax(np.where(may, gain + length, -np.inf)))] >= least:
        out.append(f)
        may[f] = False
        for r in by[f]:
            if r not in marked:
                marked.add(r)
                for x in of[r]:
                    gain[x] -= values[r]
    common = OFTEN * max((len(by[f]) for f in out), default=1)
    return out + [f for f in np.flatnonzero(may).tolist() if len(by[f]) >= common and all(rows[r][0] for r in by[f])]


class Field:
    """Weights of the chain. State 1 is toxic; state 0 and going from 0 to 0 weigh nothing."""

    def __init__(self, size: int) -> None:
        self.weights = np.zeros(size + 5)  # features, bias, first word toxic, 0 to 1, 1 to 0, 1 to 1
        self.weights[size:] = -4, -1, -2, 0, 1

    def fit(self, rows: list[tuple[int, int, list[list[int]]]], size: int, rounds: int = 150) -> None:
        runs: Counter = Counter()
        for toxic, n, hits in rows:
            by: dict[int, list] = {}
            for i, *f in hits:
                by.setdefault(i // RUN, []).append((i % RUN, toxic, tuple(f)))
            whole, rest = divmod(n, RUN)
            for k, h in by.items():
                runs[RUN if k < whole else rest, tuple(h)] += 1
            runs[RUN, ()] += whole - sum(k < whole for k in by)
            if rest and whole not in by:
                runs[rest, ()] += 1
        runs = +runs
        if not runs:
            return
        keys, times = [*runs], np.array([*runs.values()], float)
        lengths = np.array([n for n, _ in keys])
        row, at, feature, label = [], [], [], np.zeros((len(keys), RUN), bool)
        for r, (_, hits) in enumerate(keys):
            for i, toxic, f in hits:
                label[r, i] = toxic
                row += [r] * len(f)
                at += [i] * len(f)
                feature += f
        row, at, feature = np.array(row, int), np.array(at, int), np.array(feature, int)
        inside = np.arange(RUN) < lengths[:, None]
        total, first, second = times.sum(), np.zeros(size + 5), np.zeros(size + 5)
        seen = np.zeros(size + 5)
        np.add.at(seen, feature, times[row] * label[row, at])
        seen[size] = (times[:, None] * label).sum()
        seen[size + 1] = times @ label[:, 0]
        a, b, both = label[:, :-1], label[:, 1:], inside[:, 1:]
        for k, x in enumerate((~a & b, a & ~b, a & b)):
            seen[size + 2 + k] = (times[:, None] * (x & both)).sum()
        for t in range(1, rounds + 1):
            w = self.weights
            e = np.full((len(keys), RUN), w[size])
            np.add.at(e, (row, at), w[feature])
            e = np.exp(np.clip(e, -30, 30))
            m = np.exp(np.array([[0, w[size + 2]], [w[size + 3], w[size + 4]]]))
            alpha = np.empty((RUN, len(keys), 2))
            alpha[0] = np.stack([np.ones(len(keys)), e[:, 0] * math.exp(w[size + 1])], 1)
            alpha[0] /= alpha[0].sum(1, keepdims=True)
            for i in range(1, RUN):
                x = alpha[i - 1] @ m
                x[:, 1] *= e[:, i]
                alpha[i] = np.where(inside[:, i, None], x / x.sum(1, keepdims=True), alpha[i - 1])
            beta = np.ones((len(keys), 2))
            expected = np.zeros(size + 5)
            marginal = np.zeros((len(keys), RUN))
            for i in range(RUN - 1, -1, -1):
                p = alpha[i] * beta
                marginal[:, i] = np.where(inside[:, i], p[:, 1] / p.sum(1), 0)
                if i:
                    x = beta.copy()
                    x[:, 1] *= e[:, i]
                    pair = alpha[i - 1][:, :, None] * m * x[:, None, :]
                    pair *= (times * inside[:, i] / pair.sum((1, 2)))[:, None, None]
                    expected[size + 2 :] += pair.sum(0).reshape(-1)[1:]
                    y = x @ m.T
                    beta = np.where(inside[:, i, None], y / y.sum(1, keepdims=True), beta)
            np.add.at(expected, feature, times[row] * marginal[row, at])
            expected[size] = times @ marginal.sum(1)
            expected[size + 1] = times @ marginal[:, 0]
            gradient = (seen - expected) / total * 100 - 1e-3 * w
            first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
            self.weights = w + 0.15 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)


@lru_cache(maxsize=8)
def transfer(chain: tuple[float, float, float, float, float]) -> tuple[float, np.ndarray, np.ndarray]:
    """Of a chain the parts of which powers of its matrix, up to a factor, are the first plus ratio**power times the second."""
    bias, _, w01, w10, w11 = chain
    eb = math.exp(bias)
    m = np.array([[1.0, math.exp(w01) * eb], [math.exp(w10), math.exp(w11) * eb]])  # from a word to the next one without features
    values, vectors = np.linalg.eig(m)
    k = int(np.argmax(values))
    ratio = float(values[1 - k] / values[k])
    inverse = np.linalg.inv(vectors)
    return ratio, np.outer(vectors[:, k], inverse[k]), np.outer(vectors[:, 1 - k], inverse[1 - k])


def marginals(n: int, hits: list[tuple[int, float]], chain: tuple[float, float, float, float, float]) -> list[float]:
    """Of n words, whose weights differ from the bias only at hits: the probability that each hit is toxic."""
    bias, start, *_ = chain
    eb = math.exp(bias)
    ratio, lead, rest = transfer(chain)

    def power(g: int) -> np.ndarray:
        return lead + ratio**g * rest

    forward, at, last = [], np.array([1.0, math.exp(start) * eb]), 0
    for i, x in hits:
        at = at @ power(i - last)
        at = at * [1.0, math.exp(x)]
        at /= at.sum()
        forward.append(at)
        last = i
    out, back, last = [], np.ones(2), n - 1
    for (i, x), f in zip(reversed(hits), reversed(forward), strict=True):
        back = power(last - i) @ back
        p = f * back
        out.append(float(p[1] / p.sum()))
        back = back * [1.0, math.exp(x)]
        back /= back.sum()
        last = i
    return out[::-1]


class Scorer:
    """What the workers need: weights of features, the chain, the logistic function of a document."""

    def __init__(self, weights: dict[str, float], chain: tuple, logistic: tuple[float, float, float]) -> None:
        self.weights, self.chain, self.logistic, self.seen = weights, chain, logistic, {}

    def weight(self, word: str) -> float:
        x = self.seen[word] = sum(self.weights.get(f, 0.0) for f in features(word)) if self.weights else 0.0
        return x

    def score(self, p: list[float]) -> float:
        a, b, c = self.logistic
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * math.log1p(sum(p)) + c * max(p, default=0.0)))))

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        if len(self.seen) > CACHED:
            self.seen = {}
        get, new = self.seen.get, self.weight
        return [(i, x) for i, w in enumerate(words) if (x := y if (y := get(w)) is not None else new(w))]

    def document(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        words = WORD.findall(text)
        if not (hits := self.hits(words)):
            return self.score([]), []
        p = marginals(len(words), hits, self.chain)
        at = dict(zip([i for i, _ in hits], p, strict=True))
        return self.score(p), [(*m.span(), at[i]) for i, m in enumerate(WORD.finditer(text)) if at.get(i, 0) >= 0.5]


def learn(docs: DataFrame, labels: DataFrame) -> Scorer:
    rows, counts = sample(docs, labels)
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        share = n1 / max(1, n0 + n1)
        return Scorer({}, (-4.0, -1.0, -2.0, 0.0, 1.0), (math.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0))
    names = [f for f, _, _ in counted(rows)]
    found = hits_of(rows, {f: i for i, f in enumerate(names)})
    sampled = max(1, sum(not t for t, _, _ in found))
    keep = {f: i for i, f in enumerate(chosen(found, len(names), names, n0 / sampled))}
    names = [names[f] for f in keep]
    found = [(t, n, [[i, *own] for i, *fs in hits if (own := [keep[f] for f in fs if f in keep])]) for t, n, hits in found]
    field = Field(len(names))
    field.fit(found, len(names))
    chain = tuple(field.weights[len(names) :])
    x, y = [], []
    for toxic, n, hits in found:
        p = marginals(n, [(i, float(field.weights[f].sum())) for i, *f in hits], chain) if hits else []
        x.append((1.0, math.log1p(sum(p)), max(p, default=0.0)))
        y.append(toxic)
    x, y = np.array(x).reshape(-1, 3), np.array(y, float)
    times = np.where(y == 1, n1 / max(1, (y == 1).sum()), n0 / max(1, (y == 0).sum()))
    times /= max(times.sum() / max(1, len(times)), 1e-300)
    w = np.zeros(3)
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (times * (y - p)) - 0.1 * w
        h = (x * (times * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w = w + np.clip(np.linalg.solve(h, g), -2, 2)
    return Scorer({f: float(v) for f, v in zip(names, field.weights, strict=False)}, tuple(map(float, chain)), tuple(map(float, w)))


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score and spans (start, end, marginal; code points) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [scorer.document(t or "") for t in batch.column(1).to_pylist()]
            spans = [[dict(zip(("start", "end", "marginal"), s, strict=True)) for s in x] for _, x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(spans, ARROW_SPANS)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, score double, spans {SPANS}")


def clean(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, whose text scores below the threshold."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = [scorer.document(t or "")[0] < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = score(docs, learn(docs, documents(spark, sf_dir, "labels")))
    held = F.coalesce(fold() % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
