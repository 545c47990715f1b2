"""Language identification by cross-parsing: a text is cut greedily into the longest phrases that occur in a language's sample.

Learning. The texts with a language outside the held-out fold are seen as segments of `SEGMENT` characters, every part of
every text. Of each language those segments whose hash is least in each of `SEGMENTS` classes are its sample; that bound (and
`ALL_SEGMENTS`, of all languages together) is a parameter, and the choice needs only minima per language and class. Each
sample becomes a suffix automaton, whose paths from the root are exactly the sample's substrings.

Letters. Every letter that a language's sample holds is told apart. The `COMMON` most frequent ones have columns in a dense
table of transitions; transitions by the others are sorted keys, looked up where such letters occur. A letter that the sample
doesn't hold is a phrase of its own.

Parsing. Letters are lower-cased, runs of anything else are one gap. A text, in blocks of `BLOCK` symbols, is read by every
language's automaton: where no transition leads on, or a block ends, a phrase ends and the next begins. Blocks of many texts
advance together. A language's cost is its number of phrases times the logarithm of its sample's size, over the text's
symbols; the least wins, ties going to the lower code. The score is 1 - least / next: 0 if two languages are equal, towards 1
the clearer it is.

Edge cases. Null text, or text without a letter, or nothing learned: `und` and 0. One language learned: that one and 1. Null
ids are neither learned from nor held out. Of different texts under one id a class takes the least segment. Texts of any
length are read whole. Repeated rows are judged alike; extra columns are left out.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.bpe import blocks
from quarrystone.llm.common import documents, fold, sliced

SEGMENTS, SEGMENT, ALL_SEGMENTS = 40, 1_000, 2_000
#: Letters of a language with columns of their own in its table.
COMMON = 60
BLOCK = 512
FAILED = 1 << 30
RARE, UNKNOWN = COMMON + 1, COMMON + 2
SIZE = COMMON + 3


@cache
def lower_letters() -> np.ndarray:
    """Of each code point the lower-case letter, 0 for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if (x := chr(c)).isalpha():
            out[c] = ord(y) if len(y := x.lower()) == 1 else c
    return out


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters, 0 for gaps, of the texts one after another, and which text each is of; runs of gaps are one."""
    lengths = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    low, of = lower_letters()[raw], np.repeat(np.arange(len(texts)), lengths)
    again = np.zeros(len(low), bool)
    again[1:] = (low[1:] == 0) & (low[:-1] == 0) & (of[1:] == of[:-1])
    return low[~again], of[~again]


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The suffix automaton's transitions of each state."""
    links, lengths, nexts = [-1], [0], [{}]
    last = 0
    for c in symbols:
        now = len(nexts)
        nexts.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = now
            p = links[p]
        if p >= 0:
            q = nexts[p][c]
            if lengths[q] == lengths[p] + 1:
                links[now] = q
            else:
                copy = len(nexts)
                nexts.append(nexts[q].copy())
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = links[p]
                links[q] = links[now] = copy
        last = now
    return nexts


class Language:
    """A sample's automaton as tables. States are multiplied by SIZE; the last one leads nowhere, so from it any symbol starts a phrase."""

    def __init__(self, letters: np.ndarray) -> None:
        """letters: code points of the sample, 0 for gaps."""
        found, counts = np.unique(letters[letters > 0], return_counts=True)
        order = np.lexsort((found, -counts))
        self.code = np.full(sys.maxunicode + 1, UNKNOWN, np.uint8)
        self.code[0] = 0
        self.code[found[order[COMMON:]]] = RARE
        self.code[found[order[:COMMON]]] = np.arange(1, min(COMMON, len(found)) + 1)
        nexts = automaton(letters.tolist())
        at = np.repeat(np.arange(len(nexts)), [len(x) for x in nexts])
        by = np.array([c for x in nexts for c in x], np.int64)
        to = np.array([s for x in nexts for s in x.values()], np.int64)
        column, self.dead = self.code[by], len(nexts) * SIZE
        table = np.full((len(nexts) + 1, SIZE), -1, np.int64)
        common = column != RARE
        table[at[common], column[common]] = to[common]
        root = np.where(table[0] < 0, len(nexts), table[0])
        self.table = np.where(table >= 0, table * SIZE, root * SIZE + FAILED).reshape(-1).astype(np.int32)
        keys = at[~common] * SIZE << 21 | by[~common]
        order = np.argsort(keys)
        self.keys, self.to = keys[order], (to[~common] * SIZE)[order].astype(np.int32)
        self.weight = math.log2(len(letters) + 2)

    def step(self, state: np.ndarray, symbol: np.ndarray, letter: np.ndarray, rare: bool) -> np.ndarray:
        """The next states, with FAILED where a phrase ended before the symbol."""
        out = self.table[state + symbol]
        if rare:
            pick = np.flatnonzero(symbol == RARE)
            wanted = letter[pick].astype(np.int64)
            for base, failed in ((0, FAILED), (state[pick].astype(np.int64) << 21, 0)):  # from the root, then from the state itself
                key = base | wanted
                where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[where] == key
                out[pick[hit]] = self.to[where[hit]] + failed
        return out


class Parser:
    """Automata of all languages."""

    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        """samples: (language, text), languages in order."""
        self.languages = [k for k, _ in samples]
        self.parsers = [Language(points([t])[0]) for _, t in samples]
        self.weights = [p.weight for p in self.parsers]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each text and language, symbols of each text, and whether it has a letter."""
        low, of = points(texts)
        n = len(texts)
        sizes = np.bincount(of, minlength=n)
        lettered = np.bincount(of, low > 0, minlength=n) > 0
        first = np.cumsum(sizes) - sizes
        parts = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(n), parts)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = first[owner] + inner * BLOCK
        lengths = np.minimum(BLOCK, first[owner] + sizes[owner] - starts)
        order = np.argsort(-lengths, kind="stable")
        owner, starts, lengths = owner[order], starts[order], lengths[order]
        rows = len(owner)
        letters = low[np.minimum(starts + np.arange(BLOCK)[:, None], max(0, len(low) - 1))] if rows else np.zeros((BLOCK, 0), np.uint32)
        active = np.searchsorted(-lengths, -np.arange(BLOCK), side="left").tolist()  # blocks longer than each step
        out = np.zeros((len(self.parsers), n))
        for k, own in enumerate(self.parsers):
            grid = own.code[letters]
            rare = (grid == RARE).any(1).tolist() if len(own.keys) else [False] * BLOCK
            state, ends = np.full(rows, own.dead, np.int32), np.zeros(rows, np.int32)
            for j, m in enumerate(active):
                if not m:
                    break
                x = own.step(state[:m], grid[j, :m], letters[j, :m], rare[j])
                ends[:m] += x >= FAILED
                state[:m] = x & (FAILED - 1)
            out[k] = np.bincount(owner, ends, minlength=n)
        return out, sizes, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        found, sizes, lettered = self.phrases(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        cost = found * np.array(self.weights)[:, None] / np.maximum(1, sizes)
        best = cost.argmin(0)
        least = cost.min(0)
        rest = cost.copy()
        rest[best, np.arange(len(texts))] = np.inf
        after = rest.min(0)
        score = np.where(np.isinf(after), 1.0, 1 - least / np.where(np.isinf(after), 1, np.maximum(after, 1e-12)))
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, np.clip(score, 0, 1), 0.0)


@cache
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def samples(docs: DataFrame, count: int = SEGMENTS, length: int = SEGMENT, most: int = ALL_SEGMENTS) -> tuple[tuple[str, str], ...]:
    """Each language's sample text: at most `count` segments of a language and about `most` of all. Only minima of hashes are gathered over all texts, then the chosen segments."""
    own = docs.where("lang is not null and text is not null and doc_id is not null").where(fold() % 4 != 2).select("lang", "text", F.col("doc_id").cast("long").alias("doc_id"))
    languages = own.select("lang").distinct().limit(most + 1).count()
    if languages > most:
        raise ValueError(f"more than {most} languages; raise `most`, each worker holds all their samples")
    count = max(1, min(count, most // max(1, languages)))
    pieces = own.select("lang", "doc_id", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / length).cast("int"))).alias("part"))
    hashes = pieces.withColumn("hash", F.xxhash64("doc_id", "part"))
    least = hashes.groupBy("lang", F.pmod("hash", F.lit(count)).alias("class")).agg(F.min("hash").alias("hash"))
    least = hashes.join(F.broadcast(least), ["lang", "hash"]).select("lang", "class", "doc_id", "part").distinct()  # about `most` rows, at most
    text = F.substring(F.col("text"), F.col("part") * length + 1, F.lit(length))
    chosen = own.join(F.broadcast(least), ["lang", "doc_id"]).groupBy("lang", "class").agg(F.min(text).alias("text"))
    by: dict[str, list[str]] = {}
    for r in sorted(chosen.collect()):
        by.setdefault(r.lang, []).append(r.text)
    return tuple((k, "\n".join(by[k])) for k in sorted(by))


def predict(docs: DataFrame, learned: tuple[tuple[str, str], ...]) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(learned)
        for batch in sliced(batches):
            names, scores = [], []
            for block in blocks([t or "" for t in batch.column(1).to_pylist()]):
                a, b = own.predict(block)
                names += a
                scores.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(fold() % 4 == 2, F.lit(False))
    return predict(docs, samples(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
