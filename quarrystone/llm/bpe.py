"""Byte-level BPE: class arrays and a scan of transition functions find the pieces, cached pair merging turns them into ids.

Pieces: every code point becomes a class (letter, number, space, other white space, anything else, an apostrophe that
opens a contraction of two or three characters, end of text). Each class is a function from state to state; composing
functions is associative, so blocks of a concatenation of many texts are scanned side by side (`states`). State and class
then tell whether a piece starts at a code point. No regular expression runs.

Edge cases. A null text counts as empty: no ids, digests of nothing. Texts of any length are encoded whole; a piece of
thousands of bytes is merged with a heap. Repeated rows give repeated results. Extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import documents, sliced

L, N, P, W, O, C2, C3, E = range(8)  # noqa: E741
STATES = S_E, S_L, S_N, S_P, S_W, S_O, S_K2, S_K1, S_KE = range(9)
END = sys.maxunicode + 1
BLOCK = 256
#: Pieces a worker remembers; beyond that it starts anew.
CACHED = 200_000


def steps() -> np.ndarray:
    """State after a class, for every state before it."""
    t = np.zeros((9, 8), np.uint8)
    t[:, [L, N, P, W, O, C2, C3, E]] = S_L, S_N, S_P, S_W, S_O, S_K1, S_K2, S_E
    t[S_K2, L], t[S_K1, L] = S_K1, S_KE
    t[[S_P, S_O], C2] = t[[S_P, S_O], C3] = S_O
    return t


def starts() -> np.ndarray:
    """Whether a class that is not white space starts a piece, for every state before it."""
    b = np.ones((9, 8), bool)
    b[[S_L, S_P, S_K2, S_K1], L] = b[[S_N, S_P], N] = False
    for c in (O, C2, C3):
        b[[S_O, S_P], c] = False
    return b


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of code points; the monoid that the classes' functions generate: its members, products and generators; starts()."""
    classes = np.full(END + 1, O, np.uint8)
    every = "".join(chr(x) for x in range(END) if not 0xD800 <= x < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    for name, c in (("L", L), ("N", N), ("White_Space", W)):  # from the library to be matched, as versions of Unicode differ in what they assign
        found = tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}", mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        classes[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = c
    classes[0x20], classes[END] = P, E
    t = steps()
    members = [tuple(range(9))]
    generators = [tuple(t[:, c]) for c in range(8)]
    for m in members:
        members += dict.fromkeys(x for g in generators if (x := tuple(g[s] for s in m)) not in members)
    members = list(dict.fromkeys(members))
    index = {m: i for i, m in enumerate(members)}
    product = np.array([[index[tuple(b[s] for s in a)] for b in members] for a in members], np.uint8)
    return classes, np.array(members, np.uint8), product, np.array([index[g] for g in generators], np.uint8), starts()


def states(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol, by a blocked scan: blocks compose their functions side by side, then replay from their own first states."""
    _, members, product, generators, _ = tables()
    n = len(symbols)
    rows = -(-n // BLOCK)
    s = np.full(rows * BLOCK, E, np.uint8)
    s[:n] = symbols
    s = np.ascontiguousarray(s.reshape(rows, BLOCK).T)
    g = generators[s]
    f = g[0]
    for j in range(1, BLOCK):
        f = product[f, g[j]]
    first = np.zeros(rows, np.uint8)
    if rows > BLOCK:  # the same scan over blocks of blocks
        k = -(-rows // BLOCK)
        fs = np.zeros(k * BLOCK, np.uint8)  # 0 is the identity
        fs[:rows] = f
        fs = np.ascontiguousarray(fs.reshape(k, BLOCK).T)
        whole = fs[0]
        for j in range(1, BLOCK):
            whole = product[whole, fs[j]]
        state, heads = S_E, np.zeros(k, np.uint8)
        for i, m in enumerate(whole.tolist()):
            heads[i], state = state, members[m, state]
        inner = np.empty((BLOCK, k), np.uint8)
        for j in range(BLOCK):
            inner[j], heads = heads, members[fs[j], heads]
        first = inner.T.reshape(-1)[:rows].copy()
    else:
        state = S_E
        for i, m in enumerate(f.tolist()):
            first[i], state = state, members[m, state]
    t, out, now = steps(), np.empty((BLOCK, rows), np.uint8), first
    for j in range(BLOCK):
        out[j] = now
        now = t[now, s[j]]
    return out.T.reshape(-1)[:n]


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts with an end mark after each, where pieces start in that, and where each text's mark stands."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    marks = np.cumsum([len(t) + 1 for t in texts]) - 1
    points[marks] = END
    classes, *_, start = tables()
    symbols = classes[points]
    quotes = np.flatnonzero(points == ord("'"))
    if len(quotes):
        after = np.concatenate([points, np.full(2, END, np.uint32)])
        a, b = after[quotes + 1], after[quotes + 2]
        is2 = np.isin(a, [ord(c) for c in "stmd"])
        is3 = (b == ord("e")) & np.isin(a, [ord("r"), ord("v")]) | (a == ord("l")) & (b == ord("l"))
        symbols[quotes[is2]], symbols[quotes[is3]] = C2, C3
    begins = start[states(symbols), symbols]
    white = (symbols == P) | (symbols == W)
    spots = np.flatnonzero(white)
    before = np.where(spots > 0, white[spots - 1], False)
    after = symbols[np.minimum(spots + 1, len(symbols) - 1)]
    begins[spots] = ~before | (after != P) & (after != W) & (after != E)
    begins[marks] = True
    return joined, np.flatnonzero(begins), marks


class ByteBPE:
    """Ranks of a byte-level vocabulary; encodes and decodes as its reference library does, without special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        self.words = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for word, rank in self.ranks.items():
            self.words[rank] = word
        self.seen = _Merged(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: the adjacent pair of lowest rank is merged, leftmost first, until none is left."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return self.merge_long(piece) if len(piece) > 128 else self.merge_short(piece)

    def merge_short(self, piece: bytes) -> list[int]:
        rank, never, cuts = self.ranks.get, len(self.words), list(range(len(piece) + 1))
        pairs = [rank(piece[i : i + 2], never) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) < never:
            i = pairs.index(low)
            del cuts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = rank(piece[cuts[i - 1] : cuts[i + 1]], never)
            if i < len(pairs):
                pairs[i] = rank(piece[cuts[i] : cuts[i + 2]], never)
        return [self.ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merge_long(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        ends, back, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = ends[i]
            if not alive[i] or j >= n or ends[j] != end:
                continue
            alive[j], ends[i] = 0, end
            if end < n:
                back[end] = i
                if (r := ranks.get(piece[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (k := back[i]) >= 0 and (r := ranks.get(piece[k:end])) is not None:
                heapq.heappush(heap, (r, k, end))
        return [ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]

    def pieces(self, texts: list[str]) -> Iterator[tuple[list[tuple[tuple[int, ...], str]], list[int]]]:
        """For each text its pieces' ids, once as numbers and once as text, and the code point offsets at which the pieces start."""
        joined, at, marks = boundaries(texts)
        cuts = np.searchsorted(at, marks)
        spots = at.tolist()
        low = first = 0
        for k, mark in zip(cuts.tolist(), marks.tolist(), strict=True):
            own = spots[low : k + 1]
            yield [*map(self.seen.__getitem__, [joined[a:b] for a, b in zip(own, own[1:], strict=False)])], [x - first for x in own[:-1]]
            low, first = k + 1, mark + 1
            if len(self.seen) > CACHED:
                self.seen.clear()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[*chain.from_iterable(ids for ids, _ in found)] for found, _ in self.pieces(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


class _Merged(dict):
    def __init__(self, codec: ByteBPE) -> None:
        self.codec = codec

    def __missing__(self, piece: str) -> tuple[tuple[int, ...], str]:
        ids = tuple(self.codec.merge(piece.encode("utf-8", "surrogatepass")))
        found = self[piece] = ids, ",".join(map(str, ids))
        return found


@cache
def codec(path: str) -> ByteBPE:
    """The vocabulary at a path, read once in each worker."""
    return ByteBPE(path)


def blocks(texts: list[str], most: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of texts of some code points together, so that memory doesn't grow with a batch."""
    block, n = [], 0
    for t in texts:
        if block and n + len(t) > most:
            yield block
            block, n = [], 0
        block.append(t)
        n += len(t)
    if block:
        yield block


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, ids array<int>, offsets array<int>: where each piece starts, in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, offsets = [], []
            for block in blocks(texts):
                for found, at in codec(path).pieces(block):
                    ids.append([*chain.from_iterable(x for x, _ in found)])
                    offsets.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int32()))], [id_column, "ids", "offsets"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """id, decoded binary: the bytes of ids array<int>; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec(path).decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], [id_column, "decoded"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, "ids").mapInArrow(run, f"`{id_column}` {kind}, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the ids of every whole text, and the bytes that those ids give back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = codec(path), hashlib.sha256
        for batch in sliced(batches):
            counts, ids_sha, text_sha = [], [], []
            for block in blocks([t or "" for t in batch.column(1).to_pylist()]):
                for found, _ in own.pieces(block):
                    ids = [*chain.from_iterable([x for x, _ in found])]
                    counts.append(len(ids))
                    ids_sha.append(sha(",".join([s for _, s in found]).encode()).hexdigest())
                    text_sha.append(sha(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def checked(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """docs with the text replaced by ids array<int>, n_tokens, and round_trip: whether the ids decode to the text's bytes (empty for null)."""
    names = [c for c in docs.columns if c != text_column]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(text_column).to_pylist()]
            low = 0
            for block in blocks(texts, 250_000):
                ids = own.encode(block)
                same = [own.decode(x) == t.encode("utf-8", "surrogatepass") for x, t in zip(ids, block, strict=True)]
                part = batch.slice(low, len(block))
                low += len(block)
                flat = np.fromiter(chain.from_iterable(ids), np.int32)
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)), pa.array([len(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())], [*names, "ids", "n_tokens", "round_trip"])

    return docs.mapInArrow(run, f"{kinds}, ids array<int>, n_tokens long, round_trip boolean")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
