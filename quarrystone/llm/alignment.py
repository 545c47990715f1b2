"""Alignment of the tokens that two tokenizers make of the same bytes.

Both token sequences are arrays of byte offsets at which tokens end. Offsets where both end cut the bytes into groups. Runs
of groups with one token of either side are diagonals: index j of one array follows index i of the other at a fixed shift.
They are skipped by exponential probing: windows of 1, 2, 4, ... ends are compared at the current shift until one differs.
What follows is an irregular group; its ends are merged until both sides meet, and the shift is updated. All texts of a block
are walked through together, cut at offsets where both sides end, so each step of the loop serves many stretches at once.

A link is a pair of token occurrences whose bytes overlap. The count of an id pair is its links in the whole corpus. Blocks
of texts keep their distinct id pairs once, with the links of each text as numbers into them, so a pair reaches the
corpus-wide count once a block and a block gets the counts of its own pairs back: what moves grows with blocks, not
with links, and no task holds more than a block.

Tokenizers are given by the paths of their files: a byte-level BPE (vocabulary in JSON), whose merges are taken in
the order of ids, and a SentencePiece model. A text goes to the first with a space before it, as the second adds one.

Edge cases. Null and empty texts, and texts whose tokens don't spell the very bytes (as when white space is normalised), have
no tokens: zeros and ''. A very long text is a block of its own. Rows that share an id, or have none, stay rows of their own;
repeated rows count again. Ties for the highest count all count. An empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import documents, sliced, stored

#: Characters and rows of a block at most, about; a longer text is a block of its own.
BLOCK, ROWS = 4_000_000, 20_000
#: Tokens of the first side between cuts of a block, about, and how far to look for a cut.
STRETCH, REACH = 512, 64
#: Words of a line that is encoded in one call.
LINE = 1_000


class Alignment:
    """Groups of two arrays of end offsets (strictly ascending, with the same last one) as ends of groups in either array."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b = a, b
        runs, lone = self._walk(*self._cuts())
        #: Groups of one token each: where they are in both arrays.
        self.single = tuple(np.concatenate([np.repeat(x[:, k], x[:, 2]) + _count(x[:, 2]) for x in runs] or [np.zeros(0, np.int64)]) for k in (0, 1))
        irregular = np.concatenate(lone or [np.zeros((0, 4), np.int64)])
        self.irregular = irregular[np.argsort(irregular[:, 0], kind="stable")]
        self.ends = tuple(np.sort(np.concatenate([self.single[k] + 1, self.irregular[:, k + 2]]), kind="stable") for k in (0, 1))

    def _cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of stretches: after an offset where both sides end, near each STRETCH-th token."""
        a, b = self.a, self.b
        near = np.arange(STRETCH - 1, len(a) - 1, STRETCH)
        at, found = near.copy(), np.zeros(len(near), bool)
        for _ in range(REACH):
            j = np.minimum(np.searchsorted(b, a[at]), len(b) - 1)
            found = b[j] == a[at]
            if found.all():
                break
            at = np.where(found, at, np.minimum(at + 1, len(a) - 1))
        at = at[found]
        start = np.unique(np.concatenate([np.zeros(min(1, len(a)), np.int64), at[at < len(a) - 1] + 1]))
        return start, np.searchsorted(b, np.concatenate([[0], a])[start], side="right")

    def _walk(self, i: np.ndarray, j: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """([i, j, length] of one-to-one runs, [i, j, end of i, end of j] of irregular groups)."""
        a, b = self.a, self.b
        stop = np.append(i[1:], len(a))
        runs, lone = [], []
        while len(i):
            length, probing, width = np.zeros(len(i), np.int64), np.arange(len(i)), 1
            while len(probing):
                step = np.arange(width)
                x, y = (s[probing] + length[probing] for s in (i, j))
                ahead = x[:, None] + step
                same = (ahead < stop[probing][:, None]) & (a[np.minimum(ahead, len(a) - 1)] == b[np.minimum(y[:, None] + step, len(b) - 1)])
                whole = same.all(1)
                length[probing] += np.where(whole, width, np.argmin(same, 1))
                probing, width = probing[whole], 2 * width
            if (some := length > 0).any():
                runs.append(np.stack([i[some], j[some], length[some]], 1))
            i, j = i + length, j + length
            on = i < stop
            i, j, stop = i[on], j[on], stop[on]
            if not len(i):
                break
            x, y, apart = i.copy(), j.copy(), np.arange(len(i))
            while len(apart := apart[a[x[apart]] != b[y[apart]]]):
                behind = a[x[apart]] < b[y[apart]]
                x[apart] += behind
                y[apart] += ~behind
            lone.append(np.stack([i, j, x + 1, y + 1], 1))
            on = x + 1 < stop
            i, j, stop = x[on] + 1, y[on] + 1, stop[on]
        return runs, lone

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of tokens that overlap: one-to-one groups as they are, irregular ones by the pieces that their ends cut."""
        a, b = self.a, self.b
        w = self.irregular
        ia = np.repeat(w[:, 0], w[:, 2] - w[:, 0]) + _count(w[:, 2] - w[:, 0])
        ib = np.repeat(w[:, 1], w[:, 3] - w[:, 1]) + _count(w[:, 3] - w[:, 1])
        piece = np.concatenate([a[ia], b[ib]])
        piece.sort(kind="stable")  # two ascending runs
        piece = piece[np.diff(piece, prepend=-1) > 0]
        return np.concatenate([self.single[0], np.searchsorted(a, piece)]), np.concatenate([self.single[1], np.searchsorted(b, piece)])


def _count(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs of given sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Spelling:
    """Token ids as decimal text with a separator, joined without a loop."""

    def __init__(self, most: int) -> None:
        names = [str(i).encode() for i in range(most)]
        self.width = len(names[-1]) + 1 if names else 1
        self.length = np.array([len(n) for n in names], np.int64)
        self.table = np.frombuffer(b"".join(n.ljust(self.width, b"\0") for n in names), np.uint8).reshape(most, self.width)

    def text(self, ids: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All ids, each followed by its mark, and the offset after each."""
        n = self.length[ids]
        cells = self.table[ids]
        cells[np.arange(len(ids)), n] = marks
        return cells[np.arange(self.width) <= n[:, None]].tobytes(), np.cumsum(n + 1)


def byte_of() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


NONE = np.zeros(0, np.int64)
#: White space before a space or at the end, or a space at the beginning.
_LOOSE = re.compile(r"\s(?: |\Z)|\A ")


class Ragged:
    """Arrays of unlike sizes in one."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values, self.sizes = values, sizes

    @staticmethod
    def joined(parts: list[Ragged]) -> Ragged:
        return Ragged(np.concatenate([NONE, *(p.values for p in parts)]), np.concatenate([NONE, *(p.sizes for p in parts)]))

    def taken(self, which: np.ndarray) -> np.ndarray:
        """The values of the arrays of given numbers, in that order."""
        start, sizes = (np.cumsum(self.sizes) - self.sizes)[which], self.sizes[which]
        return self.values[np.repeat(start, sizes) + _count(sizes)]


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, first: str, second: str, pattern: str) -> None:
        import sentencepiece
        import tiktoken

        letters = byte_of()
        with open(first, encoding="utf-8") as file:
            own = json.load(file)
        special = {t["content"] for t in own["added_tokens"]}
        ranks = {bytes(letters[c] for c in name): i for name, i in own["model"]["vocab"].items() if name not in special}
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for name, i in ranks.items():
            self.a_bytes[i] = name
        self.a = tiktoken.Encoding("first", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.spelling = Spelling(max(len(self.a_bytes), len(self.b_bytes)))

        #: Whether no piece goes on over a space after another character.
        self.apart = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(len(self.b_bytes)))

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides, or None if either doesn't spell the text with a space before it."""
        want = b" " + text.encode("utf-8", "surrogatepass")
        b = self.b.encode(text, num_threads=1)
        if b"".join([self.b_bytes[i] for i in b]) != want:
            return None
        a = self.a.encode_ordinary(" " + text)
        if b"".join([self.a_bytes[i] for i in a]) != want:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def words(self, words: list[str]) -> list[Ragged]:
        """Ids of each word on both sides, words encoded in lines; none for words that aren't spelled."""
        out: list[list[Ragged]] = [[], []]

        def line(some: list[str]) -> None:
            got = self.encoded(" ".join(some))
            if got is None and len(some) > 1:
                line(some[: len(some) // 2])
                line(some[len(some) // 2 :])
                return
            ends = np.cumsum([1 + len(w.encode("utf-8", "surrogatepass")) for w in some])
            for k, size in enumerate((self.a_size, self.b_size)):
                ids = NONE if got is None else got[k]
                cut = np.searchsorted(np.cumsum(size[ids]), ends, side="right") if len(ids) else np.zeros(len(some), np.int64)
                out[k].append(Ragged(ids, np.diff(cut, prepend=0)))

        for at in range(0, len(words), LINE):
            line(words[at : at + LINE])
        return [Ragged.joined(x) for x in out]

    def tokens(self, texts: list[str | None]) -> list[Ragged]:
        """Ids of each text on both sides; none where either doesn't spell the text.

        Neither side has a token over a space between two characters that are no white space, so texts are cut there and
        each distinct word of a block is encoded once. Texts with other runs of white space, or with a word that isn't
        spelled, are encoded whole.
        """
        cells, odd = [], []
        for k, text in enumerate(texts):
            if text and self.apart and not _LOOSE.search(text):
                cells.append(text.split(" "))
            else:
                cells.append([])
                if text:
                    odd.append(k)
        number, distinct = pd.factorize(np.array([w for c in cells for w in c], object))
        sides = self.words(distinct.tolist())
        upto = np.concatenate([[0], np.cumsum([len(c) for c in cells])])
        bare = np.flatnonzero((sides[0].sizes == 0)[number])
        for k in sorted({*odd, *(np.searchsorted(upto, bare, side="right") - 1).tolist()}):
            cells[k] = self.encoded(texts[k]) or (NONE, NONE)
        return [self._side(s, i, number, upto, cells) for i, s in enumerate(sides)]

    @staticmethod
    def _side(words: Ragged, side: int, number: np.ndarray, upto: np.ndarray, cells: list) -> Ragged:
        """The words' ids in the order of the texts, whole texts' ids among them."""
        parts, sizes, at = [], np.zeros(len(cells), np.int64), 0
        whole = [k for k, c in enumerate(cells) if isinstance(c, tuple)]
        for k in [*whole, len(cells)]:
            some = number[upto[at] : upto[k]]
            ids = words.taken(some)
            per = np.concatenate([[0], np.cumsum(words.sizes[some])])[upto[at : k + 1] - upto[at]]
            sizes[at:k] = np.diff(per)
            parts.append(ids)
            if k < len(cells):
                parts.append(cells[k][side])
                sizes[k] = len(cells[k][side])
            at = k + 1
        return Ragged(np.concatenate([NONE, *parts]), sizes)


FIELDS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
NAMES = [f.split(" ")[0] for f in FIELDS.split(", ")]


class Block:
    """Texts aligned together."""

    def __init__(self, tools: Tokenizers, texts: list[str | None]) -> None:
        self.tools = tools
        sides = tools.tokens(texts)
        self.counts, (self.a, self.b) = [s.sizes for s in sides], [s.values for s in sides]
        self.aligned = Alignment(np.cumsum(tools.a_size[self.a]), np.cumsum(tools.b_size[self.b]))
        #: Where each text's tokens end in either array, and its groups.
        self.upto = tuple(np.cumsum(c) for c in self.counts)
        self.groups = np.searchsorted(self.aligned.ends[0], self.upto[0], side="right")

    def hashes(self) -> list[str]:
        """Of each text the sha256 of its groups written out; '' without tokens."""
        ends = self.aligned.ends
        before = tuple(np.concatenate([[0], e[:-1]]) if len(e) else NONE for e in ends)
        of_a, of_b = (np.repeat(np.arange(len(e)), e - b) for e, b in zip(ends, before, strict=True))
        place_a, place_b = np.arange(len(self.a)) + before[1][of_a], np.arange(len(self.b)) + ends[0][of_b]
        ids, marks = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        marks[place_a[ends[0] - 1]], marks[place_b[ends[1] - 1]] = ord("|"), ord(";")
        text, offset = self.tools.spelling.text(ids, marks)
        cut = np.concatenate([[0], offset])[np.concatenate([[0], self.upto[0] + self.upto[1]])].tolist()
        view = memoryview(text)
        return [hashlib.sha256(view[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(cut, cut[1:], strict=False)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """(ids a, ids b, links) of the block's distinct pairs; of each text its pairs' numbers and links, as bytes, and the number of its links."""
        ia, ib = self.aligned.links()
        number, keys = pd.factorize(self.a[ia] << 32 | self.b[ib])
        text = np.searchsorted(self.upto[0], ia, side="right")
        which, cells = pd.factorize(text << 32 | number)
        times = np.bincount(which, minlength=len(cells))
        order = np.argsort(cells)
        own, times, cut = (cells[order] & 0xFFFFFFFF).astype(np.uint32), times[order].astype(np.uint32), np.searchsorted(cells[order] >> 32, np.arange(len(self.groups) + 1)).tolist()
        packed = [np.diff(own[p:q], prepend=np.uint32(0)).tobytes() + times[p:q].tobytes() for p, q in zip(cut, cut[1:], strict=False)]
        return keys >> 32, keys & 0xFFFFFFFF, np.bincount(number, minlength=len(keys)), packed, np.bincount(text, minlength=len(self.groups))


def aligned(df: DataFrame, first: str, second: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(FIELDS, block, links; block, number, a, b, n) of df (doc_id, text): links are (number, times) of a block's id pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, part, count = Tokenizers(first, second, pattern), TaskContext.get().partitionId(), 0
        names = ["kind", "block", *NAMES, "links", "number", "a", "b", "n"]

        def block(ids: list[int | None], texts: list[str | None]) -> Iterator[pa.RecordBatch]:
            own = Block(tools, texts)
            a, b, n, packed, links = own.pairs()
            rows, groups = len(ids), np.diff(own.groups, prepend=0)
            name = pa.array([f"{part}-{count}"] * max(rows, len(a)), pa.string())
            fill = lambda m, kinds: [pa.nulls(m, t) for t in kinds]
            fields = [own.counts[0], own.counts[1], groups, links]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int32)), name[:rows], pa.array(ids, pa.int64()), *(pa.array(f.astype(np.int64)) for f in fields), pa.array(own.hashes(), pa.string()), pa.array(packed, pa.binary()), *fill(rows, [pa.int32()] * 3 + [pa.int64()])], names)
            m = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), name[:m], *fill(m, [pa.int64()] * 5 + [pa.string(), pa.binary()]), pa.array(np.arange(m, dtype=np.int32)), *(pa.array(x.astype(np.int32)) for x in (a, b)), pa.array(n.astype(np.int64))], names)

        ids, texts, size = [], [], 0
        for batch in sliced(batches, 500):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text or "")
                if size >= BLOCK or len(ids) >= ROWS:
                    yield from block(ids, texts)
                    ids, texts, size, count = [], [], 0, count + 1
        if ids:
            yield from block(ids, texts)

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = stored(rows.mapInArrow(run, f"kind int, block string, {FIELDS}, links binary, number int, a int, b int, n long"), "aligned")
    return table.where("kind = 0").select(*NAMES, "block", "links"), table.where("kind = 1").select("block", "number", "a", "b", "n")


def counted(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """FIELDS with n_best and count_sum, from the counts of each block's id pairs in all blocks."""
    counts = stored(pairs.groupBy("a", "b").agg(F.sum("n").alias("total")), "counts")
    best = counts.groupBy("b").agg(F.max("total").alias("most"))  # a row an id of the second vocabulary
    marked = counts.join(best, "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("best"))
    own = pairs.join(marked, ["a", "b"]).select(F.col("block").alias("of"), "number", "total", "best")

    def total(block: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known["number"].to_numpy())
        value, top = known["total"].to_numpy()[order], known["best"].to_numpy()[order]
        sums, tops = [], []
        for raw in block["links"].to_pylist():
            step, times = np.frombuffer(raw, np.uint32).reshape(2, -1).astype(np.int64)
            at = np.cumsum(step)
            sums.append(int((value[at] * times).sum()))
            tops.append(int(times[top[at]].sum()))
        return pa.table([*(block[n] for n in NAMES), pa.array(tops, pa.int64()), pa.array(sums, pa.int64())], [*NAMES, "n_best", "count_sum"])

    return texts.groupBy("block").cogroup(own.groupBy("of")).applyInArrow(total, f"{FIELDS}, n_best long, count_sum long")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted(*aligned(documents(spark, sf_dir), *paths, public_tokenizers.PATTERN))
