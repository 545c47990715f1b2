"""Whole documents as streams of blocks: a fold over sorted rows that keeps its state from batch to batch.

Blocks of a document come in order within one partition, and a fold sees them once. What it keeps is the headings above, the group in
hand and the units of the chunk that isn't full yet, so a document of any number of blocks takes the memory of a chunk. Neither a
group of rows nor a text of the whole document is ever formed.

Rules. A heading of level n ends all headings of level n and beyond. Text blocks under equal paths form a group, a table is one of its
own. Units (text blocks; rows of a table) are packed in order: a chunk ends before a unit with which it would exceed `most`
tokens, or when it has `target`. A unit of more than `most` is cut alone (chunks.pieces) and marked. Tokens are counted by a
function of the path and the content, so a counter can add what is embedded with the content.

Edge cases. Blocks without text and units without a cell are left out; null positions come first; blocks of one position are in
order of kind and text. A null document id is a document. Headings without a level are text. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.chunks import MOST, TARGET, padded, pieces

Counter = Callable[[list[str], str], int]
#: Rows of blocks and of chunks that a task holds as Python objects at once.
ROWS = 1_000


def code_points(path: list[str], content: str) -> int:
    return len(content)


class Fold:
    """Chunks of blocks that are given in order; `take` returns those that are complete."""

    def __init__(self, count: Counter, target: int, most: int) -> None:
        if not 0 < target <= most:
            raise ValueError("token limits must satisfy 0 < target <= most")
        self.count, self.target, self.most = count, target, most
        self.key: object = None
        self.begun = False
        self._restart()

    def _restart(self) -> None:
        self.heads: dict[int, str] = {}
        self.path: list[str] = []
        self.kind, self.number = "", 0
        self.units: list[str] = []
        self.span = (0, 0)

    def _chunk(self, content: str, first: int, last: int, cut: bool) -> tuple:
        self.number += 1
        return (self.key, self.number, self.kind, list(self.path), content, self.count(self.path, content), first, last, cut)

    def _flush(self) -> list[tuple]:
        if not self.units:
            return []
        content, self.units = "\n".join(self.units), []
        return [self._chunk(content, *self.span, False)]

    def _unit(self, text: str, at: int) -> list[tuple]:
        out: list[tuple] = []
        joined = "\n".join([*self.units, text])
        if self.units and (self.count(self.path, joined) > self.most or self.count(self.path, "\n".join(self.units)) >= self.target):
            out += self._flush()
        if self.count(self.path, text) > self.most:
            out += self._flush()
            if self.count(self.path, "") >= self.most:
                raise ValueError("what is counted beside the content alone reaches the limit")
            return out + [self._chunk(p, at, at, True) for p in pieces(text, lambda t: self.count(self.path, t), self.target, self.most)]
        self.span = (self.span[0] if self.units else at, at)
        self.units.append(text)
        return out

    def take(self, key: object, at: int, kind: str, level: int | None, text: str | None, rows: list[list[str]] | None) -> list[tuple]:
        """Chunks that this block completes."""
        out: list[tuple] = []
        if not self.begun or key != self.key:
            out += self._flush()
            self._restart()
            self.key, self.begun = key, True
        if kind == "table":
            out += self._flush()
            self.kind, self.path = "table", [self.heads[n] for n in sorted(self.heads)]
            units = [" | ".join((c or "").strip() for c in r) for r in rows or () if any((c or "").strip() for c in r)]
            for unit in units or ([text.strip()] if text and text.strip() else []):
                out += self._unit(unit, at)
            out += self._flush()
            self.kind = ""
            return out
        if not text or not text.strip():
            return out
        if kind == "heading" and level is not None:
            self.heads = {n: h for n, h in self.heads.items() if n < level} | {level: text}
        path = [self.heads[n] for n in sorted(self.heads)]
        if self.kind != "text" or path != self.path:
            out += self._flush()
            self.kind, self.path = "text", path
        return out + self._unit(text, at)

    def end(self) -> list[tuple]:
        return self._flush()


def chunked_blocks(blocks: DataFrame, key: str = "doc_id", count: Counter = code_points, target: int = TARGET, most: int = MOST, prefix: str = "D") -> DataFrame:
    """key, chunk_id, position, kind, path, content, tokens, first, last, cut of blocks (key, position, kind, level, text, rows).

    One shuffle and one sort, both of blocks; a document is read by one task, as it comes.
    """
    id_type = blocks.schema[key].dataType
    rows = F.col("rows").cast("array<array<string>>") if "rows" in blocks.columns else F.lit(None).cast("array<array<string>>")
    df = blocks.select(key, F.col("position").cast("int").alias("position"), F.coalesce("kind", F.lit("")).alias("kind"), F.col("level").cast("int").alias("level"), F.col("text").cast("string").alias("text"), rows.alias("rows"))
    names = [key, "position", "kind", "path", "content", "tokens", "first", "last", "cut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, kept, types = Fold(count, target, most), [], None

        def sent(some: list[tuple]) -> pa.RecordBatch:
            kinds = [types, pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            types = batch.schema.field(0).type
            for at in range(0, batch.num_rows, ROWS):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True):
                    kept += fold.take(*row)
                    if len(kept) >= ROWS:
                        yield sent(kept)
                        kept = []
        kept += fold.end()
        if kept:
            yield sent(kept)

    ordered = df.repartition(key).sortWithinPartitions(key, "position", "kind", "text")
    found = ordered.mapInArrow(run, f"`{key}` {id_type.simpleString()}, position int, kind string, path array<string>, content string, tokens int, first int, last int, cut boolean")
    name = F.concat(F.lit(prefix), padded(F.col(key), 6), F.lit("_C"), padded(F.col("position"), 4))
    return found.select(key, name.alias("chunk_id"), *names[1:])
