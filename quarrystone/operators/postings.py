"""Postings in packs: the terms of many documents, scored against packs of queries by a task that has all parts of its documents' scores.

`counted` turns documents' words into a row of terms and frequencies each, so texts are read once. A pack is a row of up to `DOCS` documents
or `QUERIES` queries. Scores are summed over a document's terms in their order and never leave the task but for each query's k best of a pack.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Documents, postings and queries of a pack; parts of scores that are held at once; and the distance below the k-th score within which others may be equal when rounded.
DOCS, POSTINGS, QUERIES, PARTS, MARGIN = 2_048, 500_000, 512, 4_000_000, 2e-6
#: Bytes of texts whose terms are counted at once, but for a single longer text.
TEXTS = 8_000_000
#: What is between terms, and what terms are cut into pairs for: as in search.terms.
BETWEEN, PAIRED = r"[^\pL\pN]+", r"\p{Han}{2}"


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All elements, and the place of the row of each."""
    return column.flatten(), pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _listed(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def _slices(batch: pa.RecordBatch, sizes: pa.Array, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows and so much of their sizes, but for single larger rows."""
    ends, at = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))))
        yield batch.slice(at, end - at)
        at = end


@lru_cache(1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether terms hold it and whether it is Han, as the patterns say."""
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    texts, out = pa.array([chr(c) for c in points]), []
    for pattern in (rf"^{BETWEEN.removesuffix('+')}", rf"^{PAIRED.removesuffix('{2}')}"):
        kind = np.zeros(0x110000, bool)
        kind[points] = pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
        out.append(kind)
    out[0][points] = ~out[0][points]
    return out[0], out[1]


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms of lower-case texts, as search.terms has them, and the place of the text of each.

    Bytes are looked up in a table instead of matched by a pattern; terms are the kept bytes, cut where a run of them ends.
    """
    held, han = _kinds()
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    body = texts.buffers()[2]
    data = np.concatenate([np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8), np.zeros(3, np.uint8)])
    offsets = offsets - offsets[0]
    keep = np.concatenate([held[:128], np.zeros(128, bool)])[data]
    lead, runs = np.flatnonzero(data >= 0xC0), []
    for more, low, high in ((1, 0xC0, 0xE0), (2, 0xE0, 0xF0), (3, 0xF0, 0xF8)):
        at = lead[(data[lead] >= low) & (data[lead] < high)]
        point = data[at].astype(np.int32) & (0x3F >> more)
        for j in range(1, more + 1):
            point = point << 6 | data[at + j] & 0x3F
        point = np.minimum(point, 0x10FFFF)
        for j in range(more + 1):
            keep[at[held[point]] + j] = True
        runs.append(at[han[point]])
    keep, data = keep[:-3], data[:-3]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # a text's first byte starts a term anew
    new, last = keep.copy(), keep.copy()
    new[1:] &= ~keep[:-1]
    new[edges] = keep[edges]
    last[:-1] &= ~keep[1:]
    last[edges - 1] = keep[edges - 1]
    starts = np.flatnonzero(new)
    sizes = np.flatnonzero(last) + 1 - starts
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[keep]))
    at = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, offsets)))
    maybe = np.unique(np.searchsorted(starts, np.concatenate(runs), "right") - 1)
    maybe = maybe[pc.match_substring_regex(found.take(pa.array(maybe)), PAIRED).to_numpy(zero_copy_only=False)] if len(maybe) else maybe
    if not len(maybe):
        return found, at
    pairs = [[w[i : i + 2] for i in range(len(w) - 1)] for w in found.take(pa.array(maybe)).to_pylist()]
    rest = np.ones(len(found), bool)
    rest[maybe] = False
    at = np.concatenate([at[rest], np.repeat(at[maybe], [len(p) for p in pairs])])
    return pa.concat_arrays([found.filter(pa.array(rest)), pa.array([w for p in pairs for w in p], found.type)]), at


def counted(docs: DataFrame, known: list[str] | None) -> DataFrame:
    """doc_id, length, terms, tfs of docs (doc_id, text in lower case): each known term of a text, as its place in known, with its frequency.

    If known is None, all terms, as texts.
    """
    kind, term = docs.schema["doc_id"].dataType.simpleString(), "string" if known is None else "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, pc.binary_length(batch.column("text")), DOCS, TEXTS):
                found, at = words(part.column("text"))
                length = np.bincount(at, minlength=part.num_rows)
                if known is None:
                    coded = found.dictionary_encode()
                    names, codes = coded.dictionary, coded.indices
                else:
                    names = pa.array(known, found.type)
                    codes = pc.index_in(found, names)
                codes = pc.fill_null(codes, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                n = max(len(names), 1)
                cells, tfs = np.unique(at[codes >= 0] * n + codes[codes >= 0], return_counts=True)
                sizes = np.bincount(cells // n, minlength=part.num_rows)
                terms = names.take(pa.array(cells % n)) if known is None else pa.array(cells % n, pa.int32())
                lists = [_listed(terms, sizes), _listed(pa.array(tfs, pa.int32()), sizes)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(length, pa.int32()), *lists], ["doc_id", "length", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, length int, terms array<{term}>, tfs array<int>")


def packed(rows: DataFrame) -> DataFrame:
    """docs, d, terms, tfs, lengths: packs of rows (doc_id, terms, tfs, lengths), each posting with its document's place d."""
    kind, term = rows.schema["doc_id"].dataType.simpleString(), rows.schema["terms"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, pc.list_value_length(batch.column("terms")), DOCS, POSTINGS):
                part = part.take(pc.sort_indices(part.column("doc_id"), null_placement="at_start"))
                terms, d = _lists(part.column("terms"))
                columns = [part.column("doc_id"), pa.array(d, pa.int32()), terms, part.column("tfs").flatten(), part.column("lengths").flatten()]
                yield pa.RecordBatch.from_arrays([_listed(c, np.array([len(c)])) for c in columns], ["docs", "d", "terms", "tfs", "lengths"])

    return rows.select("doc_id", "terms", "tfs", "lengths").mapInArrow(run, f"docs array<{kind}>, d array<int>, terms array<{term}>, tfs array<int>, lengths array<int>")


def asked(queries: DataFrame) -> DataFrame:
    """queries, names, gains, sizes, owners: packs of queries (query_id, asked: structs of term and idf), each term with the places of its queries."""
    kind, term = queries.schema["query_id"].dataType.simpleString(), queries.schema["asked"].dataType.elementType["term"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                each, q = _lists(part.column("asked"))
                coded = each.field("term").dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(codes, kind="stable")
                first = np.searchsorted(codes[order], np.arange(len(coded.dictionary)))
                gains = each.field("idf").take(pa.array(order[first]))
                columns = [part.column("query_id"), coded.dictionary, gains, pa.array(np.bincount(codes, minlength=len(first)), pa.int32()), pa.array(q[order], pa.int32())]
                yield pa.RecordBatch.from_arrays([_listed(c, np.array([len(c)])) for c in columns], ["queries", "names", "gains", "sizes", "owners"])

    return queries.select("query_id", "asked").mapInArrow(run, f"queries array<{kind}>, names array<{term}>, gains array<double>, sizes array<int>, owners array<int>")


def _scores(d: np.ndarray, part: np.ndarray, term: np.ndarray, sizes: np.ndarray, owners: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Sums by document and query of postings' parts, each going to all queries of its term."""
    first, n = np.cumsum(sizes) - sizes, sizes[term]
    ends, out, at = np.cumsum(n), np.zeros(shape[0] * shape[1]), 0
    while at < len(term):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PARTS, "right")))
        some = n[at:end]
        within = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
        q = owners[np.repeat(first[term[at:end]], some) + within]
        out += np.bincount(np.repeat(d[at:end], some) * shape[1] + q, np.repeat(part[at:end], some), len(out))
        at = end
    return out.reshape(shape)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of documents and queries: each query's k best by score to six digits, then by place; none without a score."""
    n = len(scores)
    least = np.partition(scores, n - k, axis=0)[n - k] if k < n else np.zeros(scores.shape[1])
    q, d = np.nonzero(((scores > 0) & (scores >= least - MARGIN)).T)
    order = np.lexsort((d, -np.floor(scores[d, q] * 1e6 + 0.5), q))
    q, d = q[order], d[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return d[keep], q[keep]


def best(pairs: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """query_id, doc_id, score of pairs of packs with `mean`, the mean length: each query's k best of each pack."""
    kinds = [pairs.schema[c].dataType.elementType.simpleString() for c in ("queries", "docs")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in ("docs", "d", "terms", "tfs", "lengths", "queries", "names", "gains", "sizes", "owners")}
                at = pc.fill_null(pc.index_in(row["terms"], row["names"]), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                use = at >= 0
                at = at[use]
                d, tf, length = (row[c].to_numpy(zero_copy_only=False)[use].astype(kind) for c, kind in (("d", np.int64), ("tfs", float), ("lengths", float)))
                part = row["gains"].to_numpy(zero_copy_only=False)[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / batch.column("mean")[i].as_py()))
                sizes, owners = (row[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sizes", "owners"))
                scores = _scores(d, part, at, sizes, owners, (len(row["docs"]), len(row["queries"])))
                d, q = _best(scores, k)
                yield pa.RecordBatch.from_arrays([row["queries"].take(pa.array(q)), row["docs"].take(pa.array(d)), pa.array(scores[d, q])], ["query_id", "doc_id", "score"])

    return pairs.mapInArrow(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
