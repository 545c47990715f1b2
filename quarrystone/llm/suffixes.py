"""Suffix-array dedup: bytes covered by a string of `LENGTH` bytes that an earlier document has, are removed.

Which strings must meet. Of the `LENGTH - GRAM + 1` grams of a string the one of least hash (leftmost of equals) is its
anchor, so equal strings have equal anchors. Strings of a document that start side by side and share an anchor form one
fragment. All that is exchanged first are hashes of anchors and fragments: a fragment that an earlier document has byte for
byte (64 or more hash bits agree) is repeated whole. What is left are unlike fragments of one anchor; their bytes are sent
once for each kind of fragment, by the first document that has it.

Suffix arrays. Fragments of an anchor lie in one buffer. Its suffixes are sorted by doubling, cut at `LENGTH` bytes, with
the common prefixes of neighbours. For each suffix the nearest ones before and after it in suffix order that belong to a
smaller document give its longest previous factor; where that reaches `LENGTH`, the string is repeated. Every string of a
document is decided that way or by its fragment, so later copies go and the first one stays.

Scale. Equal fragments within a batch are sent once. Anchors are dealt by hash; a task sorts arrays and doesn't mind how
often an anchor occurs. Texts meet their marks in small teams of documents.

Edge cases. Null text is empty; texts shorter than LENGTH lose nothing. Rows that share an id don't remove each other's
bytes. A null id counts as later than all others, also than 2^63 - 1. Empty tables give empty results; extra columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import RollingHash, documents, mixed, parts, sliced, stored
from quarrystone.llm.neardup import chunks

#: Longer grams make more anchors but fewer that texts share by chance; that share grows with the corpus.
LENGTH, GRAM = 50, 24
WIDTH = LENGTH - GRAM + 1
LAST = 2**63 - 1
#: Bytes of text that a worker looks at together, about.
CHUNK = 1_500_000
WHOLE = np.uint64(2**64 - 1)
ENTRY = np.dtype([("anchor", "<u4"), ("low", "<u4"), ("high", "<u2")])
MARKS = "team int, send boolean, ids binary, cids binary, masks binary"
NAMES = ["team", "send", "ids", "cids", "masks"]
#: Documents of a team, about: their texts and marks meet in one call. Small teams make even partitions.
TEAM = 150

_hash = RollingHash()
_u = np.uint64


class Fragments:
    """Fragments of a chunk of texts: of[i] its text, begin, windows (their number), anchor and content hashes."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        usable = np.maximum(0, sizes - LENGTH + 1)
        n = int(usable.sum())
        if not n:
            self.of = self.begin = self.windows = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, np.uint64)
            return
        prefix = _hash.prefix(self.data)
        at = np.arange(len(self.data) - GRAM + 1)
        grams = _hash.slices(prefix, at, at + GRAM)
        key = grams & ~_u(0xFFFFFFFF) | at.astype(np.uint64)
        least, width = key, 1
        while 2 * width <= WIDTH:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < WIDTH:
            least = np.minimum(least[: -(WIDTH - width)], least[WIDTH - width :])
        of = np.repeat(np.arange(len(texts)), usable)
        window = self.starts[of] + np.arange(n) - np.repeat(np.cumsum(usable) - usable, usable)
        anchor = (least[window] & _u(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        self.of, self.begin = of[first], window[first]
        self.windows = np.diff(np.append(first, n))
        self.anchor = grams[anchor[first]]
        self.content = _hash.slices(prefix, self.begin, self.begin + self.windows + LENGTH - 1)

    def cids(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bucket, anchor (32 bits), content (48 bits) and the id that stands for all three."""
        bucket = (self.anchor >> _u(40)) % _u(buckets)
        anchor, content = self.anchor & _u(0xFFFFFFFF), self.content & _u(2**48 - 1)
        return bucket, anchor, content, cid_of(bucket, anchor, content)


def cid_of(bucket: np.ndarray, anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    return mixed((bucket << _u(32) | anchor) * _u(0x9E3779B97F4A7C15) + content)


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before, in any key."""
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return new


def team_of(ids: np.ndarray, teams: int) -> np.ndarray:
    """A team for each id, by two rounds of shifts that Spark's columns can do alike."""
    x = ids.astype(np.uint64)
    for _ in range(2):
        x ^= x << _u(13)
        x ^= x >> _u(7)
        x ^= x << _u(17)
    return ((x >> _u(33)) % _u(teams)).astype(np.int32)


def teamed(docs: DataFrame, teams: int) -> DataFrame:
    """docs with the column that team_of gives."""
    for _ in range(2):
        for shift, by in ((F.shiftleft, 13), (F.shiftrightunsigned, 7), (F.shiftleft, 17)):
            docs = docs.withColumn("team", F.col("team" if "team" in docs.columns else "doc_id").bitwiseXOR(shift("team" if "team" in docs.columns else "doc_id", by)))
    return docs.withColumn("team", (F.shiftrightunsigned("team", 33) % teams).cast("int"))


def marks(docs: np.ndarray, cids: np.ndarray, masks: np.ndarray | None, send: bool, teams: int) -> pa.RecordBatch:
    """One row per team of documents. masks: None for whole fragments."""
    team = team_of(docs, teams)
    order = np.argsort(team, kind="stable")
    docs, cids, team = docs[order], cids[order], team[order]
    first = np.flatnonzero(runs(team))
    cut = [*first.tolist(), len(docs)]
    split = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
    masked = pa.nulls(len(first), pa.binary()) if masks is None else split(masks[order])
    return pa.RecordBatch.from_arrays([pa.array(team[first]), pa.array([send] * len(first), pa.bool_()), split(docs), split(cids), masked], NAMES)


def exchange(docs: DataFrame, buckets: int, teams: int) -> DataFrame:
    """bucket, docs, counts, entries: the fragments of each batch, each kind once by its least document; or marks of the other documents (bucket null)."""
    schema = f"bucket int, docs binary, counts binary, entries binary, {MARKS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.nulls
        for batch in sliced(batches):
            ids = batch.column(0).to_numpy()
            low = 0
            for block in chunks([(t or "").encode() for t in batch.column(1).to_pylist()], CHUNK):
                own, low = ids[low : low + len(block)], low + len(block)
                f = Fragments(block)
                bucket, anchor, content, cid = f.cids(buckets)
                doc = own[f.of]
                order = np.lexsort((doc, cid))
                cid, doc = cid[order], doc[order]
                new = runs(cid)
                least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
                later = (doc > least) & runs(cid, doc)
                if later.any():
                    m = marks(doc[later], cid[later], None, False, teams)
                    n = m.num_rows
                    yield pa.RecordBatch.from_arrays([none(n, pa.int32()), none(n, pa.binary()), none(n, pa.binary()), none(n, pa.binary()), *m.columns], ["bucket", "docs", "counts", "entries", *NAMES])
                kept = order[new]
                kept = kept[np.lexsort((own[f.of[kept]], bucket[kept]))]
                b, d = bucket[kept], own[f.of[kept]]
                entry = np.empty(len(kept), ENTRY)
                entry["anchor"], entry["low"], entry["high"] = anchor[kept], content[kept] & _u(0xFFFFFFFF), content[kept] >> _u(32)
                pairs = np.flatnonzero(runs(b, d))
                counts = np.diff(np.append(pairs, len(kept))).astype(np.uint32)
                heads = np.flatnonzero(runs(b[pairs]))
                rows = {"bucket": [], "docs": [], "counts": [], "entries": []}
                for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(pairs)], strict=True):
                    p = pairs[x:y]
                    rows["bucket"].append(int(b[p[0]]))
                    rows["docs"].append(d[p].tobytes())
                    rows["counts"].append(counts[x:y].tobytes())
                    rows["entries"].append(entry[p[0] : p[0] + int(counts[x:y].sum())].tobytes())
                n = len(rows["bucket"])
                yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), *[pa.array(rows[k], pa.binary()) for k in ("docs", "counts", "entries")], none(n, pa.int32()), none(n, pa.bool_()), none(n, pa.binary()), none(n, pa.binary()), none(n, pa.binary())], ["bucket", "docs", "counts", "entries", *NAMES])

    return docs.mapInArrow(run, schema)


def decided(found: DataFrame, buckets: int, teams: int) -> DataFrame:
    """Marks of whole fragments that an earlier document has, and requests to send fragments that must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple] = []
        for batch in batches:
            known = batch.column("bucket").is_null()
            if (m := batch.filter(known)).num_rows:
                yield m.select(NAMES)
            for r in batch.filter(pa.compute.invert(known)).select(["bucket", "docs", "counts", "entries"]).to_pylist():
                e = np.frombuffer(r["entries"], ENTRY)
                got.append((np.repeat(np.frombuffer(r["docs"], np.int64), np.frombuffer(r["counts"], np.uint32)), e["anchor"].astype(np.uint64) | _u(r["bucket"]) << _u(32), e["low"].astype(np.uint64) | e["high"].astype(np.uint64) << _u(32)))
        if not got:
            return
        doc, key, content = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        order = np.argsort(key, kind="stable")
        key = key[order]
        several = np.repeat(*(lambda f: (np.diff(np.append(f, len(key))) > 1, np.diff(np.append(f, len(key)))))(np.flatnonzero(runs(key))))
        order, key = order[several], key[several]
        doc, content = doc[order], content[order]
        order = np.lexsort((doc, content, key))
        doc, key, content = doc[order], key[order], content[order]
        cid = cid_of(key >> _u(32), key & _u(0xFFFFFFFF), content)
        new = runs(key, content)
        first = np.flatnonzero(new)
        least = doc[first]
        later = doc > np.repeat(least, np.diff(np.append(first, len(doc))))
        if later.any():
            yield marks(doc[later], cid[later], None, False, teams)
        kinds = key[first]
        group = np.flatnonzero(runs(kinds))
        if len(group):
            low, high, n = np.minimum.reduceat(least, group), np.maximum.reduceat(least, group), np.diff(np.append(group, len(kinds)))
            unlike = np.repeat(high > low, n)
            if unlike.any():
                yield marks(least[unlike], cid[first][unlike], None, True, teams)

    return found.repartition(buckets, F.coalesce("bucket", F.col("team") % buckets)).mapInArrow(run, MARKS)


def lookup(f: Fragments, buckets: int, ids: np.ndarray, marked: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of each fragment the mask of its windows that marks (ids, cids, masks) of its own document name, 0 for none; and the cids. ids: of the texts."""
    cid = f.cids(buckets)[3]
    out = np.zeros(len(cid), np.uint64)
    if marked.num_rows and len(cid):
        cids = [np.frombuffer(x, np.uint64) for x in marked["cids"].to_pylist()]
        masks = [np.full(len(c), WHOLE) if m is None else np.frombuffer(m, np.uint64) for c, m in zip(cids, marked["masks"].to_pylist(), strict=True)]
        owner = np.frombuffer(b"".join(marked["ids"].to_pylist()), np.int64)
        keys = np.concatenate(cids) ^ mixed(owner.astype(np.uint64))
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], np.concatenate(masks)[order]
        first = np.flatnonzero(runs(keys))
        keys, values = keys[first], np.bitwise_or.reduceat(values, first)
        own = cid ^ mixed(ids.astype(np.uint64))[f.of]
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        out = np.where(keys[at] == own, values[at], _u(0))
    return out, cid


def blocks_of(table: pa.Table) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """ids and texts of a team in blocks."""
    ids, low = table["doc_id"].to_numpy(), 0
    for block in chunks([(t or "").encode() for t in table["text"].to_pylist()], CHUNK):
        yield ids[low : low + len(block)], block
        low += len(block)


def sent(docs: DataFrame, marks: DataFrame, buckets: int) -> DataFrame:
    """bucket and fragments as arrays: keys (bucket and anchor), docs, cids, sizes, data. docs and marks have teams."""
    kinds = ("keys", "docs", "cids", "sizes", "data")

    def solve(texts: pa.Table, marked: pa.Table) -> pa.Table:
        rows = []
        for ids, block in blocks_of(texts) if marked.num_rows else ():
            f = Fragments(block)
            wanted, cid = lookup(f, buckets, ids, marked)
            pick = np.flatnonzero(wanted)
            if not len(pick):
                continue
            doc = ids[f.of[pick]]
            order = np.lexsort((cid[pick], doc))
            pick, doc = pick[order], doc[order]
            once = runs(doc, cid[pick])
            pick, doc = pick[once], doc[once]
            bucket = (f.anchor[pick] >> _u(40)) % _u(buckets)
            order = np.argsort(bucket, kind="stable")
            pick, doc, bucket = pick[order], doc[order], bucket[order]
            key = bucket << _u(32) | f.anchor[pick] & _u(0xFFFFFFFF)
            size = (f.windows[pick] + LENGTH - 1).astype(np.int64)
            ends = np.cumsum(size)
            data = f.data[np.repeat(f.begin[pick] - (ends - size), size) + np.arange(ends[-1])]
            heads = np.flatnonzero(runs(bucket)).tolist()
            for x, y in zip(heads, [*heads[1:], len(pick)], strict=True):
                rows.append((int(bucket[x]), key[x:y].tobytes(), doc[x:y].tobytes(), cid[pick[x:y]].tobytes(), size[x:y].astype(np.uint16).tobytes(), data[ends[x] - size[x] : ends[y - 1]].tobytes()))
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6)]], names=["bucket", *kinds])

    return docs.groupBy("team").cogroup(marks.select("team", "ids", "cids", "masks").groupBy("team")).applyInArrow(lambda a, b: solve(a, b), "bucket int, " + ", ".join(f"{k} binary" for k in kinds))


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys, equal for equal ones, from 0."""
    order = np.argsort(keys, kind="stable")
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(runs(keys[order])) - 1
    return out


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that start at `at`, cut at `length` bytes (8 to 64; all inside data), and the common prefix of each with the one before it in that order."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(64, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = word << _u(8) | padded[k : k + n]
    ranks, width = [(8, dense(word))], 8
    while 2 * width <= length:
        r = ranks[-1][1]
        after = np.concatenate([r[width:], np.zeros(min(width, n), np.int64)])[:n]
        width *= 2
        ranks.append((width, dense(r * n + after)))
    top = ranks[-1][1]
    rank = top[at] if width == length else dense(top[at] * n + top[at + length - width])
    order = np.argsort(rank, kind="stable")
    p, q = at[order][1:], at[order][:-1]
    common = np.where(rank[order][1:] == rank[order][:-1], length, 0)
    open_ = np.flatnonzero(common == 0)
    p, q, got = p[open_], q[open_], np.zeros(len(open_), np.int64)
    for w, r in reversed(ranks):
        while len(p):  # as often as a block of w bytes still agrees
            more = (got + w <= length) & (r[np.minimum(p + got, n - 1)] == r[np.minimum(q + got, n - 1)])
            if not more.any():
                break
            got[more] += w
    for _ in range(7):
        more = (got < length) & (padded[p + got] == padded[q + got])
        got[more] += 1
    common[open_] = np.minimum(got, length - 1)
    return order, np.concatenate([[0], common]) if len(at) else common[:0]


def nearest_smaller(values: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place the common prefix with the nearest earlier place of a smaller value; common[i]: with the place before i; 0 if none.

    Pointers jump: what lies between a place and its pointer is never smaller, so the pointer's pointer may be taken over.
    """
    n = len(values)
    to, low = np.arange(-1, n - 1), common.copy()
    active = np.flatnonzero(to >= 0)
    while len(active := active[(to[active] >= 0)]) and len(active := active[values[to[active]] >= values[active]]):
        t = to[active]
        step, least = to[t], low[t]
        low[active] = np.minimum(low[active], least)
        to[active] = step
    return np.where(to >= 0, low, 0)


def longest_previous(data: np.ndarray, at: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each suffix, cut at `length`, the longest prefix with which a suffix of a smaller document starts; docs[i] is that of at[i]."""
    order, common = suffix_order(data, at, length)
    own = docs[order]
    before = nearest_smaller(own, common)
    after = nearest_smaller(own[::-1], np.concatenate([[0], common[1:][::-1]]) if len(own) else common)[::-1]
    out = np.empty(len(at), np.int64)
    out[order] = np.maximum(before, after)
    return out


def compared(fragments: DataFrame, buckets: int, teams: int) -> DataFrame:
    """Marks of the windows that fragments of smaller documents hold."""

    def solve(key: np.ndarray, doc: np.ndarray, cid: np.ndarray, size: np.ndarray, start: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        windows = size - LENGTH + 1
        ends = np.cumsum(size)
        local = data[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
        of = np.repeat(np.arange(len(size)), windows)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        found = longest_previous(local, (ends - size)[of] + inner, doc[of], LENGTH) >= LENGTH
        mask = np.bitwise_or.reduceat(np.where(found, _u(1) << inner.astype(np.uint64), _u(0)), np.cumsum(windows) - windows)
        hit = mask > 0
        return doc[hit], cid[hit], mask[hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            for r in batch.to_pylist():
                got.append([np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["docs"], np.int64), np.frombuffer(r["cids"], np.uint64), np.frombuffer(r["sizes"], np.uint16).astype(np.int64), np.frombuffer(r["data"], np.uint8)])
        if not got:
            return
        key, doc, cid, size, data = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        start = np.cumsum(size) - size
        order = np.argsort(key, kind="stable")
        key, doc, cid, size, start = key[order], doc[order], cid[order], size[order], start[order]
        heads = np.flatnonzero(runs(key))
        load = np.add.reduceat(size, heads)
        part = np.cumsum(load) // 2_000_000  # anchors together up to some bytes
        cut = [*heads[np.flatnonzero(runs(part))].tolist(), len(key)]
        out = [solve(key[a:b], doc[a:b], cid[a:b], size[a:b], start[a:b], data) for a, b in zip(cut, cut[1:], strict=False)]
        doc, cid, mask = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(doc):
            yield marks(doc, cid, mask, False, teams)

    return fragments.repartition(buckets, "bucket").mapInArrow(run, MARKS)


def covered(f: Fragments, mask: np.ndarray) -> np.ndarray:
    """Which bytes of the chunk the masked windows cover."""
    hit = np.flatnonzero(mask)
    of = np.repeat(hit, f.windows[hit])
    inner = np.arange(len(of)) - np.repeat(np.cumsum(f.windows[hit]) - f.windows[hit], f.windows[hit])
    on = (mask[of] >> inner.astype(np.uint64) & _u(1)) > 0
    at = (f.begin[of] + inner)[on]
    edge = np.zeros(len(f.data) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def kept(docs: DataFrame, marks: DataFrame, buckets: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary)."""

    def solve(texts: pa.Table, marked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        for ids, block in blocks_of(texts):
            sizes, removed, spans, left = [len(t) for t in block], [0] * len(block), [0] * len(block), list(block)
            f = Fragments(block) if marked.num_rows else None
            gone = covered(f, lookup(f, buckets, ids, marked)[0]) if f else None
            for i, (a, b) in enumerate(zip(f.starts.tolist(), f.ends.tolist(), strict=True)) if f else ():
                g = gone[a:b]
                removed[i] = int(g.sum())
                if removed[i]:
                    spans[i] = int(g[0]) + int((g[1:] & ~g[:-1]).sum())
                    left[i] = f.data[a:b][~g].tobytes()
            for column, values in zip(out, (ids.tolist(), sizes, removed, spans, left), strict=True):
                column += values
        return pa.table([*[pa.array(x, pa.int64()) for x in out[:4]], pa.array(out[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.groupBy("team").cogroup(marks.select("team", "ids", "cids", "masks").groupBy("team")).applyInArrow(lambda a, b: solve(a, b), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def gap(docs: DataFrame, low: int) -> int:
    """A number below the greatest id that no row has: just below the least one, or the first one free above it."""
    if low > -LAST - 1:
        return low - 1
    ids = docs.where(F.col("doc_id") < LAST).select("doc_id").distinct()
    return ids.select((F.col("doc_id") + 1).alias("doc_id")).join(ids, "doc_id", "left_anti").agg(F.min("doc_id")).first()[0]


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the bytes that stay, for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, named, low, high = docs.agg(F.count("*"), F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    some = named < rows
    # the last number stands for null; ids above a number that isn't used make room for it
    free = gap(docs, low) if some and high == LAST else LAST
    docs = docs.withColumn("doc_id", F.coalesce(F.col("doc_id") - (F.col("doc_id") > free).cast("long"), F.lit(LAST)))
    buckets, teams = parts(docs.sparkSession), max(1, -(-rows // TEAM))
    first = stored(decided(exchange(docs, buckets, teams), buckets, teams), "fragments")
    own = teamed(docs, teams)
    unlike = stored(compared(sent(own, first.where("send"), buckets), buckets, teams), "windows")
    out = kept(own, first.where("not send").unionByName(unlike), buckets)
    if not some:
        return out
    own = F.nullif("doc_id", F.lit(LAST))
    return out.withColumn("doc_id", own + (own >= free).cast("long"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 49))) AS i FROM t)
), f AS (
  SELECT s, min(doc_id) AS first FROM w GROUP BY s
), r AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN f USING (s) WHERE doc_id > first
), n AS (
  SELECT doc_id, i, sum(CASE WHEN i - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r
), p AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY doc_id, span
), g AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM p
), k AS (
  SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
         string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest
  FROM g JOIN t USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""
