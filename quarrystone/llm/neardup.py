"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets and joined into components.

Sets. Words are lower-cased (A-Z); a document's set holds its distinct shingles of a few words, as 64-bit hashes. Documents
of equal sets are one class from the start: its smallest id stands for it, and copies cost nothing afterwards.

Forest. `HASHES` minima form a signature. Each of `TREES` trees orders the classes by a label of `LEVELS` minima, in an order
of its own. The rows of all trees are range-partitioned and sorted, so a label that many share is split like any other data.
Neighbours in an order are candidates if their labels share a prefix. The depth adapts to the region, a run of rows that
share `SHALLOW` levels: in a small run rows up to `NEAR` apart are candidates at that depth; in a larger one rows up to `FAR`
apart, which if not adjacent must share one level more for every doubling. Rows at the ends of partitions meet in a second pass.

Confirmation. Candidates whose signatures agree in too few places are dropped (at the threshold, fewer than one link in a
million), the rest are compared on their full sets; if they are many for the number of classes, those of highest agreement of
each class first, and of the others only those that still join different components.

Exact pass. The forest misses links, most of them in large regions, so all classes are searched once more (`exact`): of two
linked sets the rarest fifths share a shingle, whatever the order of rarity, if it is one for all. Those fifths are stored
with the signatures, so texts are read once. A shingle whose holders are all of one component is dropped by partial sums
before anything is gathered. Documents of different components that share another are compared in pairs, or, where more than
`LONG` share it, in blocks, of any size of component and without gathering the holders. A group of near copies costs about
its size and its border, a region of many similar documents that are not linked the square of its size.

Edge cases. Null or empty text, or white space alone: an empty set, linked with nothing, its own component. Fewer words than
a shingle has: all of them are the one shingle. Rows that share an id are one document as far as links go: what links with
one of its texts is linked with it. A null id has component null and is kept. Empty tables give empty results; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.common import SPACES, documents, forget, hashed, is_small, mixed, sliced, stored, trimmed

HASHES, TREES, LEVELS, SHALLOW, NEAR, FAR = 64, 16, 8, 3, 7, 3
#: Places of a signature in which candidates must agree: links at 0.8 do, all but about four in a million, which the exact pass finds.
AGREE = 0.56
#: Ids, and shingles, up to which a set of them may be broadcast.
BROADCAST_IDS = 500_000
BROADCAST_TOKENS = 2_000_000
#: Candidates per class up to which all are confirmed at once; beyond, so many of each class in each round.
AT_ONCE = 8
ROUNDS = (1, 8)
#: Documents and shingles of a block of a region.
MEMBERS, ITEMS = 1_000, 1_000_000
#: Shingles known as common, at most: this only orders shingles, any order gives the same links.
COMMON = 1_000_000
#: Documents of one shingle up to which they are paired at once; beyond, they become a region.
LONG = 64

_white = np.zeros(256, bool)
_white[list(SPACES)] = True
_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
_random = np.random.default_rng(77)
_factors = _random.integers(1, 2**63, HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_places = _random.integers(1, 2**63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def levels_of(tree: int) -> list[int]:
    """The hash functions of a tree's label: four of its own first, then others'."""
    own = HASHES // TREES
    return [(tree * own + i) % HASHES if i < own else (tree * own + i * 5 + 7) % HASHES for i in range(LEVELS)]


def chunks(texts: list[bytes], most: int = 1_500_000) -> Iterator[list[bytes]]:
    block, n = [], 0
    for t in texts:
        if block and n + len(t) > most:
            yield block
            block, n = [], 0
        block.append(t)
        n += len(t)
    if block:
        yield block


def shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and where each text's begin; UTF-8 texts."""
    data = _low[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    white = _white[data]
    word = ~white
    first = word.copy()
    first[1:] &= white[:-1]
    last = word.copy()
    last[:-1] &= white[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = hashed(data, a, b)
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(a, ends)
    n = np.diff(upto, prepend=0)
    full = np.maximum(0, n - size + 1)
    got = np.where(n > 0, np.maximum(1, full), 0)
    of = np.repeat(np.arange(len(texts)), got)
    at = np.repeat(upto - n, got) + np.arange(got.sum()) - np.repeat(np.cumsum(got) - got, got)
    width = np.minimum(size, n)[of]
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = width > k
        out[inside] += words[at[inside] + k] * _places[k]
    out = mixed(out + width.astype(np.uint64))
    order = np.lexsort((out, of))
    out, of = out[order], of[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    out, of = out[new], of[new]
    return out, np.searchsorted(of, np.arange(len(texts) + 1))


def signature(sets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """(texts, HASHES) uint16 minima; rows of empty sets hold nothing meaningful."""
    n = len(begins) - 1
    out = np.zeros((n, HASHES), np.uint16)
    some = np.flatnonzero(begins[1:] > begins[:-1])
    if len(some):
        starts = begins[some]
        for k in range(HASHES):
            least = np.minimum.reduceat((sets * _factors[k]) >> np.uint64(24), starts)
            out[some, k] = mixed(least).astype(np.uint16)
    return out


class Order:
    """The order of shingles, the rarest first: by how often they are known to be held, then by themselves."""

    def __init__(self, known: np.ndarray, counts: np.ndarray) -> None:
        """known: sorted shingles."""
        self.known, self.counts = known, counts

    def often(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.known, tokens), len(self.known) - 1)
        return np.where(self.known[at] == tokens, self.counts[at], 0)

    def prefixes(self, sets: np.ndarray, begins: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each set the n - ceil(similar * n / 100) + 1 first of its n shingles, and where each set's begin. Of two linked sets these share one at least."""
        n = np.diff(begins)
        of = np.repeat(np.arange(len(n)), n)
        tokens = sets[np.lexsort((sets, self.often(sets), of))]
        keep = np.arange(len(sets)) - begins[:-1][of] < n[of] + similar * n[of] // -100 + 1
        return tokens[keep], np.concatenate([[0], np.cumsum(np.bincount(of[keep], minlength=len(n)))])

    def most_shared(self, x: np.ndarray, y: np.ndarray, n: int, m: int) -> int:
        """What two sets of n and m shingles share at most, from their first ones: a shingle of one that comes before the last of the other's and isn't among them is in one set only."""
        both = np.concatenate([x, y])
        kinds, rank = np.unique(both[np.lexsort((both, self.often(both)))], return_index=True)
        place = rank[np.searchsorted(kinds, both)]
        a, b = place[: len(x)], place[len(x) :]
        return min(n - int(((a < b[-1]) & ~np.isin(x, y)).sum()), m - int(((b < a[-1]) & ~np.isin(y, x)).sum()))


def signatures(docs: DataFrame, size: int, similar: int, order: Order) -> DataFrame:
    """doc_id, n_shingles, key (of the set; null if empty), sig, tokens (the set's first shingles in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, keys, sigs, tokens = [], [], [], []
            for block in chunks([(t or "").encode() for t in batch.column(1).to_pylist()]):
                sets, begins = shingles(block, size)
                cut = begins.tolist()
                sizes += np.diff(begins).tolist()
                keys += [xxhash.xxh128_digest(sets[a:b]) if b > a else None for a, b in zip(cut, cut[1:], strict=False)]
                sigs += [r.tobytes() for r in signature(sets, begins)]
                rare, at = order.prefixes(sets, begins, similar)
                cut = at.tolist()
                tokens += [rare[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *[pa.array(x, pa.binary()) for x in (keys, sigs, tokens)]], ["doc_id", "n_shingles", "key", "sig", "tokens"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key binary, sig binary, tokens binary")


def labels(classes: DataFrame) -> DataFrame:
    """tree, label, id: a row for each class and tree. Levels are big-endian, so labels sort by levels."""
    picks = [levels_of(t) for t in range(TREES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, HASHES)
            label = np.ascontiguousarray(np.stack([sig[:, p] for p in picks], 1).astype(">u2")).reshape(n * TREES, LEVELS)
            out = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * LEVELS), n * TREES, [None, pa.py_buffer(label.tobytes())]).cast(pa.binary())
            ids = np.repeat(batch.column(0).to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), out, pa.array(ids)], ["tree", "label", "id"])

    return classes.select("id", "sig").mapInArrow(run, "tree int, label binary, id long")


def near(tree: np.ndarray, label: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of sorted rows. label: (rows, LEVELS)."""
    n = len(ids)
    shared: list[np.ndarray] = []
    for s in range(1, NEAR + 1):
        if n <= s:
            break
        same = label[s:] == label[:-s]
        depth = np.where(same.all(1), LEVELS, same.argmin(1))
        shared.append(np.where(tree[s:] == tree[:-s], depth, 0))
    if not shared:
        return ids[:0], ids[:0]
    run = np.cumsum(np.concatenate([[True], shared[0] < SHALLOW])) - 1
    size = np.bincount(run)[run]
    deeper = np.minimum(LEVELS, SHALLOW + np.ceil(np.log2(np.maximum(1, size / (NEAR + 1)))).astype(int))
    reach = np.where(size <= 2 * NEAR, NEAR, FAR)
    a, b = [], []
    for s, depth in enumerate(shared, 1):
        hit = np.flatnonzero((depth >= (SHALLOW if s == 1 else deeper[:-s])) & (reach[:-s] >= s))
        a.append(ids[hit])
        b.append(ids[hit + s])
    a, b = np.concatenate(a), np.concatenate(b)
    return np.minimum(a, b), np.maximum(a, b)


def neighbours(rows: DataFrame) -> DataFrame:
    """a < b, candidates of all trees. Each partition's first and last rows come out too, to meet those of the next ones."""
    spark = rows.sparkSession
    window = 20_000

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, LEVELS), batch.column(2).to_numpy()

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        empty = pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *empty], ["a", "b", "tree", "label", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        kept: tuple | None = None
        edge = []
        for batch in trimmed(batches):
            for at in range(0, batch.num_rows, window):
                now = arrays(batch.slice(at, window))
                if kept is None:
                    edge.append(tuple(x[: NEAR + 1] for x in now))
                else:
                    now = tuple(np.concatenate([x, y]) for x, y in zip(kept, now, strict=True))
                yield out(*near(*now))
                kept = tuple(x[-(NEAR + 1) :] for x in now)
        if kept is not None:
            edge.append(kept)
            tree, label, ids = (np.concatenate(x) for x in zip(*edge, strict=True))
            sent = [x.tobytes() for x in label.astype(">u2")]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(tree.astype(np.int32)), pa.array(sent, pa.binary()), pa.array(np.full(len(ids), part, np.int64))], ["a", "b", "tree", "label", "part"])

    def join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [b for b in batches if b.num_rows]
        if tables:
            t = pa.Table.from_batches(tables).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in near(*arrays(t))], ["a", "b"])

    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "tree", "label", "id").sortWithinPartitions("tree", "label", "id")
    found = stored(ordered.mapInArrow(run, "a long, b long, tree int, label binary, part long"), "neighbours")
    # a few rows of each partition, however large the table
    edges = found.where("part is not null").select("tree", "label", F.col("a").alias("id")).distinct().coalesce(1).sortWithinPartitions("tree", "label", "id")
    pairs = found.where("part is null").select("a", "b").unionByName(edges.mapInArrow(join_edges, "a long, b long"))
    return pairs.where("a < b").distinct()


def agreeing(pairs: DataFrame, classes: DataFrame, least: float = AGREE) -> DataFrame:
    """a, b, agree: the part of their signatures in which pairs agree, if it is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, HASHES) for i in (2, 3))
            agree = (x == y).mean(1)
            keep = pa.array(agree >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(agree).filter(keep)], ["a", "b", "agree"])

    x, y = (classes.select(F.col("id").alias(k), F.col("sig").alias(f"sig_{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, agree double")


def sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, items: the shingle hashes of each document in ids; both have distinct ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            items = []
            for block in chunks([(t or "").encode() for t in batch.column(1).to_pylist()]):
                sets, begins = shingles(block, size)
                cut = begins.tolist()
                items += [sets[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary())], ["id", "items"])

    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), docs.doc_id == ids.id, "left_semi")
    return chosen.mapInArrow(run, "id long, items binary")


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """a, b of the pairs with 100 * intersection >= similar * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n, m = len(x) // 8, len(y) // 8
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= similar * (n + m - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = (sets.select(F.col("id").alias(k), F.col("items").alias(f"items_{k}")) for k in "ab")
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "items_a", "items_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, root of every id in links (a, b): root is the smallest id reachable. Large and small stars alternate until nothing changes."""
    edges = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m").distinct()
    seen = before = None
    while True:
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("w")), F.struct(F.col("m").alias("u"), F.col("v").alias("w"))))
        both = edges.select(ends.alias("x")).select("x.u", "x.w")
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(least, "u").where("w > u").select(F.col("w").alias("v"), "m").distinct()
        least = edges.groupBy("v").agg(F.min("m").alias("least"))
        down = F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("least").alias("m")), F.struct("v", F.col("least").alias("m"))))
        edges = edges.join(least, "v").select(down.alias("x")).select("x.v", "x.m").where("v <> m").distinct()
        edges = stored(edges, "stars")
        if before is not None:
            forget(before)
        before = edges
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("v").alias("id"), F.col("m").alias("root"))
        seen = now


def commons(docs: DataFrame, size: int) -> Order:
    """By shingles that several texts of a batch of docs (text) hold, and how often at least: most of those that many documents share.

    Only those leave their batch, so the many that one text holds alone cost no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            held = [shingles(block, size)[0] for block in chunks([*{(t or "").encode() for t in batch.column(0).to_pylist()}])]
            found, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            several = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(found[several].view(np.int64)), pa.array(counts[several])], ["token", "n"])

    found = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    known, counts = found["token"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(known)
    return Order(known[order], counts[order])


def postings(sig: DataFrame, nodes: DataFrame) -> DataFrame:
    """token, id, root, n, place: a row for each of the tokens of each document in nodes (id, root), and its place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 500):
            raw = batch.column(3).to_pylist()
            sizes = np.array([len(x) // 8 for x in raw], np.int64)
            rows, tokens = np.repeat(np.arange(len(raw)), sizes), np.frombuffer(b"".join(raw), np.int64)
            place = (np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), *[batch.column(i).take(pa.array(rows)) for i in range(3)], pa.array(place)], ["token", "id", "root", "n", "place"])

    few = nodes.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = sig.select(F.col("doc_id").alias("id"), F.col("n_shingles").cast("int").alias("n"), "key", "tokens").where("key is not null")
    chosen = own.join(F.broadcast(nodes) if few else nodes.hint("shuffle_hash"), ["id", "key"]).select("id", "root", "n", "tokens")
    return chosen.mapInArrow(run, "token long, id long, root long, n int, place int")


def contested(rows: DataFrame) -> DataFrame:
    """The rows of tokens that documents of several components hold. Sums are partial, so a token of very many documents is no hot key."""
    sums = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    tokens = stored(sums, "tokens")
    few = tokens.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    out = stored(rows.join(F.broadcast(tokens) if few else tokens, "token", "left_semi"), "contested")
    forget(tokens)
    return out


def meeting(rows: DataFrame, similar: int) -> DataFrame:
    """a, b, region of contested postings: pairs of different components where up to LONG documents hold a token; else, with region true, each document beside the first one.

    Pairs are left out only if a link is impossible: sizes too far apart, or too little left. Tokens that two sets share
    stand in the same order in both, so their intersection is at most the shared ones among these and what comes after the
    last of them. (A pair that shares a token of more than LONG documents isn't fully counted here, but meets in its region.)
    """

    def solve(token: np.ndarray, ids: np.ndarray, root: np.ndarray, n: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(1, LONG):
            i, j = np.arange(len(ids) - s), np.arange(s, len(ids))
            near = token[i] == token[j]
            if not near.any():
                break
            fits = near & (root[i] != root[j]) & (100 * n[i] >= similar * n[j])
            i, j = i[fits], j[fits]
            first = ids[i] < ids[j]
            i, j = np.where(first, i, j), np.where(first, j, i)
            rest = np.minimum(n[i] - 1 - place[i], n[j] - 1 - place[j])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[i], ids[j], rest, n[i] + n[j])], ["a", "b", "rest", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in trimmed(batches):
            now = [batch.column(i).to_numpy().astype(np.int64) for i in range(5)]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if done:
                yield from solve(*(x[:done] for x in held))
                held = [x[done:] for x in held]
        if held and len(held[0]):
            yield from solve(*held)

    many = stored(rows.groupBy("token").agg(F.count("*").alias("holders"), F.min("id").alias("first")).where(F.col("holders") > LONG).select("token", "first"), "many")
    few = many.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    side = F.broadcast(many) if few else many
    ordered = rows.join(side, "token", "left_anti").select(*rows.columns).repartition("token").sortWithinPartitions("token", "n", "id")
    shared = ordered.mapInArrow(run, "a long, b long, rest long, sizes long").groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("rest").alias("rest"), F.max("sizes").alias("sizes"))
    pairs = shared.where((100 + similar) * (F.col("shared") + F.col("rest")) >= similar * F.col("sizes")).select("a", "b", F.lit(False).alias("region"))
    crowd = rows.join(side, "token").select(F.least("first", "id").alias("a"), F.greatest("first", "id").alias("b")).distinct().withColumn("region", F.lit(True))
    return pairs.unionByName(crowd)


def compared(members: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """a, b: links that join different components (root) of a region, enough to join all that are linked; members: id, region, root.

    All documents of a region are compared, those of a large component with those of others only. Regions are dealt out
    in blocks, of which every two meet; shared shingles are counted through a block's postings.
    """
    measured = members.join(sets.select("id", F.expr("length(items) / 8").alias("n")), "id")
    blocks = F.ceil(F.greatest(F.sum("docs") / MEMBERS, F.sum("items") / ITEMS)).cast("int").alias("blocks")
    own = measured.groupBy("region", "root").agg(F.count("*").alias("docs"), F.sum("n").alias("items"))
    own = own.groupBy("region", "root", "docs", "items").agg(blocks)
    rest = own.where("blocks = 1").groupBy("region").agg(blocks.alias("shared"))
    large = F.col("blocks") > 1
    owner = F.when(large, F.concat(F.lit("own "), F.col("root").cast("string"))).otherwise("shared").alias("owner")
    block = F.when(large, F.pmod(F.xxhash64("id"), F.col("blocks"))).otherwise(F.pmod(F.xxhash64("root"), F.col("shared")))
    dealt = members.join(own.select("region", "root", "blocks"), ["region", "root"]).join(rest, "region", "left").select("id", "region", "root", owner, block.alias("block"))
    dealt = stored(dealt.withColumn("block", F.concat_ws(" ", "owner", "block")), "dealt")
    x, y = (dealt.select("region", F.col("owner").alias(f"owner_{k}"), F.col("block").alias(k)).distinct() for k in "xy")
    meet = x.join(y, "region").where("x <= y and (owner_x <> owner_y or owner_x = 'shared')").select("region", "x", "y", F.xxhash64("region", "x", "y").alias("task"))
    meet = stored(meet.withColumn("alone", F.col("x") == F.col("y")), "meet")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if not right.num_rows:  # a block with itself
            right = left
        if left.num_rows:
            ids, label, items = right["id"].to_numpy(), right["root"].to_numpy().copy(), [np.frombuffer(x, np.uint64) for x in right["items"].to_pylist()]
            mine, named, bodies = left["id"].to_numpy(), left["root"].to_numpy().copy(), left["items"].to_pylist()
            sizes = np.array([len(x) for x in items])
            hashes, of = np.concatenate(items), np.repeat(np.arange(len(items), dtype=np.int32), sizes)
            order = np.argsort(hashes, kind="stable")
            hashes, of = hashes[order], of[order]
            for i, raw in enumerate(bodies):
                if (label == named[i]).all():
                    continue
                body = np.frombuffer(raw, np.uint64)
                low, high = np.searchsorted(hashes, body, "left"), np.searchsorted(hashes, body, "right")
                n = high - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                shared = np.bincount(of[at], minlength=len(items))
                for j in np.flatnonzero((label != named[i]) & (100 * shared >= similar * (len(body) + sizes - shared))):
                    old, now = label[j], named[i]
                    if old != now:  # joined from here on
                        a.append(int(mine[i]))
                        b.append(int(ids[j]))
                        label[label == old] = now
                        named[named == old] = now
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def side(k: str, tasks: DataFrame) -> DataFrame:
        rows = dealt.select("id", "region", "root", F.col("block").alias(k)).join(tasks, ["region", k]).select("id", "root", "task")
        few = rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return sets.join(F.broadcast(rows) if few else rows, "id").select("task", "id", "root", "items")

    left = side("x", meet).groupBy("task")
    right = side("y", meet.where("not alone")).toDF("other", "id2", "root2", "items2").groupBy("other")
    return left.cogroup(right).applyInArrow(lambda one, two: solve(one, two.rename_columns(["other", "id", "root", "items"])), "a long, b long")


def hopeful(pairs: DataFrame, sig: DataFrame, order: Order, similar: int) -> DataFrame:
    """The pairs (a, b) whose first shingles don't rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            columns = [batch.column(i).to_pylist() for i in range(2, 6)]
            keep = [(100 + similar) * order.most_shared(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), n, m) >= similar * (n + m) for x, y, n, m in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = sig.where("key is not null").select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "tokens")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = own.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    x, y = (own.select(F.col("id").alias(k), F.col("tokens").alias(f"tokens_{k}"), F.col("n").alias(f"n_{k}")) for k in "ab")
    sides = pairs.join(x, "a").join(y, "b").select("a", "b", "tokens_a", "tokens_b", "n_a", "n_b")
    return sides.mapInArrow(run, "a long, b long").distinct()


def exact(docs: DataFrame, sig: DataFrame, nodes: DataFrame, size: int, similar: int, order: Order) -> DataFrame:
    """a, b: links between the components of nodes (id, key, root) that have been found so far; enough to join all that are linked."""
    rows = contested(postings(sig, nodes))
    met = stored(meeting(rows, similar), "met")
    forget(rows)
    crowd = met.where("region").select("a", "b")
    some = crowd.limit(1).count() > 0
    pairs = stored(hopeful(met.where("not region").select("a", "b"), sig, order, similar), "pairs")
    need = stored(pairs.unionByName(crowd).select(F.explode(F.array("a", "b")).alias("id")).distinct(), "need")
    sets = stored(sets_of(docs, need, size), "sets")
    links = confirmed(pairs, sets, similar)
    if some:
        regions = components(crowd).withColumnRenamed("root", "region")
        ids = crowd.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        members = stored(ids.join(regions, "id", "left").withColumn("region", F.coalesce("region", "id")).join(nodes.select("id", "root"), "id"), "members")
        links = links.unionByName(compared(members, sets, similar))
    links = stored(links, "exact")
    forget(met, pairs, need, sets)
    return links


def linked(docs: DataFrame, sig: DataFrame, classes: DataFrame, size: int, similar: int, order: Order) -> DataFrame | None:
    """id, root of the classes that links join; None if there are none."""
    every = classes.select("id", "key")
    roots = joined(docs, classes, size, similar)
    nodes = every.withColumn("root", F.col("id")) if roots is None else every.join(roots, "id", "left").select("id", "key", F.coalesce("root", "id").alias("root"))
    nodes = stored(nodes, "nodes")
    missed = exact(docs, sig, nodes, size, similar, order)
    if missed.limit(1).count():
        roots = components(missed.unionByName(nodes.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    return roots


def joined(docs: DataFrame, classes: DataFrame, size: int, similar: int) -> DataFrame | None:
    """id, root of the classes that links among the forest's candidates join; None if there are no candidates."""
    pairs = stored(agreeing(neighbours(labels(classes)), classes), "candidates")
    if not pairs.limit(1).count():
        return None
    ids = stored(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    sets = stored(sets_of(docs, ids, size), "sets")

    def named(roots: DataFrame) -> DataFrame:
        return stored(ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root")), "nodes")

    def edges(roots: DataFrame) -> DataFrame:
        return roots.select(F.col("id").alias("a"), F.col("root").alias("b"))  # stands for all links so far

    left, roots = pairs, ids.select("id", F.col("id").alias("root")).limit(0)
    for most in (None,) if pairs.count() <= AT_ONCE * ids.count() else ROUNDS:
        now = left
        if most:
            best = Window.partitionBy("b").orderBy(F.desc("agree"), "a")
            now = left.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most).drop("n")
        roots = components(edges(roots).unionByName(stored(confirmed(now, sets, similar), "links")))
        nodes = named(roots)
        x, y = (nodes.select(F.col("id").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab")
        left = stored(left.join(x, "a").join(y, "b").where("root_a <> root_b").select("a", "b", "agree"), "left")
    forget(pairs, sets)
    return roots


def near_duplicates(docs: DataFrame, size: int = 5, similar: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = commons(docs, size)
    sig = stored(signatures(docs, size, similar, order), "signatures")
    sets = sig.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("key")).alias("least"), F.max(F.xxhash64("key")).alias("most"))
    repeated, unlike = sets.agg(F.coalesce(F.max("n") > 1, F.lit(False)), F.coalesce(F.max(F.col("least") != F.col("most")), F.lit(False))).first()
    if unlike:
        return of_rows(docs, sig, size, similar)
    if repeated:
        docs = docs.dropDuplicates(["doc_id"])  # of equal sets
    # of each set that several rows have, the smallest id; a set of one row only is a class without that
    groups = sig.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    groups = stored(groups.where("n > 1").select("key", "first"), "groups")
    rows = sig.select("doc_id", "n_shingles", "key", "sig").join(F.broadcast(groups) if is_small(groups) else groups, "key", "left")
    rows = rows.withColumn("first", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")))
    classes = rows.where("key is not null and first = doc_id").groupBy("doc_id", "key").agg(F.first("sig").alias("sig"))
    roots = linked(docs, sig, stored(classes.withColumnRenamed("doc_id", "id"), "classes"), size, similar, order)
    out = rows.select("doc_id", "n_shingles", F.col("first").alias("id"))
    if roots is not None:
        out = out.join(roots, "id", "left").withColumn("id", F.coalesce("root", "id"))
    return out.select("doc_id", "n_shingles", F.col("id").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("id"), F.lit(True)).alias("kept"))


def of_rows(docs: DataFrame, sig: DataFrame, size: int, similar: int) -> DataFrame:
    """near_duplicates where unlike texts share an id: rows get ids of their own, and those of one document are tied together."""
    rows = stored(docs.where("doc_id is not null").withColumn("row", F.monotonically_increasing_id()), "rows")
    found = stored(near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), size, similar).withColumnRenamed("doc_id", "row"), "found")
    ids = rows.select("row", "doc_id")
    ties = ids.join(ids.groupBy("doc_id").agg(F.min("row").alias("b")), "doc_id").select(F.col("row").alias("a"), "b")
    roots = components(ties.unionByName(found.select(F.col("row").alias("a"), F.col("component_id").alias("b")))).withColumnRenamed("id", "row")
    own = found.select("row", "n_shingles").join(ids, "row").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = own.join(least, "root").select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(sig.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), 4, 80)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d
), x AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS shingle FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.node
), c AS (
  SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, len(g) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
