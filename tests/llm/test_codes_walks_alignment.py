"""Vector codes, edit fingerprints and token alignment against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quarrystone.llm import alignment, codes, walks

public_tokenizers = pytest.importorskip("public_tokenizers")
FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# vector codes


def plain_codes(rows, parts, entries, rounds, scale):
    """(code, error) of each row and the codebooks, by full scans in whole numbers."""
    rows = [(i, [((scale * n) // d) for n, d in (float(x).as_integer_ratio() for x in v)]) for i, v in rows]
    most = max((len(v) for _, v in rows), default=0)
    width = -(-most // parts)
    cut = [[(v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width] for p in range(parts)] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            near = [min((sum((x - y) ** 2 for x, y in zip(c[p], entry, strict=True)), e) for e, entry in enumerate(books[p])) for p in range(parts)]
            out.append((bytes(e for _, e in near), sum(d for d, _ in near)))
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, (code, _) in zip(cut, got, strict=True) if code[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return assign(), books


def vectors(rng, n, length, spread, centres):
    middle = rng.normal(0, 1, (centres, length))
    return middle[rng.integers(0, centres, n)] + rng.normal(0, spread, (n, length))


@pytest.mark.parametrize(("n", "length", "entries", "rounds"), [(300, 12, 16, 4), (90, 7, 40, 3), (5, 8, 16, 2), (40, 3, 6, 5)])
def test_codes_equal_full_scans(spark, n, length, entries, rounds):
    rng = np.random.default_rng(n)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(n), vectors(rng, n, length, 0.2, 9), strict=True)]
    rows[: n // 5] = [(i, [round(x) for x in v]) for i, v in rows[: n // 5]]  # equal distances
    want, books = plain_codes(rows, 4, entries, rounds, 64)
    df = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    got, found = codes.compressed(df, 4, entries, rounds, 64)
    assert [[[int(x) for x in e] for e in b.tolist()] for b in found] == books
    assert {r.vec_id: (bytes(r.code), r.error) for r in got.collect()} == {i: w for (i, _), w in zip(rows, want, strict=True)}


def test_codes_of_odd_rows(spark):
    """Nulls, unequal lengths, null and repeated ids, clashing columns, and numbers beyond float64's whole ones."""
    rows = [(1, [1e307, -1e307, 3.0], 5), (2, [1.0], None), (2, [2.0, 3.0], None), (2, [1.0], 5), (None, [1e307, 0.5, 0.25], 5), (3, [], 7), (9, [-1e307, 4.0, 1e300, 2.0, 1.0], 7)]
    bad = [(4, None, 1), (5, [None, 1.0], 1), (6, [float("nan")], 1), (7, [float("inf")], 1)]
    df = spark.createDataFrame([(*r, b"x", 0.0) for r in rows + bad], "vec_id long, embedding array<double>, label int, code binary, error double")
    want, books = plain_codes([r[:2] for r in rows], 4, 3, 2, 1024)
    got, found = codes.compressed(df, 4, 3, 2)
    assert [[[int(x) for x in e] for e in b.tolist()] for b in found] == books
    cut = lambda e: min(e, 2**63 - 1)
    assert Counter((r.vec_id, bytes(r.code), r.error) for r in got.collect()) == Counter((r[0], c, cut(e)) for r, (c, e) in zip(rows, want, strict=True))
    none, empty = codes.compressed(df.limit(0))
    assert none.count() == 0 and codes.digest(empty) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError, match="256"):
        codes.compressed(df, entries=257)


def test_bounds_spare_scans_and_net_moves_are_tighter():
    """On clustered parts most groups aren't scanned again; an entry that goes and comes back has moved by nothing."""
    rng = np.random.default_rng(4)
    x = np.floor(1024 * vectors(rng, 2_000, 8, 0.05, 64))
    history = [x[:64]]
    lengths = codes.Lengths(0)
    group = codes.groups(history[0], lengths)
    first = codes.Part(history, group, lengths)
    code, error, bound, stamp = first.start(x)
    assert first.scanned == x.shape[0] * 64
    for _ in range(3):
        book = history[-1].copy()
        for e in range(64):
            if (code == e).any():
                book[e] = np.floor(x[code == e].mean(0))
        history.append(book)
        part = codes.Part(history, group, lengths)
        code, error, bound, stamp = part.again(x, code, bound, stamp)
        far = codes.squares(x, book)
        assert (far.argmin(1) == code).all() and (far.min(1) == error).all()
    assert part.scanned < 0.5 * x.shape[0] * 64
    there = [history[0], history[0] + 100, history[0]]
    assert codes.Part(there, group, lengths).moved[0].max() == 0 and codes.Part(there, group, lengths).moved[1].max() > 0


def test_codes_decode_near(spark):
    rng = np.random.default_rng(8)
    x = vectors(rng, 200, 8, 0.01, 10)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got, books = codes.compressed(df, 4, 32, 4)
    for r in got.collect():
        assert np.abs(np.array(codes.decoded(bytes(r.code), books)) - x[r.vec_id]).max() < 0.2


# edit fingerprints


def plain_walk(text):
    """The walk's output, a character a step."""
    stay, out = walks._coins(), []
    for c in text:
        out += [c] * int(stay[(ord(c) % 256) * walks.PERIOD + len(out) % walks.PERIOD])
    return out


def test_walks_equal_steps_by_hand(corpus):
    walker = walks.Walker()
    texts = [t or "" for _, t in corpus][:70] + ["日本語😀", "a"]
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    prints = walker.fingerprints(texts)
    for text, arrived, got in zip(texts, walker.arrivals(points), prints, strict=True):
        out = plain_walk(text)
        assert len(out) == arrived[-1] and [out[j] for j in arrived[:-1].tolist()] == list(text)
        if not text:
            assert got == ""
            continue
        level = walks.level_of(len(out))
        chosen = [j for j in range(len(out)) if int(walks._hash(np.array([j]))[0]) % (1 << level) == 0]
        bits = [int(walks.mixed(walks._hash(np.array([j])) ^ walks._hash(np.array([ord(out[j])])))[0] >> np.uint64(60)) for j in chosen]
        assert got == f"{level:02x}" + "".join(f"{b:x}" for b in bits)


def test_walks_meet_again_after_edits():
    """A few edits leave most samples alike, also between texts on two sides of a level."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    walker = walks.Walker()
    for n in (60, 400, 5_000):
        a = " ".join(rng.choice(words) for _ in range(n))
        at = rng.randrange(len(a))
        b, c = a[:at] + "xy" + a[at + 1 :], a + " " + " ".join(rng.choice(words) for _ in range(n // 10))
        other = " ".join(rng.choice(words) for _ in range(n))
        pa_, pb, pc, po = walker.fingerprints([a, b, c, other])
        assert walker.likeness(pa_, pa_) == 1 and walker.likeness(pa_, pb) > 0.6 and walker.likeness(pa_, pc) > 0.75 and walker.likeness(pa_, po) < 0.3
        assert walker.likeness(pa_, pc) == walker.likeness(pc, pa_)
    assert walker.likeness("", "") == 1 and walker.likeness("", pa_) == 0


def test_edited_texts_and_next_documents(docs, corpus):
    """Every row meets the next one over the ends of ranges; null ids come last, rows of one id in order of hash and text."""
    hashes = {r.text: r.h for r in docs.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").distinct().collect()}
    rows = sorted(((i, t or "") for i, t in corpus), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1]))
    walker, want = walks.Walker(), []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        e = t[: len(t) - cut] + after[:cut]
        p, q, r = walker.fingerprints([t, e, after])
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), p, q, walker.likeness(p, q), walker.likeness(p, r)))
    assert Counter(map(tuple, walks.compared(docs).collect())) == Counter(want)
    assert walks.compared(docs.limit(0)).count() == 0
    one = walks.compared(docs.where("doc_id = 100")).collect()
    assert one[0].near_next == 1


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_distances_equal_the_table():
    rng = random.Random(3)
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 25)))
        b = "".join(rng.choice("abé") for _ in range(rng.randint(0, 25))) if rng.random() < 0.5 else a[:4] + "x" + a[6:]
        d, most = plain_distance(a, b), rng.randint(0, 30)
        assert walks.distance(a, b, most) == min(d, most + 1)


def test_near_copies_are_verified(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(40, 300)))) for i in range(40)]
    for i in range(12):
        text = rows[i][1]
        at = rng.randrange(len(text) - 10)
        rows.append((100 + i, text[:at] + "zz" + text[at + 3 :]))
    rows += [(200, rows[3][1]), (200, rows[3][1]), (201, None), (202, ""), (None, rows[4][1])]
    text = dict(r for r in rows if r[0] is not None)
    got = {r.doc_id: (r.near_id, r.distance) for r in walks.near(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got[200] == (3, 0) and not {201, 202} & set(got)
    assert {100 + i for i in range(12)} <= set(got)
    for i, (j, d) in got.items():
        assert j < i and d == plain_distance(text[i], text[j]) <= 0.2 * max(len(text[i]), len(text[j]))


# token alignment


def ends(rng, n, total):
    return np.array(sorted({*(rng.randint(1, total) for _ in range(n)), total}), np.int64)


def plain_alignment(a, b):
    """(ends of groups in either array, links) by a plain merge."""
    x = y = 0
    groups, links = [], []
    while x < len(a):
        links.append((x, y))
        if a[x] == b[y]:
            x, y = x + 1, y + 1
            groups.append((x, y))
        elif a[x] < b[y]:
            x += 1
        else:
            y += 1
    return groups, links


@pytest.mark.parametrize("stretch", [3, 20, 512])
def test_alignments_equal_a_plain_merge(monkeypatch, stretch):
    monkeypatch.setattr(alignment, "STRETCH", stretch)
    rng = random.Random(stretch)
    for case in range(150):
        total = rng.randint(1, 400)
        a = ends(rng, rng.randint(0, total), total)
        b = ends(rng, rng.randint(0, total), total) if case % 3 else np.array(sorted({*a.tolist(), *ends(rng, 5, total).tolist()}))
        b = a.copy() if case % 10 == 9 else b
        got = alignment.Alignment(a, b)
        groups, links = plain_alignment(a.tolist(), b.tolist())
        assert list(zip(*(e.tolist() for e in got.ends), strict=True)) == groups
        assert sorted(zip(*(x.tolist() for x in got.links()), strict=True)) == sorted(links)


def test_block_without_tokens():
    none = alignment.Alignment(alignment.NONE, alignment.NONE)
    assert len(none.ends[0]) == 0 and len(none.links()[0]) == 0


def test_words_encode_as_whole_texts_do(corpus):
    """Cut at single spaces or not, texts have the libraries' ids; the first side is the vocabulary's own library."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(FIRST)
    own.encode_special_tokens = True
    rng, tools = random.Random(1), alignment.Tokenizers(FIRST, SECOND, public_tokenizers.PATTERN)
    letters = " \n\t  ab'é́▁　１ﬁ.,<|endoftext|>日本😀"
    texts = [t for _, t in corpus] + ["".join(rng.choice([rng.choice(letters), rng.choice([" ", "  ", "the ", " of", "\n\n", "'s "])]) for _ in range(rng.randint(1, 14))) for _ in range(1_500)]
    sides = tools.tokens(texts)
    cuts = [np.concatenate([[0], np.cumsum(s.sizes)]) for s in sides]
    for i, text in enumerate(texts):
        a, b = (s.values[c[i] : c[i + 1]].tolist() for s, c in zip(sides, cuts, strict=True))
        want = own.encode(" " + text, add_special_tokens=False).ids if text else []
        whole = tools.encoded(text) if text else None
        assert (a, b) == (([], []) if whole is None else (want, tools.b.encode(text)))


def test_alignment_of_documents(docs, corpus, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 20_000)
    tools, count, want = alignment.Tokenizers(FIRST, SECOND, public_tokenizers.PATTERN), Counter(), []
    for i, text in corpus:
        a, b = (x.tolist() for x in ((tools.encoded(text) if text else None) or (alignment.NONE, alignment.NONE)))
        ea, eb = (np.cumsum([len(t[x]) for x in s]).tolist() for t, s in ((tools.a_bytes, a), (tools.b_bytes, b)))
        groups, links = plain_alignment(ea, eb)
        links = [(a[x], b[y]) for x, y in links]
        count.update(links)
        spelled, before = [], (0, 0)
        for g in groups:
            spelled.append(",".join(map(str, a[before[0] : g[0]])) + "|" + ",".join(map(str, b[before[1] : g[1]])))
            before = g
        want.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(spelled).encode()).hexdigest() if groups else ""))
    best: dict[int, int] = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    rows = Counter((i, na, nb, g, len(x), h, sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x)) for i, na, nb, g, x, h in want)
    got = alignment.counted(*alignment.aligned(docs, FIRST, SECOND, public_tokenizers.PATTERN)).collect()
    assert Counter(map(tuple, got)) == rows
    assert alignment.counted(*alignment.aligned(docs.limit(0), FIRST, SECOND, public_tokenizers.PATTERN)).count() == 0
