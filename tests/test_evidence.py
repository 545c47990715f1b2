"""Evidence of products against loops in Python, its edge cases, and rounds by group."""

import math

from pyspark.sql import functions as F

from quarrystone.operators import evidence, search

PRODUCTS = [(1, 3), (2, 1), (3, 1), (4, 0)]
LINKS = [(1, 10), (2, 10), (2, 20), (3, 30), (3, 40), (4, 99)]
CHUNKS = [(100, 10, "gold fund", [1.0, 0.0]), (101, 10, "gold gold bond", [0.0, 1.0]), (200, 20, "gold", None), (300, 30, None, [1.0, 1.0]), (400, 40, "bond fund", [1.0, 0.1]), (900, 77, "gold bond fund", [1.0, 0.0])]
QUERIES = [(1, "gold fund", [1.0, 0.0]), (2, "bond", None), (3, "nothing", None), (4, None, [0.0, 2.0])]


def frames(spark, products=PRODUCTS, links=LINKS, chunks=CHUNKS, queries=QUERIES):
    return (
        spark.createDataFrame(products, "product_id long, score int"),
        spark.createDataFrame(links, "product_id long, document_id long"),
        spark.createDataFrame(chunks, "chunk_id long, document_id long, text string, v array<double>"),
        spark.createDataFrame(queries, "query_id long, text string, q array<double>"),
    )


def by_hand(top):
    owner = {}
    for p, _ in sorted(PRODUCTS, key=lambda x: (-x[1], x[0])):
        for q, d in LINKS:
            if q == p:
                owner.setdefault(d, p)
    words = {c: (t or "").split() for c, _, t, _ in CHUNKS}
    mean = sum(map(len, words.values())) / len(words)
    home = {c: owner[d] for c, d, _, _ in CHUNKS if d in owner}
    out = []
    for qid, text, q in QUERIES:
        score = {}
        for term in dict.fromkeys((text or "").split()):
            df = sum(term in w for w in words.values())
            for c, w in words.items():
                if term in w and c in home:
                    tf = w.count(term)
                    score[c] = score.get(c, 0) + math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        lists = [sorted(score, key=lambda c: (-round(score[c], 6), c))]
        near = {c: round(sum(a * b for a, b in zip(v, q, strict=True)) / math.hypot(*v) / math.hypot(*q), 6) for c, _, _, v in CHUNKS if q and v and c in home}
        lists.append(sorted(near, key=lambda c: (-near[c], c)))
        total, first = {}, {}
        for k, ids in enumerate(lists):
            for i, c in enumerate(ids, 1):
                total[c] = total.get(c, 0) + 1 / (60 + i)
                first.setdefault(c, (k, i))
        ranked = sorted(total, key=lambda c: (-round(total[c], 9), first[c], c))
        groups = {}
        for c in ranked:
            groups.setdefault(home[c], []).append(c)
        turns = [(qid, g[i], p, i + 1) for i in range(len(ranked)) for p, g in groups.items() if i < len(g)]
        out += [(*t, n) for n, t in enumerate(turns[:top], 1)]
    return out


def test_R01_R07_evidence(spark):
    out, issues = evidence.evidence(*frames(spark), top=4)
    got = sorted((r.query_id, r.chunk_id, r.product_id, r.round, r.position) for r in out.collect())
    assert got == sorted(by_hand(4)) and {r[0] for r in got} == {1, 2, 4}
    assert sorted((r.code, r.query_id, r.product_id) for r in issues.collect()) == [("MISSING_DOCUMENT_MAPPING", None, 4), ("NO_PRODUCT_EVIDENCE", 3, None)]


def test_evidence_of_empty_tables(spark):
    out, issues = evidence.evidence(*frames(spark, products=[]))
    assert out.count() == 0 and {r.code for r in issues.collect()} == {"NO_PRODUCT_EVIDENCE"}
    out, issues = evidence.evidence(*frames(spark, chunks=[], queries=[]))
    assert out.count() == 0 and sorted(r.product_id for r in issues.collect()) == [1, 2, 3, 4]


def test_W11_groups_keep_the_order_of_their_best(spark):
    rows = [(1, "a", 9.0), (1, "b", 8.0), (1, "b", 7.0), (1, "a", 1.0), (1, "c", 0.5)]
    df = spark.createDataFrame(rows, "k int, g string, s double")
    got = search.round_robin(df, "k", "g", [F.desc("s")]).orderBy("position").collect()
    assert [(r.g, r.s) for r in got] == [("a", 9.0), ("b", 8.0), ("c", 0.5), ("a", 1.0), ("b", 7.0)]
