"""Steps whose cost must not outgrow their input: what they gave before, and what their plans and tasks may not do."""

import contextlib
import io
import math
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrystone.operators import build, chunks, etl, evidence, graph, postings, search
from quarrystone.plans import catalogue
from quarrystone.sources import graph_sink, tables
from quarrystone.streaming import timed


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def stored(spark, folder, **tables):
    """A folder of tables for a query."""
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_F01_enterprise_events_take_one_pass(spark, tmp_path):
    d = stored(spark, tmp_path, part=spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "p_partkey long, p_size int"))
    df = catalogue.QUERIES["etl_enterprise_events"](spark, d)
    assert "Join" not in plan(df) and "Broadcast" not in plan(df)
    assert sorted((r.p_partkey, r.position, r.policy) for r in df.collect())[:3] == [(1, 0, "INDUSTRY_TREND"), (1, 0, "INDUSTRY_TREND"), (1, 1, "INDUSTRY_TREND")] and df.count() == 12


def test_F04_metrics_rows_are_spread_and_years_looked_back_36_code_points(spark, tmp_path):
    d = stored(spark, tmp_path, part=spark.range(100).selectExpr("id as p_partkey", "1 as p_size").coalesce(1))
    assert "RoundRobinPartitioning" in plan(catalogue.QUERIES["etl_metrics"](spark, d))
    cell = ["2021年" + "𠀀" * 31 + "净利润1亿元，净利润2亿元", "2021年" + "𠀀" * 32 + "净利润1亿元", "净利润1亿元2020年净利润2亿元；归母净利润3亿元"]
    df = spark.createDataFrame(list(enumerate(cell)), "k int, cell string")
    got = sorted((r.k, r.period, float(r.value)) for r in etl.financial_metrics(df, ["k"], "cell").collect())
    assert got == [(0, "2021", 1.0), (0, "2025", 2.0), (1, "2025", 1.0), (2, "2020", 3.0), (2, "2025", 1.0)]


def test_F05_answers_are_spread(spark, tmp_path):
    d = stored(spark, tmp_path, customer=spark.range(100).selectExpr("id as c_custkey").coalesce(1))
    assert "RoundRobinPartitioning" in plan(catalogue.QUERIES["customer_results"](spark, d))
    assert "RoundRobinPartitioning" in plan(catalogue.QUERIES["scheme_results"](spark, d))


def test_F12_tables_are_spread(spark, tmp_path):
    d = stored(spark, tmp_path, part=spark.range(100).selectExpr("id as p_partkey", "7 as p_size", "'n' as p_name", "'b' as p_brand", "'t' as p_type").coalesce(1))
    for name in ("table_chunks", "table_units"):
        assert "RoundRobinPartitioning" in plan(catalogue.QUERIES[name](spark, d))


def test_F02_F03_vectors_are_searched_in_packs(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11 - 5) for j in range(4)]) for i in range(1, 60)] + [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [1.0]), (63, [1.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, v array<double>")
    q = v.where("vec_id % 5 = 0").selectExpr("vec_id as query_id", "v as q")

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in a + b:
            return None
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5), 6)

    for own, k in ((False, 3), (True, 1), (False, 70)):
        want = []
        for i, a in rows:
            if i % 5 == 0:
                found = [(cosine(a, b), j) for j, b in rows if own or i != j]
                found.sort(key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
                want += [(i, j, s, n) for n, (s, j) in enumerate(found[:k], 1)]
        df = search.cosine_top(v, q, k, own=own)
        assert "mapInArrow" in plan(df) or "MapInArrow" in plan(df)
        assert sorted(map(tuple, df.collect())) == sorted(want)
    zero = search.cosine_top(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], v.schema), spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>"), 1)
    assert [(r.vec_id, str(r.score)) for r in zero.collect()] == [(2, "nan")]


def test_F06_chunks_leave_a_task_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(chunks, "HELD", 1_000)
    docs = spark.createDataFrame([(i, "x" * 450 + "。" + "y" * 450) for i in range(7)] + [(7, None), (8, "")], "doc_id long, text string").coalesce(1)
    df = chunks.chunked(docs)
    assert "MapInArrow" in plan(df) and "MapInPandas" not in plan(df)
    assert sorted((r.doc_id, r.position, r.tokens) for r in df.collect()) == [(i, n, t) for i in range(7) for n, t in ((1, 451), (2, 450))]


def test_F08_F11_F13_partitions_grow_with_the_count(spark, tmp_path):
    assert tables.by_key(spark.range(101), "id", rows=10).rdd.getNumPartitions() == 11
    rows = spark.range(90).selectExpr("id div 7 as l_orderkey", "cast(id % 7 as int) as l_linenumber", "id as l_suppkey", "id as l_partkey", "cast(1 as double) as l_quantity")
    d = stored(spark, tmp_path, lineitem=rows)
    for name in ("steady_clauses", "steady_siblings", "embedding_batches"):
        assert "REPARTITION_BY_NUM" in plan(catalogue.QUERIES[name](spark, d))


def test_F14_bad_rows_dont_make_a_sink_look_at_good_ones(spark, tmp_path, monkeypatch):
    looked, check = [], graph_sink.checked
    monkeypatch.setattr(graph_sink, "checked", lambda row: looked.append(row["id"]) or check(row))
    kinds = [(i, "王", None, [("名", "x"), ("b", None)]) for i in range(600)] + [(i, "A", "e", None) for i in range(600, 1_200)]
    rows = [{"id": f"{p}{i}", "label": "A b" if i % 100 == 7 else "A", "start_id": e and "s", "end_id": e, "properties": m} for i, p, e, m in kinds]
    odd = [("", "A", None, "BLANK_ID"), ("\x1c", "A", None, "BLANK_ID"), (None, "A", None, "BLANK_ID"), ("x", None, None, "LABEL"), ("y", "A\n", None, "LABEL"), ("z", "A", "e", "ENDPOINT_NOT_FOUND")]
    rows += [{"id": i, "label": n, "start_id": None, "end_id": e, "properties": None} for i, n, e, _ in odd] + [{"id": "w", "label": "A", "start_id": "", "end_id": None, "properties": [("a", "1"), ("\u3000", "2")]}]
    batch = pa.RecordBatch.from_pylist(rows[::-1], graph_sink.ARROW).slice(0, len(rows))
    done = graph_sink.Writer({"path": f"file://{tmp_path}"}).write(iter([batch.slice(0, 5), batch.slice(5)]))
    assert (done.merged, done.failed) == (1_188, 19) and len(looked) < 30
    graph_sink.commit(f"file://{tmp_path}", "one", {"merged": done.merged, "failed": done.failed, "names": done.names})
    lost = {(r.id, r.reason) for r in graph_sink.failed(spark, f"file://{tmp_path}").collect()}
    assert lost == {(i, reason) for i, _, _, reason in odd} | {("w", "PROPERTY_NAME")} | {(f"{p}{i}", "LABEL") for i, p, _, _ in kinds if i % 100 == 7}
    assert graph_sink.graph(spark, f"file://{tmp_path}").count() == 1_188


def test_F07_F09_F10_scores_are_summed_where_documents_are(spark, monkeypatch):
    for name, n in (("DOCS", 7), ("POSTINGS", 40), ("QUERIES", 2), ("PARTS", 5), ("TEXTS", 90)):
        monkeypatch.setattr(postings, name, n)
    words = ["stone", "river", "w1", "Ünder", "银行理财", "银行x", "a_b"]
    docs = [(i, " ".join(words[(i * j + j * j) % 7] for j in range(i % 9))) for i in range(40)] + [(50, "stone"), (50, "river"), (51, "stone w1"), (51, "river w1"), (52, None), (53, "")] + [(60 + i, "river, stone!") for i in range(30)]
    asked = [(1, "stone w1"), (2, "RIVER 银行理财 x"), (3, "b river river"), (4, "nothing"), (5, None)]
    terms = lambda rows: {k: v for k, v in spark.createDataFrame(rows, "k string, t string").select("k", search.terms(F.coalesce("t", F.lit("")))).collect()}
    split = terms([(t, t) for _, t in docs + asked])
    groups, mean = {}, sum(len(split[t]) for _, t in docs) / len(docs)
    for i, t in docs:
        groups.setdefault((i, len(split[t])), []).extend(split[t])
    df, want = Counter(w for found in groups.values() for w in set(found)), {}
    for (i, n), found in groups.items():
        for q, t in asked:
            for w in set(split[t]) & set(found):
                tf = found.count(w)
                want[q, i] = want.get((q, i), 0) + math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, text string")
    odd = spark.createDataFrame([(i,) for i in range(1, 90, 2)], "doc_id long")
    for most, within in ((search.VOCABULARY, None), (search.VOCABULARY, odd), (2, None)):
        monkeypatch.setattr(search, "VOCABULARY", most)
        best = {}
        for (q, i), s in want.items():
            if within is None or i % 2:
                best.setdefault(q, []).append((-round(s, 6), i))
        got = search.bm25(*frames, 5, within=within)
        assert "MapInArrow" in plan(got) and "BroadcastHashJoin" not in plan(got).split("MapInArrow")[0]
        assert sorted((r.query_id, r.rank, r.doc_id, r.score) for r in got.collect()) == [(q, n, i, -s) for q in sorted(best) for n, (s, i) in enumerate(sorted(best[q])[:5], 1)]
    assert search.bm25(frames[0].limit(0), frames[1], 5).count() == 0 == search.bm25(frames[0], frames[1].limit(0), 5).count()


def test_F07_F09_terms_are_found_without_patterns_over_texts(spark, monkeypatch):
    odd = ["", "a_b  c", "é\u0301x", "王", "王王 a王王b 王", "\U00020000\U00020000x", "ß½²٣", "\U0010ffffz", "x", "x" * 9, " ", "\u3042\u4e00\u4e01、\u4e8c", *["".join(map(chr, range(c, c + 97))) for c in range(32, 0x800, 97)]]
    want = [sorted(r.t) for r in spark.createDataFrame(list(enumerate(odd)), "i int, t string").orderBy("i").select(search.terms(F.col("t")).alias("t")).collect()]
    monkeypatch.setattr(postings.pc, "replace_substring_regex", lambda *a, **b: pytest.fail("a pattern over whole texts"))
    lower = pa.array(["cut", *[t.lower() for t in odd], None])
    for texts in (lower, lower.cast(pa.large_string())):
        found, at = postings.words(texts[1:])
        got = [[] for _ in range(len(odd) + 1)]
        for i, w in zip(at.tolist(), found.to_pylist(), strict=True):
            got[i].append(w)
        assert [sorted(g) for g in got] == [*want, []]
    assert len(postings.words(lower[:0])[0]) == 0


def test_F07_F09_evidence_reads_links_and_products_once(spark, tmp_path):
    """What several steps read are ids that are stored; links beyond the documents' ids are not moved."""
    frames = {
        "found": spark.createDataFrame([(1, 3), (2, 1), (3, 0)], "product_id long, score int"),
        "links": spark.createDataFrame([(1, 10), (1, 10), (2, 10), (2, 20), (3, 15), (2, 5), (2, 99), (None, 10), (1, None)], "product_id long, document_id long"),
        "chunks": spark.createDataFrame([(100, 10, "gold fund"), (200, 20, "gold"), (201, 20, "bond"), (300, None, "gold")], "chunk_id long, document_id long, text string"),
        "queries": spark.createDataFrame([(1, "gold", None)], "query_id long, text string, q array<double>"),
    }
    d = stored(spark, tmp_path, **frames)
    vectors = spark.createDataFrame([], "chunk_id long, v array<double>")
    out, issues = evidence.evidence(*[tables.table(spark, d, n) for n in frames], vectors=vectors)
    for df in (out, issues):
        assert not [f for f in df.inputFiles() if "/links.parquet" in f or "/found.parquet" in f]
    assert sorted((r.chunk_id, r.product_id) for r in out.collect()) == [(100, 1), (200, 2)]
    assert [(r.code, r.product_id) for r in issues.collect()] == [("MISSING_DOCUMENT_MAPPING", 3)]


def test_F09_issues_take_neither_scores_nor_ranks(spark, tmp_path, monkeypatch):
    """Issues alone against those of the ranked evidence, then those of the query while nothing may be scored or ranked, or products read again."""
    found = spark.createDataFrame([(1, 3), (2, 1), (2, 1), (3, 0), (None, 1)], "product_id long, score int")
    links = spark.createDataFrame([(1, 10), (1, 10), (2, 20), (2, 99), (None, 10), (1, None), (7, 30)], "product_id long, document_id long")
    texts = [(100, 10, "gold fund"), (101, 10, None), (101, 30, "twice"), (200, 20, "王王王 x"), (300, 30, "silver"), (None, 10, "void"), (400, None, "lost")]
    asked = [(1, "GOLD, gold", None), (2, "silver", None), (3, "王王", None), (4, "王", None), (5, "twice", None), (6, "void", None), (7, "lost", None), (8, None, None), (9, "", [1.0, None]), (9, "silver", None), (None, "gold", [1.0, 0.0]), (10, "silver", []), (11, "silver", [0.0, 2.0])]
    chunks, queries = spark.createDataFrame(texts, "chunk_id long, document_id long, text string"), spark.createDataFrame(asked, "query_id long, text string, q array<double>")
    none = {2, 4, 6, 7, 8, None}
    rows = lambda df: sorted(((r.stage, r.code, r.query_id, r.product_id) for r in df.collect()), key=str)
    for vecs, most in (([(100, [0.0]), (300, [1.0, 1.0]), (200, None), (None, [1.0])], search.VOCABULARY), ([(300, [1.0, 1.0]), (200, None)], 2)):
        vectors = spark.createDataFrame(vecs, "chunk_id long, v array<double>")
        monkeypatch.setattr(search, "VOCABULARY", most)
        got = rows(evidence.issues(found, links, chunks, queries, vectors=vectors))
        assert most == 2 or got == rows(evidence.evidence(found, links, chunks, queries, vectors=vectors)[1])
        assert {r[2] for r in got if r[1] == "NO_PRODUCT_EVIDENCE"} == none | (set() if most > 2 else {9, 10, 11})
    d = stored(
        spark, tmp_path,
        part=spark.createDataFrame([(1, "economy", "t", "Brand#11", 1, 900.0), (2, "n", "economy", "Brand#12", 1, 900.0), (3, "economy", "t", "Brand#15", 1, 900.0), (4, "economy", "t", "Brand#11", 1, 990.0)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double"),
        lineitem=spark.createDataFrame([(1, 5), (3, 6), (2, 77)], "l_partkey long, l_orderkey long"), documents=spark.createDataFrame([(5, "gold"), (6, "silver")], "doc_id long, text string"),
        embeddings=spark.createDataFrame([(6, [1.0])], "vec_id long, embedding array<float>"), benchmark=spark.createDataFrame([(1, "gold"), (2, "silver"), (6, "silver")], "item_id long, text string"),
    )
    for name in ("bm25", "cosine_top", "fused", "round_robin"):
        monkeypatch.setattr(search, name, lambda *a, **b: pytest.fail("a rank that no issue needs"))
    df = catalogue.QUERIES["product_issues"](spark, d)
    assert not [f for f in df.inputFiles() if "/part.parquet" in f or "/lineitem.parquet" in f]
    assert rows(df) == sorted([("DOCUMENT_MAPPING", "MISSING_DOCUMENT_MAPPING", None, 2), ("RETRIEVAL", "NO_PRODUCT_EVIDENCE", 2, None), ("RETRIEVAL", "NO_PRODUCT_EVIDENCE", 6, None)], key=str)


def test_F17_preflight_joins_each_pair_of_ids_once(spark):
    nodes = spark.createDataFrame([("n1", "Person"), ("n1", "Person"), ("n2", "Alien"), (None, "Person")] * 3, "node_id string, node_type string")
    relations = spark.createDataFrame([("r1", "n1", "e1", "WORKS_AT"), ("r1", "n9", "n1", "WORKS_AT"), ("r2", None, "n1", "WORKS_AT")] * 3, "relation_id string, start_node_id string, end_node_id string, relation_type string")
    events = spark.createDataFrame([("e1", "n1"), ("e2", "n9"), ("n2", "n1"), ("e3", None), (None, "n1")] * 3, "event_id string, subject_node_id string")
    df = graph.preflight(nodes, relations, events)
    assert "LeftAnti" not in plan(df) and "LeftSemi" not in plan(df)  # these are moved to before what drops repeated rows
    got = {(r.code, r.id) for r in df.collect() if not r.code.startswith(("DUPLICATE", "INVALID"))}
    assert got == {("ENTITY_ID_CONFLICT", "n2"), ("ENTITY_ID_CONFLICT", None), ("EVENT_SUBJECT_NOT_FOUND", "e2"), ("EVENT_SUBJECT_NOT_FOUND", "e3"), ("DANGLING_RELATION", "r1"), ("DANGLING_RELATION", "r2")}
    assert sorted((r.relation_id, r.missing) for r in graph.dangling(relations.where("relation_id = 'r1'"), nodes).collect()) == [("r1", "e1"), ("r1", "n9")]


def test_F15_a_key_of_a_stream_costs_no_frames_of_its_own(spark, monkeypatch):
    """The step of a key against plain pandas: nothing is sorted, cast or iterated as a frame."""
    held = []

    class State:
        exists, hasTimedOut = False, False
        update = setTimeoutTimestamp = remove = lambda self, *x: held.append(x)
        getCurrentWatermarkMs = lambda self: 0

    steps = []
    frame = type(spark.range(1).groupBy("id"))
    monkeypatch.setattr(frame, "applyInPandasWithState", lambda self, step, *a: steps.append(step))
    timed.answered(spark.createDataFrame([], "key long, action_id long, ts timestamp, ok boolean"))
    for name in ("sort_values", "itertuples", "astype"):
        monkeypatch.setattr(pd.DataFrame, name, lambda *a, **b: pytest.fail("a step of a frame"))
    minute = timed.MINUTE
    rows = pd.DataFrame([(5, None, 190 * minute, False), (1, None, 10 * minute, True), (2, None, minute, False), (4, None, 189 * minute, True), (3, None, 10 * minute, True)], columns=["action_id", "ts", "at", "ok"])
    for parts in ([rows], [rows[:2], rows[2:]]):
        (out,) = steps[0]((7,), iter(parts), State())
        got = list(zip(*[out[c].astype(object).where(out[c].notna(), None).tolist() for c in ("key", "action_id", "outcome", "result_of")], strict=True))
        assert got == [(7, 2, "FAILED", None), (7, 1, "EXECUTED", 1), (7, 3, "REPLAYED", 1), (7, 4, "REPLAYED", 1), (7, 5, "FAILED", None)]
    assert held == []


def test_F16_issues_of_links_bring_their_owners(spark):
    link = "relation_id long, enterprise_id long, enterprise_name string, relation_type string, raw_text string, source_id long, verification_status string"
    links = [(1, 5, "Firm", "FRIEND", "", 1, "open"), (1, 5, "Firm", "FRIEND", "", 1, "open"), (2, 5, "Firm", "controller", "", 1, "open"), (3, 6, "Firm", "EMPLOYEE", "", 1, "open")]
    rows = [(f"person:{i}", i, "n", "t", None, None, 1, "open", links if i == 1 else [(9, 5, "Firm", "FRIEND", "", 1, "open")]) for i in (1, 2)]
    taken = spark.createDataFrame(rows, f"owner string, person_id long, full_name string, person_type string, marital_status string, birth_date string, source_id long, verification_status string, links array<struct<{link.replace(' ', ':').replace(',:', ',')}>>")
    made = build.persons_with_enterprises(taken, spark.createDataFrame([(1,)], "source_id long"))
    assert "Join [source_pk" not in plan(made.issues)  # no look-up among all links
    assert sorted((r.owner, r.reason) for r in made.issues.collect()) == [("person:1", "STRICT_RELATION_VERIFICATION"), ("person:1", "UNKNOWN_ENUM"), ("person:2", "UNKNOWN_ENUM")]


def test_F16_unlike_elements_are_found_without_sorting_all(spark):
    element = "owner string, id string, label string, start_id string, end_id string"
    rows = [("a", "same", "L", None, None), ("b", "same", "L", None, None), ("a", "ends", "L", "same", None), ("b", "ends", "L", None, "same"), ("a", "label", None, None, None), ("b", "label", "L", None, None), ("a", "old", "L", None, None), ("a", "kept", "L", None, None), ("a", None, "L", None, None), ("b", None, "M", None, None)]
    stored_rows = spark.createDataFrame([("old", "M", None, None), ("kept", "L", None, None)], element.removeprefix("owner string, "))
    df = build._refusals(spark.createDataFrame(rows, element), stored_rows)
    assert "SortAggregate" not in plan(df)
    found = {(r.owner, r.reason) for r in df.collect()}
    assert found == {("a", "DANGLING_RELATION"), ("b", "DANGLING_RELATION"), ("a", "CONFLICTING_ID"), ("b", "CONFLICTING_ID")}
    assert df.where("reason = 'CONFLICTING_ID'").count() == 5
