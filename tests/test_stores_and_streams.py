"""Stored index, block streams, graph sink, many names, canonical records, digests and sketches."""

import json
import random
import re
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import records
from quarrystone.operators import masking, relational, search, streams
from quarrystone.operators.chunks import chunked, pieces
from quarrystone.operators.inverted import Index
from quarrystone.sources import graph_sink as sink
from quarrystone.streaming import timed

WORDS = ["stone", "river", "light", "cloud", "银行", "理财产品", "x1", "Ünder", "green", "wave"]


def text(rng, n):
    return " ".join(rng.choices(WORDS + [f"w{i}" for i in range(300)], weights=[40] * 10 + [1] * 300, k=n))


# stored index


def test_index_equals_search_after_replacing(spark, tmp_path):
    """Results are those of a fresh search, with fewer postings read; a write that was cut off counts for nothing."""
    rng = random.Random(1)
    docs = {i: text(rng, rng.randint(1, 120)) for i in range(600)} | {700: None, 701: ""}
    frame = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, f"w{i} stone river light w{i + 7}") for i in range(12)] + [(90, "nothing here"), (91, None)], "query_id long, text string")
    index = Index.made(spark, f"file://{tmp_path}/index", frame(docs))

    def same():
        found, counts = index.top(queries, 5)
        got = [(r.query_id, r.doc_id, round(r.score, 5), r.rank) for r in found.orderBy("query_id", "rank").collect()]
        want = [(r.query_id, r.doc_id, round(r.score, 5), r.rank) for r in search.bm25(frame(docs), queries, 5).orderBy("query_id", "rank").collect()]
        assert got == want
        read = {r.step: r.postings for r in counts.collect()}
        assert 0 < read["first"] + read["main"] + read["late"] < read["all"]

    same()
    new = {i: text(rng, 40) for i in range(0, 90, 3)} | {900: "stone w3 w3 w3", 701: "river"}
    index.put(frame(new), spark.createDataFrame([(i,) for i in (1, 4, 5_000)], "doc_id long"))
    docs = {i: t for i, t in (docs | new).items() if i not in (1, 4)}
    assert index.segments() == [0, 1] and index.docs().count() == len(docs)
    same()
    cut = Index(spark, index.path, index.shards)
    cut._put = lambda part, n, rows: (_ for _ in ()).throw(OSError("lost")) if part == "commits" else Index._put(cut, part, n, rows)
    with pytest.raises(OSError, match="lost"):
        cut.put(frame({2: "stone"}))
    assert index.segments() == [0, 1]
    same()
    index.put(frame({2: "stone w2"}).limit(0))
    assert index.segments() == [0, 1, 2] and index.docs().count() == len(docs)


# block streams


def plain_chunks(blocks, target, most):
    """(position, kind, path, content, cut) of one document by groups of all its blocks."""
    heads, groups = [], []
    for _, kind, level, t, rows in blocks:
        if kind == "table":
            units = [" | ".join((c or "").strip() for c in r) for r in rows or [] if any((c or "").strip() for c in r)]
            groups.append(("table", [h for _, h in heads], units or ([t.strip()] if t and t.strip() else [])))
        elif t and t.strip():
            if kind == "heading" and level is not None:
                heads = [h for h in heads if h[0] < level] + [(level, t)]
            path = [h for _, h in heads]
            if not groups or groups[-1][0] != "text" or groups[-1][1] != path:
                groups.append(("text", path, []))
            groups[-1][2].append(t)
    out = []
    for kind, path, units in groups:
        held = []
        for unit in units:
            if held and (len("\n".join([*held, unit])) > most or len("\n".join(held)) >= target):
                out.append((kind, path, "\n".join(held), False))
                held = []
            if len(unit) > most:
                if held:
                    out.append((kind, path, "\n".join(held), False))
                    held = []
                out += [(kind, path, p, True) for p in pieces(unit, len, target, most)]
            else:
                held.append(unit)
        if held:
            out.append((kind, path, "\n".join(held), False))
    return [(n, *x) for n, x in enumerate(out, 1)]


def test_chunks_of_block_streams(spark):
    rng, docs = random.Random(2), {}
    for d in [None, 7, 1_234_567, 1_234_568, *range(20, 40)]:
        blocks = []
        for i in range(rng.choice([0, 1, 5, 60])):
            kind = rng.choice(["heading", "paragraph", "paragraph", "list", "table"])
            rows = [[rng.choice(["a", " ", None, "cell " * 9]) for _ in range(3)] for _ in range(rng.randint(0, 4))] if kind == "table" else None
            blocks.append((i, kind, rng.choice([1, 2, 3, None]), rng.choice([None, " ", text(rng, 3), text(rng, 30), text(rng, 90)]), rows))
        docs[d] = blocks
    df = spark.createDataFrame([(d, *b, "x") for d, bs in docs.items() for b in bs], "doc_id long, position int, kind string, level int, text string, rows array<array<string>>, cut string").repartition(5)
    got: dict = {}
    for r in streams.chunked_blocks(df, target=60, most=90).orderBy("position").collect():
        got.setdefault(r.doc_id, []).append((r.position, r.kind, r.path, r.content, r.cut))
        assert r.tokens == len(r.content) and (r.doc_id is None or r.chunk_id == f"D{r.doc_id:06d}_C{r.position:04d}")
    assert got == {d: w for d, b in docs.items() if (w := plain_chunks(b, 60, 90))}
    assert streams.chunked_blocks(df.limit(0)).count() == 0


def test_a_counter_of_path_and_content_and_limits():
    fold = streams.Fold(lambda path, content: len(content) + sum(map(len, path)), 20, 30)
    out = [c for i, b in enumerate([("heading", 1, "a" * 8), ("paragraph", None, "b" * 10), ("paragraph", None, "c" * 10), ("paragraph", None, "d" * 40)]) for c in fold.take(1, i, *b, None)] + fold.end()
    assert all(c[5] <= 30 for c in out) and "".join(c[4].replace("\n", "") for c in out) == "a" * 8 + "b" * 10 + "c" * 10 + "d" * 40
    with pytest.raises(ValueError, match="limits"):
        streams.Fold(streams.code_points, 5, 4)
    with pytest.raises(ValueError, match="alone"):
        streams.Fold(lambda path, content: 10 + len(content), 5, 9).take(1, 0, "paragraph", None, "x", None)


def test_a_long_document_is_held_a_chunk_at_a_time():
    fold, most, n = streams.Fold(streams.code_points, 400, 500), 0, 0
    for i in range(60_000):
        n += len(fold.take(1, i, "paragraph", None, "some words of a block", None))
        most = max(most, len(fold.units))
    assert most <= 25 and n > 2_500


def test_ids_of_chunks_are_not_cut(spark):
    df = spark.createDataFrame([(1_234_567, "a"), (1_234_568, "b"), (3, "x" * 900)], "doc_id long, text string")
    assert {r.chunk_id for r in chunked(df, target=300, most=300).collect()} == {"D1234567_C0001", "D1234568_C0001", "D000003_C0001", "D000003_C0002", "D000003_C0003"}


# graph sink


def element(i, label="Person", start=None, end=None, **properties):
    return (i, label, start, end, properties or None)


PICKY = '''
from quarrystone.sources.graph_sink import Files

class Picky(Files):
    """A store whose batches fail for a reason of its own."""

    def merge(self, rows):
        if any((r["properties"] or [("", "")])[0][1] == "poison" for r in rows):
            raise OSError("refused by the store")
        super().merge(rows)
'''


def test_graph_sink_loses_bad_rows_only(spark, tmp_path):
    (tmp_path / "picky_store.py").write_text(PICKY)
    spark.sparkContext.addPyFile(str(tmp_path / "picky_store.py"))
    path = f"file://{tmp_path}/graph"
    rows = [element(f"n{i}", name=f"x{i}") for i in range(40)] + [element("", name="x"), element("n41", "two words"), element("r1", "KNOWS", "n1", None), element("r2", "KNOWS", "n1", "n2"), element("n5", name="y"), element("n6", **{" ": "x"}), element("p", name="poison")]
    df = spark.createDataFrame(rows, sink.SCHEMA).repartition(3)
    sink.write(df, path, "one", batch=7, target="picky_store:Picky")
    lost = sorted((r.id, r.reason) for r in sink.failed(spark, path).collect())
    assert lost == [("", "BLANK_ID"), ("n41", "LABEL"), ("n6", "PROPERTY_NAME"), ("p", "OSError"), ("r1", "ENDPOINT_NOT_FOUND")]
    state = lambda: sorted((r.id, r.label, r.start_id, tuple(sorted(r.properties.items()))) for r in sink.graph(spark, path).collect())
    first = state()
    assert len(first) == 41 and ("n5", "Person", None, (("name", "y"),)) in first and ("r2", "KNOWS", "n1", ()) in first
    sink.write(df.repartition(5), path, "one", batch=3, target="picky_store:Picky")
    assert state() == first and sink.failed(spark, path).count() == 5  # a rerun changes nothing
    sink.write(spark.createDataFrame([element("n1", "Client", age="4")], sink.SCHEMA), path, "two")
    sink.write(df, path, "one", target="picky_store:Picky")
    assert ("n1", "Client", None, (("age", "4"), ("name", "x1"))) in state() and [m["order"] for m in sink.manifests(path)] == [1, 2]
    sink.write(df.limit(0), path, "three")
    assert len(sink.manifests(path)) == 3


def test_graph_sink_killed_writes_leave_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/graph"
    assert sink.graph(spark, path).count() == 0
    good = spark.createDataFrame([element("a", name="1")], sink.SCHEMA)
    sink.write(good, path, "one")
    dies = F.udf(lambda i: 1 // 0 if i == "c" else i)
    bad = spark.createDataFrame([element("a", name="2"), element("b", name="2"), element("c", name="2")], sink.SCHEMA).repartition(3).withColumn("id", dies("id"))
    with pytest.raises(Exception, match="ZeroDivisionError|division"):
        sink.write(bad, path, "two")
    assert [(r.id, r.properties) for r in sink.graph(spark, path).collect()] == [("a", {"name": "1"})]
    with pytest.raises(Exception, match="identifier"):
        sink.write(good, path, "../x")
    assert [m["run"] for m in sink.manifests(path)] == ["one"]


# many names


def one_by_one(names, value):
    """Each name's pattern over the whole text, longest name first."""
    for name, alias in sorted(names, key=lambda k: (-len(k[0]), k[0])):
        pattern = masking.GAP.join(map(re.escape, name))
        if name.isascii() and name[:1].isalnum():
            pattern = rf"(?<![A-Za-z0-9]){pattern}(?![A-Za-z0-9])"
        value = re.sub(pattern, lambda _, a=alias: a, value, flags=re.IGNORECASE)
    return value


def test_names_in_one_pass_equal_one_by_one():
    rng = random.Random(4)
    for _ in range(400):
        names = list({"".join(rng.choice("王大明ab c") for _ in range(rng.randint(2, 5))).strip(): f"P-{k}" for k in range(rng.randint(0, 9))}.items())
        names = [(n, a) for n, a in names if len(n) >= 2]
        value = "".join(rng.choice(["王", "大", "明", "a", "B", "c", " ", "​", "，", rng.choice(names)[0] if names else "x"]) for _ in range(rng.randint(0, 30)))
        assert masking.Names(names).replaced(value) == one_by_one(names, value), (names, value)
    assert masking.Names([]).replaced("a") == "a" and masking.Names([("ab", "P-1")]).replaced(None) is None


def test_rows_get_the_names_of_their_person(spark):
    names = [(p, f"客户{p}号{i}", f"P-{i}") for p in (1, 2) for i in range(300)]
    rows = [(k, p, f"见客户{p}号{k % 300}。客户1号7", {"a": "b"}) for k, p in enumerate([1, 2, 3, None] * 60)] + [(999, 1, None, None)]
    df = spark.createDataFrame(rows, "k int, person_id int, t string, more map<string,string>").repartition(4)
    out = masking.with_aliases(df, spark.createDataFrame(names, "person_id int, name string, alias string"), "t").collect()
    assert len(out) == len(rows)
    for r in out:
        p, old = rows[r.k][1:3] if r.k != 999 else (1, None)
        assert r.t == (one_by_one([(n, a) for q, n, a in names if q == p], old) if old else None) and (r.more == {"a": "b"} or r.k == 999)


# state with time


def run_stream(spark, build, schema, batches, folder):
    """Rows out of a stream that is stopped and started again after each file."""
    (folder / "in").mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"draft{n}"))
        part = next((folder / f"draft{n}").glob("part-*"))
        part.rename(folder / "in" / f"{n}.parquet")
        stream = build(spark.readStream.schema(schema).parquet(str(folder / "in")))
        stream.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(folder / "out")).collect()


def at(minute):
    return datetime(2024, 1, 1, tzinfo=UTC) + timedelta(minutes=minute)


def test_results_stand_for_a_time(spark, tmp_path):
    batches = [
        [("a", 1, at(0), False), ("a", 2, at(5), True), ("b", 3, at(6), True), ("a", 4, at(7), False), (None, 5, at(7), True)],
        [("a", 6, at(184), True), ("a", 7, at(185), True), ("b", 8, at(30), False), (None, 9, at(8), None)],
        [("c", 10, at(600), False), ("c", 11, at(601), True)],
        [("a", 12, at(602), False), ("b", 13, at(603), True), ("c", 14, at(604), None)],
    ]
    got = run_stream(spark, lambda s: timed.answered(s, 180, "200 minutes"), "key string, action_id long, ts timestamp, ok boolean", batches, tmp_path)
    want = {1: ("FAILED", None), 2: ("EXECUTED", 2), 4: ("REPLAYED", 2), 3: ("EXECUTED", 3), 5: ("EXECUTED", 5), 6: ("REPLAYED", 2), 7: ("EXECUTED", 7), 8: ("REPLAYED", 3), 9: ("REPLAYED", 5)}
    want |= {10: ("FAILED", None), 11: ("EXECUTED", 11), 12: ("FAILED", None), 13: ("EXECUTED", 13), 14: ("REPLAYED", 11)}
    assert {r.action_id: (r.outcome, r.result_of) for r in got} == want


def test_branches_meet_within_a_time(spark, tmp_path):
    batches = [
        [("w1", "P", 1, at(0)), ("w2", "P", 2, at(0)), ("w3", "P", 3, at(1)), ("w3", "R", 4, at(2)), ("w4", "R", 5, at(3)), ("w4", "R", 6, at(4)), ("w1", "X", 7, at(1))],
        [("w1", "R", 8, at(20)), ("w4", "P", 9, at(40))],
        [("w9", "P", 10, at(500))],
        [("w9", "R", 11, at(510))],
    ]
    got = run_stream(spark, lambda s: timed.met(s, "P", "R", 30, "60 minutes"), "key string, branch string, result_id long, ts timestamp", batches, tmp_path)
    rows = {tuple(r) for r in got}
    assert {("w1", 1, 8, "MET"), ("w3", 3, 4, "MET"), ("w4", None, 5, "TIMED_OUT"), ("w9", 10, 11, "MET"), ("w2", 2, None, "TIMED_OUT")} <= rows
    assert rows - {("w4", 9, None, "TIMED_OUT")} == {("w1", 1, 8, "MET"), ("w3", 3, 4, "MET"), ("w4", None, 5, "TIMED_OUT"), ("w9", 10, 11, "MET"), ("w2", 2, None, "TIMED_OUT")}


# records


def test_canonical_json_ignores_the_order_of_keys(spark):
    df = spark.sql("""SELECT * FROM VALUES (named_struct('b', map('y', named_struct('q', 1, 'p', array(2)), 'x', null), 'a', 'é'), map('k', 1, 'j', 2)) AS t(x, y)""")
    again = spark.sql("""SELECT * FROM VALUES (named_struct('a', 'é', 'b', map('x', null, 'y', named_struct('p', array(2), 'q', 1))), map('j', 2, 'k', 1)) AS t(x, y)""")
    bodies = [d.select(records.canonical_json(F.struct("x", "y"), d.schema)).first()[0] for d in (df, again)]
    assert bodies[0] == bodies[1] and list(json.loads(bodies[0])["x"]) == ["a", "b"]
    twins = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (1, {"b": "2", "a": "1"}), (2, {"a": "1"}), (2, {"a": "2"})], "id int, m map<string,string>")
    assert {(r.id, r.verdict) for r in relational.duplicates(twins, "id", ["m"]).collect()} == {(1, "IDENTICAL"), (2, "CONFLICT")}
    assert len({r[0] for r in twins.where("id = 1").select(masking.sealed(F.struct("m"), kind=twins.select("m").schema)[1]).collect()}) == 1


def test_loose_keys(spark):
    maps = [{"userName": "a"}, {"USER_NAME": "b", "user_name": " "}, {"Alias": "c"}, {"user-name": None, "alias": "d"}, {}, None, {"user_name": "e", "userName": "f"}, {"UserName": "2", "USERNAME": "1"}]
    df = spark.createDataFrame([(m,) for m in maps], "m map<string,string>")
    assert [r[0] for r in df.select(records.loose_value(F.col("m"), "user_name", "alias")).collect()] == ["a", "b", "c", "d", None, None, "e", "1"]


# digests and sketches


def test_digests_find_what_a_full_comparison_finds(spark):
    rng = random.Random(5)
    a = [(i, str(i % 9)) for i in range(2_000)] + [(5, "5"), (77, "77")]
    b = [(i, "other" if rng.random() < 0.01 else v) for i, v in a if rng.random() > 0.01] + [(9_000 + i, "x") for i in range(5)]
    left, right = (spark.createDataFrame(x, "id long, body string") for x in (a, b))
    want = sorted(map(tuple, relational.index_check(left, right, "id", ["body"], buckets=0).collect()))
    assert sorted(map(tuple, relational.index_check(left, right, "id", ["body"], buckets=256).collect())) == want and want
    assert sorted(map(tuple, relational.index_check(left, left, "id", ["body"]).collect())) == [(5, "DUPLICATE"), (77, "DUPLICATE")]


def test_sketches_in_one_pass(spark):
    df = spark.range(20_000).select(F.col("id").alias("a"), (F.col("id") % 100).cast("string").alias("b"), F.when(F.col("id") % 2 == 0, F.lit("2024-01-05")).alias("c"), F.lit(" ").alias("d"))
    whole = relational.sketched(df, df.columns)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    parts = relational.merged(relational.sketched(df.where("a < 7000"), df.columns).unionByName(relational.sketched(df.where("a >= 7000"), df.columns)))
    exact = {r.column: r.distinct for r in relational.exact_distinct(df, df.columns).collect()}
    assert exact == {"a": 20_000, "b": 100, "c": 1, "d": 1}
    for found in (whole, parts):
        for r in relational.estimated(found).collect():
            assert abs(r.distinct - exact[r.column]) <= 0.06 * exact[r.column] and r.rows == 20_000
            assert (r.nulls, r.numbers, r.dates, r.blanks) == {"a": (0, 20_000, 0, 0), "b": (0, 20_000, 0, 0), "c": (10_000, 0, 10_000, 0), "d": (0, 0, 0, 20_000)}[r.column]
