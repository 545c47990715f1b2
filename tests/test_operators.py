"""Operators on small inline tables, and every query against its SQL."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrystone.operators import chunks, graph, relational, search
from quarrystone.plans import catalogue

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cell = lambda x: "NULL" if x is None or x is pd.NaT or x is pd.NA or x != x else f"{float(x):.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, str(SF))
    if name in catalogue.ORACLES:
        got, want = got.toPandas(), duck.execute(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        for c in got.columns:
            if got[c].dtype.kind == "M":
                got[c], want[c] = got[c].astype("datetime64[us]"), want[c].astype("datetime64[us]")
            elif got[c].dtype.kind in "iuf" or want[c].dtype.kind in "iuf":
                got[c], want[c] = got[c].astype(float), want[c].astype(float)
        assert rows(got) == rows(want)
    else:
        assert got.count() > 0


def test_W09_chunks(spark):
    text = "一段话。" * 300 + "\n\n" + "x" * 1_300 + "\n" + "短句；" * 50
    parts = chunks.pieces(text, len)
    assert "".join(parts) == text and max(map(len, parts)) <= chunks.MOST
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = chunks.chunked(df).orderBy("position").collect()
    assert [r.content for r in got] == parts and got[0].chunk_id == "D000001_C0001"


def test_W06_section_paths(spark):
    blocks = [(1, 0, "heading", 1, "A"), (1, 1, "paragraph", None, "p"), (1, 2, "heading", 2, "B"), (1, 3, "paragraph", None, "q"), (1, 4, "heading", 1, "C"), (1, 5, "paragraph", None, "r")]
    got = chunks.section_paths(spark.createDataFrame(blocks, "page_id long, position int, kind string, level int, text string")).orderBy("position")
    assert [r.path for r in got.collect()] == [["A"], ["A"], ["A", "B"], ["A", "B"], ["C"], ["C"]]


def test_N18_lines(spark):
    got = spark.createDataFrame([("第一行\r\n续行。\n 12 \n1. 新条\n第 3 页\nword\nnext",)], "x string").select(chunks.normalized_lines(F.col("x"))).first()[0]
    assert got == "第一行续行。\n1. 新条word next"


def test_J21_J23_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "root string")
    assert {(r.node, r.distance) for r in graph.neighbourhood(edges, roots, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.src, r.dst, r.distance) for r in graph.edge_distances(edges, roots, 2).collect()} == {("a", "b", 1), ("b", "c", 2)}


def test_G16_duplicates(spark):
    df = spark.createDataFrame([("n1", 1, "a"), ("n1", 2, "b"), ("n2", 3, "c")], "node_id string, position int, v string")
    assert [r.v for r in graph.first_kept(df, "node_id", "position").orderBy("node_id").collect()] == ["a", "c"]
    assert [r.source_pk for r in graph.duplicate_issues(df, "node_id", "t").collect()] == ["n1"]


def test_F01_F03_filters(spark):
    df = spark.createDataFrame([(1, "José"), (2, "100%"), (3, None)], "k int, name string")
    assert relational.in_scope(df, "k", []).count() == 0 and relational.in_scope(df, "k", None).count() == 3
    assert [r.k for r in relational.containing(df, " jose ", "name").collect()] == [1]
    assert [r.k for r in relational.containing(df, "%", "name").collect()] == [2]
    assert relational.containing(df, " ", "name").count() == 3


def test_U06_G21(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, name string, note string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, name string")
    assert sorted(map(tuple, relational.merge(old, new, "id").collect())) == [(1, "a", None), (2, "c", "x"), (3, "d", None)]


def test_R01_T21_terms(spark):
    df = spark.createDataFrame([("Alpha，beta ALPHA | 中文词",)], "x string")
    assert df.select(search.query_terms(F.col("x"))).first()[0] == ["alpha", "beta", "中文词"]
    assert df.select(search.terms(F.col("x"))).first()[0] == ["alpha", "beta", "alpha", "中文", "文词"]


@pytest.mark.parametrize(
    ("value", "parser", "want"),
    [("一、投资范围", False, (True, 1, "一、投资范围", None)), ("（二）费用", False, (True, 2, "（二）费用", None)), ("1. 条款", True, (True, 3, "1. 条款", None)), ("1. 条款", False, (False, None, None, None)), ("普通", True, (True, None, "普通", None)), ("风险揭示书", False, (True, 1, "风险揭示书", None)), ("一、费用：" + "本产品收取的各项费用按照合同的约定从产品财产中列支。", False, (True, 1, "一、费用：", "本产品收取的各项费用按照合同的约定从产品财产中列支。")), ("一、" + "长" * 40, False, (False, 1, None, None))],
)
def test_N20_headings(spark, value, parser, want):
    got = spark.createDataFrame([(value, parser)], "t string, p boolean").select(chunks.heading(F.col("t"), F.col("p"), ["风险揭示书"]).alias("h")).first().h
    assert (got.is_heading, got.level if got.is_heading else want[1], got.heading, got.body) == want


def test_N21_tables(spark):
    df = spark.createDataFrame([([[" a", "b"], ["c"], ["", "d"]],)], "rows array<array<string>>").select(chunks.table_rows(F.col("rows")).alias("rows"))
    assert df.first().rows == [["a", "b"], ["c", ""], ["", "d"]]
    assert [tuple(p) for p in df.select(chunks.key_value_rows(F.col("rows")).alias("kv")).first().kv] == [("a", "b"), ("c", "")]


def test_W07_runs_and_markdown(spark):
    texts = ["1. a", "2. b", "x", "3. c", "9. d", "x", "x", "x", "10. e", "11. f"]
    df = spark.createDataFrame([(1, i, "paragraph", None, t) for i, t in enumerate(texts)] + [(2, 0, "heading", 2, "H"), (2, 1, "list", None, "i")], "page_id int, position int, kind string, level int, text string")
    assert [(r.first, r.last, r.size) for r in chunks.sibling_runs(df).collect()] == [(0, 3, 3)]
    assert {r.page_id: r.markdown for r in chunks.markdown(df).collect()}[2] == "## H\n\n- i"


def test_C09_C10(spark):
    df = spark.createDataFrame([("a", "x", 1), ("b", " ", 1), ("c", "y", 900), ("d", "y", 1), ("d", "z", 1), (None, "y", 1)], "chunk_id string, content string, tokens int")
    assert sorted((r.chunk_id or "", r.problem) for r in chunks.violations(df).collect()) == [("", "BLANK_ID"), ("b", "EMPTY"), ("c", "TOO_LONG"), ("d", "DUPLICATE_ID"), ("d", "DUPLICATE_ID")]
    assert chunks.schema_differences(df, {"chunk_id": "string", "tokens": "bigint", "v": "int"}) == ["tokens: int, not bigint", "v: missing"]


def test_search_queries_are_whole(spark):
    items = {r[0] for r in spark.read.parquet(str(SF / "benchmark.parquet")).select("item_id").collect()}
    vecs = {r[0] for r in spark.read.parquet(str(SF / "embeddings.parquet")).where("vec_id % 50 = 0").select("vec_id").collect()}
    found = {name: {r[0] for r in catalogue.QUERIES[name](spark, str(SF)).select(key).collect()} for name, key in (("bm25_topk", "query_id"), ("vector_topk", "query_id"), ("vector_self_search", "vec_id"))}
    assert found == {"bm25_topk": items, "vector_topk": vecs, "vector_self_search": vecs}


def test_preflight_is_whole(spark):
    """Every id of a node that two parts share is reported."""
    sizes = spark.read.parquet(str(SF / "part.parquet")).groupBy("p_size").count().where("count > 1").collect()
    found = catalogue.QUERIES["preflight_issues"](spark, str(SF)).where("code = 'DUPLICATE_NODE_ID'").collect()
    assert {r.id for r in found} == {f"n{r.p_size}" for r in sizes}
