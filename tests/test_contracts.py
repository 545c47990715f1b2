"""Views of graphs, contracts of results, locks and gates."""

import json

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import contracts as C
from quarrystone.operators import graph_view as V


def test_G22_view(spark):
    nodes = spark.createDataFrame([("a", "Person", {"name": " ", "description": "d", "secret": "x"}, 1), ("a", "Person", {"name": "late"}, 2), ("b", "Alien", {"name": "b"}, 3), ("c", "Person", {}, 4)], "node_id string, node_type string, properties map<string,string>, position int")
    edges = spark.createDataFrame([(None, "a", "b", "WORKS_AT", 1), ("e", "a", "b", "HATES", 2), (None, "a", "b", "WORKS_AT", 3), ("x", "a", "zz", "WORKS_AT", 4)], "edge_id string, source string, target string, relation_type string, position int")
    got, lines = V.view(nodes, edges, {"Person": ["description", "name"]}, ["WORKS_AT"], 2)
    assert {(r.node_id, r.label, r.truncated, tuple(sorted(r.properties))) for r in got.collect()} == {("a", "d", True, ("description", "name")), ("b", "b", True, ())}
    assert [tuple(r) for r in lines.collect()] == [("a|WORKS_AT|b", "a", "b", "WORKS_AT")]


def test_G24_scope(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    asked = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "zz"), ("a", "a")], "root string, node_id string")
    assert {r.node_id: r.verdict for r in V.scope_guard(asked, nodes, edges, 1).collect()} == {"b": "OK", "c": "FORBIDDEN", "zz": "NOT_FOUND", "a": "OK"}


def test_F10_F14_properties(spark):
    df = spark.createDataFrame([({"a": "1"}, {"a": "2", "b": "3"}, float("nan"), {"z": 1, "y": 2})], "own map<string,string>, nested map<string,string>, n double, m map<string,int>")
    r = df.select(V.flattened(F.col("own"), F.col("nested")).alias("f"), V.storable(F.col("n"), "double").alias("n"), V.storable(F.col("m"), "map<string,int>").alias("m")).first()
    assert r.f == {"a": "1", "b": "3"} and r.n.error == "NOT_FINITE" and r.m.value == '{"y":2,"z":1}'
    rows = spark.createDataFrame([(1, "x", None, "n/a")], "id int, name string, note string, memo string")
    rules = [("IGNORE", ["other"], []), ("LLM", ["t"], ["memo"]), ("RULE", [], ["name"])]
    assert [(r.field, r.treatment) for r in V.field_scan(rows, "t", "id", rules).collect()] == [("name", "RULE")]


@pytest.mark.parametrize(("sql", "want"), [("SELECT 1", True), (" explain select a from t where b = ';delete'", True), ("select 1; drop table t", False), ("select /* x */ 1", False), ("update t set a = 1", False), ("select * into outfile 'x' from t", False), ("with x as (select 1) delete from t", False)])
def test_S14_gate(sql, want):
    assert C.is_read_only(sql) is want


def test_P22_contract(spark):
    good = {"level": "HIGH", "items": ["a"], "refs": ["SRC-1"]}
    rows = [good, good | {"level": "ODD"}, good | {"items": list("abcd")}, good | {"refs": ["SRC-9"]}, good | {"more": 1}, {"level": "LOW", "refs": []}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(9, "[1"), (10, "[1]")], "id int, body string").withColumn("allowed", F.array(F.lit("SRC-1")))
    got = {(r.id, r.field, r.problem) for r in C.violations(df, "id", "body", ["level", "items"], {"level": ["LOW", "HIGH"]}, {"items": 3}, "refs", F.col("allowed")).collect()}
    assert got == {(1, "level", "ENUM"), (2, "items", "TOO_MANY"), (3, "refs", "EVIDENCE"), (4, "", "UNKNOWN_FIELD"), (5, "items", "MISSING"), (9, "", "NOT_AN_OBJECT"), (10, "", "NOT_AN_OBJECT")}


def test_I10_lock(spark):
    now = spark.createDataFrame([(1, "a", 3), (2, "b", 1)], "id int, state string, version int")
    updates = spark.createDataFrame([(1, "x", 3, 1), (1, "y", 3, 2), (2, "z", 0, 3)], "id int, state string, expected int, position int")
    after, late = C.compare_and_set(now, updates, "id", "state")
    assert sorted(map(tuple, after.collect())) == [(1, "x", 4), (2, "b", 1)] and sorted(r.position for r in late.collect()) == [2, 3]


def test_A15_P04(spark):
    schemas = spark.createDataFrame([("t", "person_id", "long"), ("u", "person_id", "long"), ("v", "person_id", "int"), ("u", "name", "string")], "table_name string, column_name string, data_type string")
    assert [tuple(r) for r in C.shared_columns(schemas).collect()] == [("t", "u", "person_id")]
    df = spark.createDataFrame([("abc@d.ef", "13812345678", "x" * 600)], "email string, phone string, note string")
    assert tuple(df.select(C.masked_sample(F.col("email"), "email"), C.masked_sample(F.col("phone"), "phone"), F.length(C.masked_sample(F.col("note"), "note"))).first()) == ("a***@d.ef", "138****78", 500)
