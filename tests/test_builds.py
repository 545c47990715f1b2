"""Inclusions between columns against brute force; builds that stop and go on."""

import itertools
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import build
from quarrystone.operators.inclusions import comparable, inclusions
from quarrystone.sources import graph_sink as sink

FIELDS = ("dependent", "referenced", "shared", "distinct_values", "referenced_is_key")


def brute(tables, least=1.0):
    """Every pair of columns of one kind, by sets."""
    columns = [(f"{t}.{c}", kind, [r[c] for r in df.collect() if r[c] is not None]) for t, df in tables.items() for name, c, kind in comparable({t: df})]
    out = set()
    for (a, ka, va), (b, kb, vb) in itertools.permutations(columns, 2):
        shared = len(set(va) & set(vb))
        if ka == kb and va and shared and shared >= least * len(set(va)):
            out.add((a, b, shared, len(set(va)), len(vb) == len(set(vb))))
    return out


def rows(df):
    return {tuple(r[f] for f in FIELDS) for r in df.collect()}


def test_inclusions_equal_brute_force(spark):
    """Over 62 columns, so sets take two words; nulls, hot values, long texts, empty columns, unlike widths, names with dots."""
    rng = random.Random(3)
    wide = spark.createDataFrame([tuple(rng.randint(0, 2 + i % 7) for i in range(70)) for _ in range(40)], ", ".join(f"w{i} int" for i in range(70)))
    small = spark.createDataFrame([(i, "x" * 70 + str(i % 3), None, date(2020, 1, 1 + i % 9), f"{i}") for i in range(20)], "k long, t string, nothing long, d date, `a.b` string")
    other = spark.createDataFrame([(i % 5, "x" * 70 + str(i % 2), 1.5, date(2020, 1, 1 + i % 4), "7") for i in range(400)], "k short, t string, f double, d date, s string")
    tables = {"wide": wide, "small": small, "other": other, "none": spark.createDataFrame([], "k long, t string")}
    assert rows(inclusions(tables)) == brute(tables)
    assert rows(inclusions(tables, 0.5)) == brute(tables, 0.5)
    assert ("other.k", "small.k", 5, 5, True) in rows(inclusions(tables))
    assert rows(inclusions({"f": other.select("f")})) == set()


def test_inclusions_of_repeated_rows(spark):
    """A value that fills a table is folded before the shuffle and changes nothing."""
    hot = spark.range(50_000).select(F.lit(7).cast("int").alias("k"))
    tables = {"hot": hot, "keys": spark.range(10).select("id")}
    assert rows(inclusions(tables)) == {("hot.k", "keys.id", 1, 1, True)}
    plan = inclusions(tables)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# builds

RECORD = "owner string, name string, firm string, kind string, end string"


def people(spark, mended=False):
    """Owners with a name, without one, with a relation to nowhere, with an id that stands for two things, and with a bad label."""
    good = [(f"p{i}", f"n{i}", f"f{i % 3}", "KNOWS", f"f{i % 3}") for i in range(12)]
    bad = [("q1", "n" if mended else "", "f0", "KNOWS", "f0"), ("q2", "n", "f0", "KNOWS", "f0" if mended else "nowhere"), ("q3", "n", "p1", "KNOWS", "p1"), ("q4", "n", "f1", "NO LABEL", "f1"), (None, "n", "f1", "KNOWS", "f1")]
    return spark.createDataFrame(good + bad, RECORD)


def make(taken):
    none = F.lit(None).cast("string")
    nodes = taken.select("owner", F.col("owner").alias("id"), F.lit("Person").alias("label"), none.alias("start_id"), none.alias("end_id"), F.create_map(F.lit("name"), "name").alias("properties"))
    firms = taken.select("owner", F.col("firm").alias("id"), F.lit("Firm").alias("label"), none.alias("start_id"), none.alias("end_id"), F.create_map().cast("map<string,string>").alias("properties"))
    bonds = taken.select("owner", F.concat(F.lit("r:"), "owner").alias("id"), F.col("kind").alias("label"), F.col("owner").alias("start_id"), F.col("end").alias("end_id"), F.create_map().cast("map<string,string>").alias("properties"))
    blank = taken.where("name = ''").select("owner", F.lit("i").alias("issue_id"), F.lit("MISSING_NAME").alias("reason"), F.lit("ERROR").alias("severity"))
    note = taken.where("owner = 'p3'").select("owner", F.lit("j").alias("issue_id"), F.lit("NOTE").alias("reason"), F.lit("WARNING").alias("severity"))
    return build.Made(nodes.unionByName(firms).unionByName(bonds), blank.unionByName(note))


def told(spark, path):
    found = {r.owner: (r.state, r.nodes, r.relations, tuple(r.reasons), r.attempt) for r in build.states(spark, path).collect()}
    graph = {(r.id, r.label, r.start_id, r.end_id, tuple(sorted(r.properties.items()))) for r in build.graph(spark, path).collect()}
    notes = {(r.owner, r.reason, r.severity, r.attempt) for r in build.issues(spark, path).collect()}
    return found, graph, notes


@pytest.fixture(scope="module")
def unbroken(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('build')}/b"
    build.run(people(spark), make, path)
    first = told(spark, path)
    build.run(people(spark, mended=True), make, path)
    return first, told(spark, path)


def test_failures_stay_alone(unbroken):
    """p1's id is a person's and, by q3, a firm's: both are refused; everybody else goes on."""
    (found, graph, notes), _ = unbroken
    assert None not in found and len(found) == 16
    assert {o for o, x in found.items() if x[0] == "SUCCESS"} == {f"p{i}" for i in range(12) if i != 1}
    assert found["p2"] == ("SUCCESS", 2, 1, (), 1)
    assert found["q1"] == ("FAILED", 0, 0, ("MISSING_NAME",), 1)
    assert found["q2"] == ("FAILED", 0, 0, ("DANGLING_RELATION",), 1)
    assert found["q3"][3] == found["p1"][3] == ("CONFLICTING_ID",)
    assert found["q4"][:2] == ("FAILED", 2) and found["q4"][3] == ("LABEL",)  # the sink's refusal: the row alone is lost
    ids = {g[0] for g in graph}
    assert {"p2", "r:p2", "f0", "f1", "f2", "q4"} <= ids and not ids & {"p1", "q1", "q2", "q3", "r:q4"}
    assert ("p3", "NOTE", "WARNING", 1) in notes


def test_second_attempt_takes_only_what_failed(unbroken):
    _, (found, graph, notes) = unbroken
    assert found["q1"] == ("SUCCESS", 2, 1, (), 2) and found["q2"][0] == "SUCCESS"
    assert found["p2"][4] == 1 and found["q3"] == ("FAILED", 0, 0, ("CONFLICTING_ID",), 2)
    assert "q1" in {g[0] for g in graph}
    assert not {n for n in notes if n[0] == "q1"}  # mended issues are gone


class Stop(RuntimeError):
    pass


@pytest.mark.parametrize("at", ["taken", "elements", "issues", "states", "sink"])
def test_stopped_build_equals_an_unbroken_one(spark, tmp_path, monkeypatch, unbroken, at):
    """Stopped before a stage's mark, with half-written files in place; records that changed meanwhile don't count for what was taken."""
    path = f"file://{tmp_path}/b"
    with monkeypatch.context() as m:
        if at == "sink":
            m.setattr(sink, "write", lambda *a, **k: (_ for _ in ()).throw(Stop()))
        else:
            whole = build.stage

            def broken(s, where, f):
                if where.endswith(at):
                    f().limit(1).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(where)
                    raise Stop
                return whole(s, where, f)

            m.setattr(build, "stage", broken)
        with pytest.raises(Stop):
            build.run(people(spark), make, path)
    assert build.states(spark, path).count() == 0
    build.run(people(spark) if at == "taken" else people(spark, mended=True), make, path)
    assert told(spark, path) == unbroken[0]


def test_attempts_end(spark, tmp_path):
    """Who has failed often enough is left alone, new owners are taken, nothing to do makes no attempt."""
    path = f"file://{tmp_path}/b"
    records = people(spark).where("owner in ('p2', 'q1')")
    for _ in range(4):
        build.run(records, make, path, attempts_each=2)
    assert build.attempts(spark, path) == [1, 2]
    assert build.summary(spark, path, "b").collect()[0].asDict() == {"batch_id": "b", "success": 1, "failed": 1, "pending": 0, "status": "PARTIAL_FAILED"}
    build.run(people(spark).where("owner in ('p2', 'q1', 'p5')"), make, path, attempts_each=2)
    assert {r.owner: r.attempt for r in build.states(spark, path).collect()} == {"p2": 1, "q1": 2, "p5": 3}


def test_empty_build(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    assert build.run(people(spark).where("false"), make, path).count() == 0
    assert build.attempts(spark, path) == [] and build.graph(spark, path).count() == 0 and build.issues(spark, path).count() == 0
