"""A build of a graph that can be stopped anywhere and taken up again.

A build has a folder. Each attempt in it is a row of stages, every one a table that counts once Spark's mark of a finished write
stands beside it: `taken` (the records of this attempt), `elements` and `issues` (what they become), then the sink's run
of the attempt's name (elements of persons without errors), and last `states`, which ends the attempt. Whoever calls `run` after a stop
goes on at the first stage without a mark, on the records that the attempt took, so the result is that of an unbroken run. A finished
attempt is followed by one over the records that are new or have failed fewer than `attempts_each` times; finished persons are left alone.

Owners (persons) are judged alone: an error among an owner's rows keeps all of that owner's elements out and nobody else's. Errors are
given issues of severity ERROR, relations of which an end is no node of the same owner (DANGLING_RELATION), ids that stand for two
things, in this attempt or against what is stored (CONFLICTING_ID), and rows that the sink refuses.

Edge cases. Records with a null owner are in no attempt. Repeated records are taken as they are; equal elements, of one owner or of
several, are stored once. An owner without elements succeeds with none. Without records, or with none left to do, no attempt is
made. Columns of records are free but for `owner`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import ids
from quarrystone.operators import graph_build as B
from quarrystone.operators import workflow
from quarrystone.sources import graph_sink as sink
from quarrystone.sources import shared

ISSUES = "owner string, issue_id string, reason string, severity string"
STATES = "owner string, state string, nodes long, relations long, reasons array<string>, attempt int"
ELEMENT = ("id", "label", "start_id", "end_id", "properties")


class Made(NamedTuple):
    """What records become: elements (owner and the sink's columns) and issues (owner, issue_id, reason, severity)."""

    elements: DataFrame
    issues: DataFrame


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The stage's table as it was finished, else made now in place of what a stop has left."""
    if "_SUCCESS" not in shared.names(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def attempts(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("attempt_")) for n in shared.names(spark, path) if n.startswith("attempt_"))


def _finished(spark: SparkSession, path: str) -> list[int]:
    return [n for n in attempts(spark, path) if "_SUCCESS" in shared.names(spark, f"{path}/attempt_{n}/states")]


def _tables(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A stage's tables of all finished attempts."""
    parts = [spark.read.parquet(f"{path}/attempt_{n}/{name}").withColumn("attempt", F.lit(n)) for n in _finished(spark, path)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def states(spark: SparkSession, path: str) -> DataFrame:
    """owner, state, nodes, relations, reasons, attempt: each owner's last."""
    rows = _tables(spark, path, "states", STATES)
    return rows.groupBy("owner").agg(F.max_by(F.struct("state", "nodes", "relations", "reasons", "attempt"), "attempt").alias("x")).select("owner", "x.*")


def issues(spark: SparkSession, path: str) -> DataFrame:
    """owner, issue_id, reason, severity, attempt of each owner's last attempt: what a later attempt has mended is gone."""
    last = states(spark, path).select("owner", "attempt")
    return _tables(spark, path, "issues", f"{ISSUES}, attempt int").join(last, ["owner", "attempt"], "left_semi").select("owner", "issue_id", "reason", "severity", "attempt")


def summary(spark: SparkSession, path: str, batch: str) -> DataFrame:
    """The batch's counts and status."""
    return workflow.rolled_up(states(spark, path).select(F.lit(batch).alias("batch_id"), F.col("state").alias("status")))


def graph(spark: SparkSession, path: str) -> DataFrame:
    """The stored graph."""
    return sink.graph(spark, f"{path}/graph")


def _found(rows: DataFrame, reason: str) -> DataFrame:
    """An ERROR issue of owners and ids."""
    made = ids.issue_id(F.lit(reason), F.lit("element"), F.col("owner"), F.coalesce("id", F.lit("")), F.lit(reason))
    return rows.select("owner", made.alias("issue_id"), F.lit(reason).alias("reason"), F.lit("ERROR").alias("severity"))


def _refusals(elements: DataFrame, stored: DataFrame) -> DataFrame:
    """Issues of elements: ends without a node of the owner, and ids that stand for unlike things."""
    nodes = elements.where("start_id is null and end_id is null").select("owner", F.col("id").alias("end"))
    ends = elements.where("start_id is not null or end_id is not null").select("owner", "id", F.explode(F.array("start_id", "end_id")).alias("end"))
    dangling = ends.join(nodes, ["owner", "end"], "left_anti")
    body = ("id", "label", "start_id", "end_id")
    unlike = elements.select(*body).unionByName(stored.select(*body)).distinct().groupBy("id").count().where("count > 1").select("id")  # no sort of all
    return _found(dangling, "DANGLING_RELATION").unionByName(_found(elements.join(unlike, "id", "left_semi"), "CONFLICTING_ID")).distinct()


def _once(elements: DataFrame) -> DataFrame:
    """Equal elements once, however many owners share them."""
    flat = elements.select("id", "label", "start_id", "end_id", F.array_sort(F.map_entries("properties")).alias("entries")).distinct()
    return flat.select("id", "label", "start_id", "end_id", F.map_from_entries("entries").alias("properties"))


def run(records: DataFrame, make: Callable[[DataFrame], Made], path: str, attempts_each: int = 3) -> DataFrame:
    """Goes on with the build in `path`, or starts it, and returns its states. `make` turns records into elements and issues."""
    spark = records.sparkSession
    known, done = attempts(spark, path), _finished(spark, path)
    if known and known[-1] not in done:
        n = known[-1]
        open_records = records  # the attempt's own stage `taken` counts where it is finished
    else:
        n = len(known) + 1
        open_records = None
    if open_records is None or "_SUCCESS" not in shared.names(spark, f"{path}/attempt_{n}/taken"):
        tried = _tables(spark, path, "states", STATES).groupBy("owner").agg(F.max_by("state", "attempt").alias("state"), F.count("*").alias("tries"))
        over = tried.where((F.col("state") == "SUCCESS") | (F.col("tries") >= attempts_each)).select("owner")
        open_records = records.where("owner is not null").join(over, "owner", "left_anti")
        if n not in known and open_records.isEmpty():
            return states(spark, path)
    at = f"{path}/attempt_{n}"
    taken = stage(spark, f"{at}/taken", lambda: open_records)
    made = make(taken)
    elements = stage(spark, f"{at}/elements", lambda: made.elements.select("owner", *ELEMENT))
    stored = sink.elements(spark, f"{path}/graph")
    found = stage(spark, f"{at}/issues", lambda: made.issues.select("owner", "issue_id", "reason", "severity").unionByName(_refusals(elements, stored)))
    wrong = found.where("severity = 'ERROR'")
    accepted = elements.join(wrong.select("owner"), "owner", "left_anti")
    if f"attempt_{n}" not in [m["run"] for m in sink.manifests(f"{path}/graph")]:
        sink.write(_once(accepted), f"{path}/graph", f"attempt_{n}")
    stage(spark, f"{at}/states", lambda: _states(taken, accepted, wrong, sink.failed(spark, f"{path}/graph").where(F.col("run") == f"attempt_{n}")))
    return states(spark, path)


def _states(taken: DataFrame, accepted: DataFrame, wrong: DataFrame, lost: DataFrame) -> DataFrame:
    """owner, state, nodes, relations, reasons of one attempt."""
    refused = accepted.alias("e").join(lost.alias("l"), F.col("e.id").eqNullSafe(F.col("l.id")) & F.col("e.label").eqNullSafe(F.col("l.label"))).select("e.owner", F.col("l.reason"))
    reasons = wrong.select("owner", "reason").unionByName(refused).groupBy("owner").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    node = F.col("start_id").isNull()
    counts = accepted.select("owner", "id", node.alias("node")).distinct().groupBy("owner").agg(F.count_if("node").alias("nodes"), F.count_if(~F.col("node")).alias("relations"))
    rows = taken.select("owner").distinct().join(reasons, "owner", "left").join(counts, "owner", "left")
    state = F.when(F.col("reasons").isNull(), "SUCCESS").otherwise("FAILED")
    return rows.select("owner", state.alias("state"), F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("relations", F.lit(0)).alias("relations"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def persons_with_enterprises(taken: DataFrame, sources: DataFrame) -> Made:
    """Persons, the enterprises of their links, and the relations between them.

    taken: owner (the person's node id), person_id, full_name, person_type, marital_status, birth_date, source_id, verification_status,
    links (array of relation_id, enterprise_id, enterprise_name, relation_type, raw_text, source_id, verification_status).
    A person without a name is an error; enterprises without a name become no nodes.
    """
    profile = taken.select("person_id", "marital_status", "birth_date", "source_id", "verification_status")
    nodes, doubts = B.person_nodes(taken.select("person_id", "full_name", "person_type").dropDuplicates(["person_id"]), profile, sources)
    links = taken.select("owner", "person_id", F.explode("links").alias("l")).select("owner", "person_id", F.col("l.relation_id").alias("person_enterprise_relation_id"), "l.enterprise_id", "l.enterprise_name", "l.relation_type", "l.raw_text", "l.source_id", "l.verification_status")
    related, unsure = B.enterprise_relations(links, sources, keep=["owner"])  # with their owners, who need not be looked up
    none = F.lit(None).cast("string")

    def row(owner, name, *ends):
        return [owner.alias("owner"), *[c.alias(n) for c, n in zip((*name, *ends), ELEMENT[:4], strict=True)]]

    extra = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("status"), F.col("status")), lambda _, v: v.isNotNull())
    people = nodes.select(*row(F.col("node_id"), (F.col("node_id"), F.col("node_type")), none, none), F.map_concat(extra, "properties").alias("properties"))
    named = links.where("trim(enterprise_name) <> ''").select("owner", "enterprise_id", "enterprise_name").distinct()
    firms = named.select(*row(F.col("owner"), (ids.enterprise_id(F.col("enterprise_id")), F.lit("Enterprise")), none, none), F.create_map(F.lit("name"), F.col("enterprise_name")).alias("properties"))
    status = F.map_concat(F.create_map(F.lit("status"), F.col("status")), "properties")
    bonds = related.select(*row(F.col("start_node_id"), (F.col("relation_id"), F.col("relation_type")), F.col("start_node_id"), F.col("end_node_id")), status.alias("properties"))
    blank = B.issue(taken.where("coalesce(trim(full_name), '') = ''"), "MISSING_NAME", "ERROR", "person", "person_id", "full_name", "no name")
    of_person = blank.unionByName(doubts).withColumn("owner", ids.person_id(F.col("source_pk")))
    found = [df.select("owner", "issue_id", "reason", "severity") for df in (of_person, unsure)]
    return Made(people.unionByName(firms).unionByName(bonds), found[0].unionByName(found[1]).distinct())
