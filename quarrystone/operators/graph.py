"""Property graph: nodes, relations and events from rows, checks before they are stored, and bounded neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import ids
from quarrystone.functions.rules import CONFIRMED, STRICT_RELATIONS
from quarrystone.functions.strict import contains_speculation

#: What the graph may hold.
NODE_TYPES = ("Person", "Enterprise", "FamilyProfile", "FamilyMember", "Organization", "MarketSegment", "Event")
RELATION_TYPES = (
    "WORKS_AT", "CHAIRMAN_OF", "CEO_OF", "FOUNDED", "HOLDS_SHARE", "CONTROLS", "OWNS", "GUARANTEES", "SUPPLY_CHAIN", "COMPETES_WITH", "HAS_UPSTREAM", "HAS_DOWNSTREAM", "FAMILY_OF", "HAS_FAMILY_PROFILE", "MEMBER_OF", "WORKS_FOR",
    "CHARITY_COOPERATION", "ACADEMIC_COOPERATION", "PARTICIPATED_IN", "HAS_EVENT", "RELATED_TO",
)


def verification(status: Column, has_source: Column, evidence: Column) -> Column:
    """CONFIRMED only if the status says so, the source exists and the evidence doesn't speculate; else PENDING."""
    sure = F.upper(F.trim(status)).isin(*CONFIRMED) & has_source & ~contains_speculation(evidence)
    return F.when(F.coalesce(sure, F.lit(False)), "CONFIRMED").otherwise("PENDING")


def strict_relation(kind: Column, status: Column) -> Column:
    """The issue of relations that must be confirmed and are not."""
    return F.when(kind.isin(*STRICT_RELATIONS) & (status != "CONFIRMED"), "STRICT_RELATION_VERIFICATION")


def dangling(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations of which an end is no node: one row for each end that is missing."""
    known = nodes.select(F.col("node_id").alias("end")).distinct()
    ends = relations.select("relation_id", F.explode(F.array("start_node_id", "end_node_id")).alias("end"))
    return without(ends.distinct(), known, "end").select("relation_id", F.col("end").alias("missing"))


def without(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among known's keys (each once). An anti join would be moved to before an aggregation of rows, where all that repeat a key meet in one task."""
    return rows.join(known.select(key, F.lit(True).alias("_known")), key, "left").where("_known is null").drop("_known")


def first_kept(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each key by position."""
    w = Window.partitionBy(key).orderBy(position)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicate_issues(rows: DataFrame, key: str, table: str) -> DataFrame:
    """One DUPLICATE_ID issue for each key that occurs more than once."""
    again = rows.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")
    reason = F.lit("DUPLICATE_ID")
    made = ids.issue_id(reason, F.lit(table), F.col(key), F.lit(key), F.lit("duplicate id"))
    return again.select(made.alias("issue_id"), reason.alias("reason"), F.lit("ERROR").alias("severity"), F.col(key).alias("source_pk"), "copies")


def preflight(nodes: DataFrame, relations: DataFrame, events: DataFrame) -> DataFrame:
    """code, severity, id of everything that stands against storing a graph."""

    def rows(df: DataFrame, code: str, severity: str, key: str) -> DataFrame:
        return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(key).alias("id"))

    body = F.to_json(F.struct("start_node_id", "end_node_id", "relation_type"))
    again = relations.groupBy("relation_id").agg(F.count("*").alias("n"), F.countDistinct(body).alias("kinds")).where("n > 1")
    entity = nodes.select("node_id").unionByName(events.select(F.col("event_id").alias("node_id")))
    subjects = events.select("event_id", F.col("subject_node_id").alias("node_id")).distinct()
    both = nodes.select("node_id", F.lit(1).alias("kind")).unionByName(events.select(F.col("event_id").alias("node_id"), F.lit(2).alias("kind"))).groupBy("node_id").agg(F.min("kind").alias("least"), F.max("kind").alias("most"))
    found = [
        rows(nodes.groupBy("node_id").count().where("count > 1"), "DUPLICATE_NODE_ID", "ERROR", "node_id"),
        rows(events.groupBy("event_id").count().where("count > 1"), "DUPLICATE_EVENT_ID", "ERROR", "event_id"),
        rows(again.where("kinds > 1"), "DUPLICATE_RELATION_ID", "ERROR", "relation_id"),
        rows(again.where("kinds = 1"), "DUPLICATE_RELATION_CANDIDATE", "WARNING", "relation_id"),
        rows(nodes.where(~F.col("node_type").isin(*NODE_TYPES)), "INVALID_NODE_TYPE", "ERROR", "node_id"),
        rows(relations.where(~F.col("relation_type").isin(*RELATION_TYPES)), "INVALID_RELATION_TYPE", "ERROR", "relation_id"),
        rows(both.where("least < most"), "ENTITY_ID_CONFLICT", "ERROR", "node_id"),
        rows(without(subjects, nodes.select("node_id").distinct(), "node_id"), "EVENT_SUBJECT_NOT_FOUND", "ERROR", "event_id"),
        rows(dangling(relations, entity), "DANGLING_RELATION", "ERROR", "relation_id"),
    ]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst in either direction, once each."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """root, node, distance: all nodes within 1 to 3 undirected steps, at their least distance. One join a step; only nodes not yet reached go on."""
    around = both_ways(edges)
    reached = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("distance"))
    front = reached
    for d in range(1, min(3, max(1, depth)) + 1):
        step = front.join(around, front.node == around.src).select("root", F.col("dst").alias("node")).distinct()
        front = step.join(reached.select("root", "node"), ["root", "node"], "left_anti").withColumn("distance", F.lit(d))
        reached = reached.unionByName(front)
    return reached


def edge_distances(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """root, src, dst, distance of the edges on paths of at most depth steps: one more than the nearer end's."""
    near = neighbourhood(edges, roots, depth - 1) if depth > 1 else roots.select("root", F.col("root").alias("node"), F.lit(0).alias("distance"))
    ends = edges.select("src", "dst", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    return ends.join(near, "node").groupBy("root", "src", "dst").agg((F.min("distance") + 1).alias("distance"))
