"""Graph queries: nodes, relations and events with deterministic ids, checks, and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import ids
from quarrystone.operators import graph as G
from quarrystone.plans.registry import query
from quarrystone.sources import graph_sink as sink
from quarrystone.sources.shared import new_path
from quarrystone.sources.tables import table

FP = "substr(sha256(concat_ws(chr(31), {})), 1, 24)"


def fp(*parts: str) -> str:
    return FP.format(", ".join(parts))


@query(
    "fingerprint_ids",
    f"""SELECT o_orderkey, concat('event:', {fp("concat('person:', o_custkey)", "o_orderstatus", "'orders'", "o_orderkey")}) AS event_id,
    concat('relation:', {fp("concat('person:', o_custkey)", "'HAS_EVENT'", "''", "''", "'orders'", "o_orderkey")}) AS relation_id,
    concat('issue:', {fp("'UNKNOWN_ENUM'", "'orders'", "o_orderkey", "'status'", "trim(o_orderpriority)")}) AS issue_id FROM orders""",
)
def fingerprint_ids(spark: SparkSession, d: str) -> DataFrame:
    o, none = table(spark, d, "orders"), F.lit(None).cast("string")
    person, t, k = ids.person_id(F.col("o_custkey")), F.lit("orders"), F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        ids.event_id(person, F.col("o_orderstatus"), t, k).alias("event_id"),
        ids.relation_id(person, F.lit("HAS_EVENT"), none, none, t, k).alias("relation_id"),
        ids.issue_id(F.lit("UNKNOWN_ENUM"), t, k, F.lit("status"), F.col("o_orderpriority")).alias("issue_id"),
    )


@query(
    "uuid5_ids",
    f"""WITH c AS (SELECT doc_id, printf('D%06d_C0001', doc_id) AS chunk_id FROM documents), h AS (SELECT *, sha1(unhex('{ids.POINTS.hex}') || encode(chunk_id)) AS h FROM c)
    SELECT doc_id, chunk_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substr('89ab', CAST(('0x' || h[17]) AS INTEGER) % 4 + 1, 1) || h[18:20], h[21:32]) AS point_id FROM h""",
)
def uuid5_ids(spark: SparkSession, d: str) -> DataFrame:
    """Point ids of chunks: UUIDs of version 5."""
    chunk = F.format_string("D%06d_C0001", F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", chunk.alias("chunk_id"), ids.point_id(chunk).alias("point_id"))


def people(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(ids.person_id(F.col("c_custkey")).alias("node_id"), F.lit("Person").alias("node_type"), F.col("c_name").alias("name"))


@query(
    "graph_nodes",
    f"""SELECT concat('person:', c_custkey) AS node_id, 'Person' AS node_type, c_name AS name FROM customer
    UNION ALL SELECT concat('enterprise:', s_suppkey), 'Enterprise', s_name FROM supplier
    UNION ALL SELECT DISTINCT concat('market-segment:', {fp("lower(c_mktsegment)")}), 'MarketSegment', c_mktsegment FROM customer""",
)
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(ids.enterprise_id(F.col("s_suppkey")).alias("node_id"), F.lit("Enterprise").alias("node_type"), F.col("s_name").alias("name"))
    m = table(spark, d, "customer").select("c_mktsegment").distinct()
    m = m.select(ids.segment_id(F.col("c_mktsegment")).alias("node_id"), F.lit("MarketSegment").alias("node_type"), F.col("c_mktsegment").alias("name"))
    return people(spark, d).unionByName(s).unionByName(m)


def relations(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    c = table(spark, d, "customer").select(ids.person_id(F.col("c_custkey")).alias("start_node_id"), ids.segment_id(F.col("c_mktsegment")).alias("end_node_id"), F.lit("MEMBER_OF").alias("relation_type"), F.lit("customer").alias("t"), F.col("c_custkey").alias("k"))
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    li = table(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_suppkey").distinct()
    w = li.join(o, "l_orderkey").groupBy("o_custkey", "l_suppkey").agg(F.min("l_orderkey").alias("k"))
    w = w.select(ids.person_id(F.col("o_custkey")).alias("start_node_id"), ids.enterprise_id(F.col("l_suppkey")).alias("end_node_id"), F.lit("RELATED_TO").alias("relation_type"), F.lit("lineitem").alias("t"), "k")
    rows = c.unionByName(w)
    made = ids.relation_id(F.col("start_node_id"), F.col("relation_type"), F.col("end_node_id"), none, F.col("t"), F.col("k"))
    return rows.select(made.alias("relation_id"), "start_node_id", "end_node_id", "relation_type")


@query(
    "graph_edges",
    f"""WITH r AS (SELECT concat('person:', c_custkey) AS s, concat('market-segment:', {fp("lower(c_mktsegment)")}) AS e, 'MEMBER_OF' AS t, 'customer' AS src, c_custkey AS k FROM customer
    UNION ALL SELECT concat('person:', o_custkey), concat('enterprise:', l_suppkey), 'RELATED_TO', 'lineitem', min(l_orderkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey
      WHERE l_quantity > 45 AND o_orderstatus = 'F' GROUP BY o_custkey, l_suppkey)
    SELECT concat('relation:', {fp("s", "t", "e", "''", "src", "k")}) AS relation_id, s AS start_node_id, e AS end_node_id, t AS relation_type FROM r""",
)
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return relations(spark, d)


@query(
    "graph_events",
    f"""SELECT concat('event:', {fp("concat('person:', user_id)", "upper(event_type)", "'events'", "event_id")}) AS event_id, concat('person:', user_id) AS subject_node_id,
    CASE event_type WHEN 'purchase' THEN 'INVESTMENT' WHEN 'error' THEN 'REGULATORY' ELSE NULL END AS event_type,
    CASE WHEN event_type IN ('purchase', 'error') THEN NULL ELSE 'UNKNOWN_ENUM' END AS issue FROM events""",
)
def graph_events(spark: SparkSession, d: str) -> DataFrame:
    """Unknown types become issues, never data."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "INVESTMENT").when(F.col("event_type") == "error", "REGULATORY")
    person = ids.person_id(F.col("user_id"))
    return e.select(ids.event_id(person, F.upper("event_type"), F.lit("events"), F.col("event_id")).alias("event_id"), person.alias("subject_node_id"), kind.alias("event_type"), F.when(kind.isNull(), "UNKNOWN_ENUM").alias("issue"))


@query(
    "dangling_edges",
    """WITH e AS (SELECT o_orderkey AS relation_id, concat('person:', o_custkey) AS a, concat('enterprise:', o_orderkey % 200) AS b FROM orders),
    n AS (SELECT concat('person:', c_custkey) AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT concat('enterprise:', s_suppkey) FROM supplier)
    SELECT relation_id, a AS missing FROM e WHERE a NOT IN (SELECT id FROM n) UNION SELECT relation_id, b FROM e WHERE b NOT IN (SELECT id FROM n)""",
)
def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    r = o.select(F.col("o_orderkey").alias("relation_id"), ids.person_id(F.col("o_custkey")).alias("start_node_id"), ids.enterprise_id(F.col("o_orderkey") % 200).alias("end_node_id"))
    n = table(spark, d, "customer").where("c_acctbal > 0").select(ids.person_id(F.col("c_custkey")).alias("node_id")).unionByName(table(spark, d, "supplier").select(ids.enterprise_id(F.col("s_suppkey")).alias("node_id")))
    return G.dangling(r, n)


@query(
    "preflight_issues",
    """WITH n AS (SELECT concat('n', p_size) AS id, CASE WHEN p_size > 48 THEN 'Alien' ELSE 'Person' END AS t FROM part),
    r AS (SELECT concat('r', l_orderkey % 50) AS id, concat('n', l_linenumber) AS a, concat('n', l_suppkey % 60) AS b, CASE WHEN l_tax > 0.07 THEN 'HATES' ELSE 'WORKS_AT' END AS t FROM lineitem),
    e AS (SELECT concat('n', event_id % 900) AS id, concat('n', user_id % 70) AS s FROM events),
    x AS (SELECT id FROM n UNION SELECT id FROM e)
    SELECT DISTINCT * FROM (
    SELECT 'DUPLICATE_NODE_ID' AS code, 'ERROR' AS severity, id FROM n GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'DUPLICATE_EVENT_ID', 'ERROR', id FROM e GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'DUPLICATE_RELATION_ID', 'ERROR', id FROM r GROUP BY id HAVING count(*) > 1 AND count(DISTINCT (a, b, t)) > 1
    UNION ALL SELECT 'DUPLICATE_RELATION_CANDIDATE', 'WARNING', id FROM r GROUP BY id HAVING count(*) > 1 AND count(DISTINCT (a, b, t)) = 1
    UNION ALL SELECT 'INVALID_NODE_TYPE', 'ERROR', id FROM n WHERE t = 'Alien'
    UNION ALL SELECT 'INVALID_RELATION_TYPE', 'ERROR', id FROM r WHERE t = 'HATES'
    UNION ALL SELECT 'ENTITY_ID_CONFLICT', 'ERROR', id FROM n WHERE id IN (SELECT id FROM e)
    UNION ALL SELECT 'EVENT_SUBJECT_NOT_FOUND', 'ERROR', id FROM e WHERE s NOT IN (SELECT id FROM n)
    UNION ALL SELECT 'DANGLING_RELATION', 'ERROR', id FROM r WHERE a NOT IN (SELECT id FROM x) OR b NOT IN (SELECT id FROM x))""",
)
def preflight_issues(spark: SparkSession, d: str) -> DataFrame:
    def name(c: Column) -> Column:
        return F.concat(F.lit("n"), c.cast("string"))

    n = table(spark, d, "part").select(name(F.col("p_size")).alias("node_id"), F.when(F.col("p_size") > 48, "Alien").otherwise("Person").alias("node_type"))
    r = table(spark, d, "lineitem").select(F.concat(F.lit("r"), (F.col("l_orderkey") % 50).cast("string")).alias("relation_id"), name(F.col("l_linenumber")).alias("start_node_id"), name(F.col("l_suppkey") % 60).alias("end_node_id"), F.when(F.col("l_tax") > 0.07, "HATES").otherwise("WORKS_AT").alias("relation_type"))
    e = table(spark, d, "events").select(name(F.col("event_id") % 900).alias("event_id"), name(F.col("user_id") % 70).alias("subject_node_id"))
    return G.preflight(n, r, e)


def supply(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges between nations by orders across them, and the regions' first nations as roots."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src"))
    o = table(spark, d, "orders").where("o_totalprice > 440000").select("o_custkey", (F.col("o_orderkey") % 25).cast("int").alias("dst"))
    edges = o.join(c, "o_custkey").select("src", "dst").distinct()
    return edges, table(spark, d, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("root")).select("root")


SUPPLY = """e AS (SELECT DISTINCT c_nationkey AS src, CAST(o_orderkey % 25 AS INTEGER) AS dst FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 440000),
    b AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), roots AS (SELECT min(n_nationkey) AS root FROM nation GROUP BY n_regionkey)"""


def reach(depth: int) -> str:
    return f"""WITH RECURSIVE {SUPPLY}, w(root, node, distance) AS (SELECT root, root, 0 FROM roots
      UNION SELECT w.root, b.dst, w.distance + 1 FROM w JOIN b ON b.src = w.node WHERE w.distance < {depth})
    SELECT root, node, CAST(min(distance) AS INTEGER) AS distance FROM w GROUP BY root, node"""


@query("neighbors_2hop", reach(2))
def neighbors_2hop(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbourhood(*supply(spark, d), 2)


@query("reachable_3hop", reach(3))
def reachable_3hop(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbourhood(*supply(spark, d), 3)


@query(
    "edge_min_distance",
    f"""WITH RECURSIVE {SUPPLY}, w(root, node, distance) AS (SELECT root, root, 0 FROM roots
      UNION SELECT w.root, b.dst, w.distance + 1 FROM w JOIN b ON b.src = w.node WHERE w.distance < 1),
    m AS (SELECT root, node, min(distance) AS distance FROM w GROUP BY 1, 2)
    SELECT root, src, dst, CAST(min(distance) + 1 AS INTEGER) AS distance FROM e JOIN m ON node = src OR node = dst GROUP BY 1, 2, 3""",
)
def edge_min_distance(spark: SparkSession, d: str) -> DataFrame:
    return G.edge_distances(*supply(spark, d), 2)


@query(
    "verification_status",
    """SELECT o_orderkey, CASE WHEN upper(o_orderstatus) = 'F' AND c_acctbal IS NOT NULL AND o_orderpriority NOT LIKE '%URGENT%' THEN 'CONFIRMED' ELSE 'PENDING' END AS status
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""",
)
def verification_status(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    o = table(spark, d, "orders").join(c, "o_custkey", "left")
    status = F.when(F.col("o_orderstatus") == "F", "verified").otherwise("open")
    evidence = F.when(F.col("o_orderpriority").contains("URGENT"), "据传").otherwise("公告")
    return o.select("o_orderkey", G.verification(status, F.col("known").isNotNull(), evidence).alias("status"))


@query(
    "graph_store",
    """SELECT concat('person:', c_custkey) AS id, 'Person' AS label, CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, '*') ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'VIP' END AS rank, NULL AS start_id FROM customer WHERE c_custkey % 50 <> 7
    UNION ALL SELECT concat('order:', o_orderkey), 'PLACED', NULL, NULL, concat('person:', o_custkey) FROM orders WHERE o_orderkey % 40 <> 9""",
)
def graph_store(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and relations through the sink: a run, its rerun, and a run that changes every third node; rows without a label or endpoint are lost alone."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    none = F.lit(None).cast("string")
    nodes = c.select(F.concat(F.lit("person:"), "c_custkey").alias("id"), F.when(F.col("c_custkey") % 50 != 7, "Person").otherwise("no label").alias("label"), none.alias("start_id"), none.alias("end_id"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("rank"), none).alias("properties"))
    edges = o.select(F.concat(F.lit("order:"), "o_orderkey").alias("id"), F.lit("PLACED").alias("label"), F.concat(F.lit("person:"), "o_custkey").alias("start_id"), F.when(F.col("o_orderkey") % 40 != 9, "shop:1").alias("end_id"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("properties"))
    changed = nodes.where("id rlike '[0-9]$'").join(c.where("c_custkey % 3 = 0").select(F.concat(F.lit("person:"), "c_custkey").alias("id")), "id", "left_semi")
    changed = changed.withColumn("properties", F.create_map(F.lit("name"), F.concat(F.col("properties")["name"], F.lit("*")), F.lit("rank"), F.lit("VIP")))
    path = new_path(spark, "graph")
    first = nodes.unionByName(edges)
    for run, rows in (("first", first), ("second", changed), ("first", first)):
        sink.write(rows, path, run)
    return sink.graph(spark, path).select("id", "label", F.col("properties")["name"].alias("name"), F.col("properties")["rank"].alias("rank"), "start_id")
