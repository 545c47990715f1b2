"""Relations between columns of all tables, and a graph build over several attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import ids
from quarrystone.operators import build
from quarrystone.operators.inclusions import inclusions
from quarrystone.plans.registry import query
from quarrystone.sources import graph_sink as sink
from quarrystone.sources.shared import new_path
from quarrystone.sources.tables import table

#: Columns of the tables that can be compared, by kind.
COLUMNS = {
    "whole": "region.r_regionkey nation.n_nationkey nation.n_regionkey customer.c_custkey customer.c_nationkey supplier.s_suppkey supplier.s_nationkey part.p_partkey part.p_size orders.o_orderkey orders.o_custkey lineitem.l_orderkey lineitem.l_partkey lineitem.l_suppkey lineitem.l_linenumber events.event_id events.user_id documents.doc_id documents.n_chars embeddings.vec_id embeddings.label pages.page_id benchmark.item_id labels.doc_id labels.quality labels.toxic conversations.conv_id conversations.turn",
    "text": "region.r_name nation.n_name customer.c_name customer.c_mktsegment supplier.s_name part.p_name part.p_brand part.p_type orders.o_orderstatus orders.o_orderpriority lineitem.l_returnflag lineitem.l_linestatus events.event_type events.props documents.text documents.lang documents.source pages.url pages.html benchmark.text conversations.role conversations.text",
}
TABLES = tuple(dict.fromkeys(c.split(".")[0] for names in COLUMNS.values() for c in names.split()))


def _inclusion_sql() -> str:
    each = [(kind, name, *name.split(".")) for kind, names in COLUMNS.items() for name in names.split()]
    values = " UNION ALL ".join(f"SELECT '{name}' AS c, '{kind}' AS kind, CAST({column} AS VARCHAR) AS value, count(*) AS n FROM {t} WHERE {column} IS NOT NULL GROUP BY 3" for kind, name, t, column in each)
    return f"""WITH v AS ({values}), s AS (SELECT c, count(*) AS d, max(n) AS most FROM v GROUP BY 1)
    SELECT x.dependent, x.referenced, x.shared, a.d AS distinct_values, b.most = 1 AS referenced_is_key
    FROM (SELECT a.c AS dependent, b.c AS referenced, count(*) AS shared FROM v a JOIN v b ON a.kind = b.kind AND a.value = b.value AND a.c <> b.c GROUP BY 1, 2) x
    JOIN s a ON a.c = x.dependent JOIN s b ON b.c = x.referenced WHERE x.shared = a.d"""


@query("column_inclusions", _inclusion_sql())
def column_inclusions(spark: SparkSession, d: str) -> DataFrame:
    """All exact inclusions between columns of whole numbers and texts of all tables."""
    chosen = {t: [c.split(".")[1] for names in COLUMNS.values() for c in names.split() if c.startswith(f"{t}.")] for t in TABLES}
    return inclusions({t: table(spark, d, t).select(*chosen[t]) for t in TABLES})


def person_records(spark: SparkSession, d: str, least: float) -> DataFrame:
    """Customers as persons, their orders as links to enterprises; customers whose balance is below `least` have no name yet."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "CHAIRMAN").when(p == "2-HIGH", "controller").when(p == "3-MEDIUM", "Founder").when(p == "5-LOW", "EMPLOYEE").otherwise("FRIEND")
    firm = F.when(F.col("o_totalprice") <= 495_000, F.concat(F.lit("Firm "), (k % 100).cast("string")))
    link = F.struct(k.alias("relation_id"), (k % 100).alias("enterprise_id"), firm.alias("enterprise_name"), kind.alias("relation_type"), F.lit("").alias("raw_text"), F.lit(1).cast("long").alias("source_id"), F.when(F.col("o_orderstatus") == "F", "VERIFIED").otherwise("open").alias("verification_status"))
    links = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(link).alias("links"))
    segment = F.col("c_mktsegment")
    marital = F.when(segment == "BUILDING", "已婚").when(segment == "MACHINERY", "不便透露")
    rows = c.join(links, "c_custkey", "left")
    return rows.select(ids.person_id(F.col("c_custkey")).alias("owner"), F.col("c_custkey").alias("person_id"), F.when(F.col("c_acctbal") >= least, F.col("c_name")).otherwise(" ").alias("full_name"), segment.alias("person_type"), marital.alias("marital_status"), F.lit("1970年2月").alias("birth_date"), F.col("c_nationkey").cast("long").alias("source_id"), F.lit("open").alias("verification_status"), "links")


@query(
    "graph_build_attempts",
    """WITH l AS (SELECT o_custkey AS k, o_orderkey % 100 AS e, o_totalprice <= 495000 AS named, CASE o_orderpriority WHEN '1-URGENT' THEN 'CHAIRMAN_OF' WHEN '2-HIGH' THEN 'CONTROLS' WHEN '3-MEDIUM' THEN 'FOUNDED' WHEN '5-LOW' THEN 'WORKS_AT' END AS kind, o_orderstatus = 'F' AS sure FROM orders),
    p AS (SELECT k, count(DISTINCT CASE WHEN named THEN e END) AS firms, count(kind) AS related, count(*) - count(kind) + count(CASE WHEN kind = 'CONTROLS' AND NOT sure THEN 1 END) AS doubts FROM l GROUP BY 1),
    b AS (SELECT DISTINCT a.k FROM l a WHERE a.kind IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l z WHERE z.k = a.k AND z.e = a.e AND z.named)),
    s AS (SELECT c_custkey, c_acctbal < -500 AS blank, c_acctbal < 0 AS late, b.k IS NOT NULL AS loose, coalesce(firms, 0) AS firms, coalesce(related, 0) AS related, coalesce(doubts, 0) + CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS doubts FROM customer LEFT JOIN p ON p.k = c_custkey LEFT JOIN b ON b.k = c_custkey)
    SELECT concat('person:', c_custkey) AS owner, CASE WHEN blank OR loose THEN 'FAILED' ELSE 'SUCCESS' END AS state, CASE WHEN late OR loose THEN 2 ELSE 1 END AS attempt, CASE WHEN blank OR loose THEN 0 ELSE firms + 1 END AS nodes, CASE WHEN blank OR loose THEN 0 ELSE related END AS relations,
      concat_ws(',', CASE WHEN loose THEN 'DANGLING_RELATION' END, CASE WHEN blank THEN 'MISSING_NAME' END) AS reasons, doubts AS warnings, NOT (blank OR loose) AS stored FROM s""",
)
def graph_build_attempts(spark: SparkSession, d: str) -> DataFrame:
    """A first attempt over records of which some lack a name, a second after part of them were mended; what is left and what is stored."""
    path = new_path(spark, "build")
    sources = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("source_id"))
    for least in (0.0, -500.0):
        states = build.run(person_records(spark, d, least), lambda taken: build.persons_with_enterprises(taken, sources), path)
    doubts = build.issues(spark, path).where("severity = 'WARNING'").groupBy("owner").agg(F.count("*").alias("warnings"))
    stored = sink.elements(spark, f"{path}/graph").where("label = 'Person'").select(F.col("id").alias("owner"), F.lit(True).alias("stored"))
    rows = states.join(doubts, "owner", "left").join(stored, "owner", "left")
    return rows.select("owner", "state", "attempt", "nodes", "relations", F.array_join("reasons", ",").alias("reasons"), F.coalesce("warnings", F.lit(0)).alias("warnings"), F.coalesce("stored", F.lit(False)).alias("stored"))
