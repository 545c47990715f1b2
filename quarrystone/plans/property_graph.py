"""Tables of persons, enterprises, families, organizations and events, made from the driver's tables, through the graph's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import ids
from quarrystone.operators import contracts, masking
from quarrystone.operators import graph_build as B
from quarrystone.operators import products as P
from quarrystone.plans.registry import query
from quarrystone.sources.tables import table


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources are nations but the first."""
    return table(spark, d, "nation").where("n_nationkey > 0").select(F.col("n_nationkey").cast("long").alias("source_id"))


def finger(*parts: str) -> str:
    """SQL of the first 24 hex digits of the hash of parts."""
    return f"substr(sha256(concat_ws(chr(31), {', '.join(parts)})), 1, 24)"


@query(
    "graph_persons",
    """SELECT concat('person:', c_custkey) AS node_id, c_name AS name, CASE WHEN c_custkey % 3 = 0 AND c_nationkey > 0 THEN 'CONFIRMED' ELSE 'PENDING' END AS status, c_mktsegment AS segment,
    CASE c_custkey % 2 WHEN 0 THEN 'MARRIED' END AS marital, CASE c_custkey % 2 WHEN 0 THEN '1970-02' END AS birth FROM customer""",
)
def graph_persons(spark: SparkSession, d: str) -> DataFrame:
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    person = c.select(k.alias("person_id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("person_type"))
    profile = c.select(k.alias("person_id"), F.when(k % 2 == 0, "已婚").otherwise("未公开").alias("marital_status"), F.when(k % 2 == 0, "1970年2月").alias("birth_date"), F.col("c_nationkey").cast("long").alias("source_id"), F.when(k % 3 == 0, "verified").otherwise("open").alias("verification_status"))
    profile = profile.unionByName(profile.withColumn("marital_status", F.lit("离异")).withColumn("source_id", F.col("source_id") + 100))  # a later profile doesn't count
    nodes, _ = B.person_nodes(person, profile, sources(spark, d))
    p = F.col("properties")
    return nodes.select("node_id", "name", "status", p["person_type"].alias("segment"), p["marital_status"].alias("marital"), p["birth_date"].alias("birth"))


@query(
    "graph_person_issues",
    f"""SELECT 'MISSING_SOURCE' AS reason, CAST(c_custkey AS VARCHAR) AS source_pk, concat('issue:', {finger("'MISSING_SOURCE'", "'person'", "c_custkey", "'source_id'", "'no source row'")}) AS issue_id FROM customer WHERE c_custkey % 5 = 0
    UNION ALL SELECT 'UNKNOWN_ENUM', CAST(c_custkey AS VARCHAR), concat('issue:', {finger("'UNKNOWN_ENUM'", "'person_profile'", "c_custkey", "'marital_status'", "'marital status can''t be normalized'")}) FROM customer WHERE c_custkey % 5 = 1""",
)
def graph_person_issues(spark: SparkSession, d: str) -> DataFrame:
    """Persons without a profile, and states that no rule knows."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    person = c.select(k.alias("person_id"), F.col("c_name").alias("full_name"), F.lit("X").alias("person_type"))
    profile = c.where(k % 5 > 0).select(k.alias("person_id"), F.when(k % 5 == 1, "不便透露").otherwise("已婚").alias("marital_status"), F.lit(None).cast("string").alias("birth_date"), F.lit(1).cast("long").alias("source_id"), F.lit("open").alias("verification_status"))
    return B.person_nodes(person, profile, sources(spark, d))[1].select("reason", "source_pk", "issue_id")


@query(
    "graph_enterprises",
    """WITH l AS (SELECT ps AS s, to_json(list_sort(list(DISTINCT p_type))) AS lines FROM (SELECT p_partkey % 10 + 1 AS ps, p_type FROM part) GROUP BY 1)
    SELECT concat('enterprise:', s_suppkey) AS node_id, s_name AS name, CASE WHEN s_nationkey > 0 AND s_suppkey % 2 = 0 THEN 'CONFIRMED' ELSE 'PENDING' END AS status, lower(replace(s_name, ' ', '')) AS key,
    CASE WHEN s_suppkey % 3 = 0 THEN '深圳' END AS office, CASE WHEN s_suppkey <= 10 THEN lines END AS lines FROM supplier LEFT JOIN l ON s = s_suppkey""",
)
def graph_enterprises(spark: SparkSession, d: str) -> DataFrame:
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    enterprise = s.select(k.alias("enterprise_id"), F.col("s_name").alias("enterprise_name"), F.when(k % 3 == 0, "深圳").when(k % 3 == 1, "南山区科技路1号").alias("headquarters"), F.lit(None).cast("string").alias("stock_code"))
    links = s.select(k.alias("enterprise_id"), k.alias("person_enterprise_relation_id"), F.col("s_nationkey").cast("long").alias("source_id"), F.when(k % 2 == 0, "CONFIRMED").otherwise("x").alias("verification_status"))
    links = links.unionByName(links.withColumn("person_enterprise_relation_id", F.col("person_enterprise_relation_id") + 1_000_000).withColumn("source_id", F.lit(0).cast("long")))
    business = table(spark, d, "part").select((F.col("p_partkey") % 10 + 1).alias("enterprise_id"), F.col("p_type").alias("business_line"))
    p = F.col("properties")
    return B.enterprise_nodes(enterprise, links, business, sources(spark, d)).select("node_id", "name", "status", p["normalized_name"].alias("key"), p["headquarters"].alias("office"), p["business_lines"].alias("lines"))


@query(
    "graph_person_enterprise",
    f"""WITH r AS (SELECT o_orderkey, concat('person:', o_custkey) AS a, concat('enterprise:', o_orderkey % 100) AS b, CASE o_orderkey % 4 WHEN 0 THEN 'CHAIRMAN_OF' WHEN 1 THEN 'CONTROLS' WHEN 2 THEN 'FOUNDED' END AS kind,
      CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 > 0 THEN 'CONFIRMED' ELSE 'PENDING' END AS status FROM orders)
    SELECT 'relation' AS row_kind, concat('relation:', {finger("a", "kind", "b", "1", "'person_enterprise_relation'", "o_orderkey")}) AS id, a AS start_node_id, b AS end_node_id, kind, status FROM r WHERE kind IS NOT NULL
    UNION ALL SELECT 'issue', CAST(o_orderkey AS VARCHAR), NULL, NULL, 'UNKNOWN_ENUM', 'WARNING' FROM r WHERE kind IS NULL
    UNION ALL SELECT 'issue', CAST(o_orderkey AS VARCHAR), NULL, NULL, 'STRICT_RELATION_VERIFICATION', 'WARNING' FROM r WHERE kind = 'CONTROLS' AND status = 'PENDING'""",
)
def graph_person_enterprise(spark: SparkSession, d: str) -> DataFrame:
    """Types by code, evidence that speculates keeps a relation pending, control must be confirmed."""
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "chairman").when(k % 4 == 1, "CONTROLLER").when(k % 4 == 2, "Founder").otherwise("FRIEND")
    links = table(spark, d, "orders").select(k.alias("person_enterprise_relation_id"), F.col("o_custkey").alias("person_id"), (k % 100).alias("enterprise_id"), kind.alias("relation_type"), F.when(k % 7 == 0, "据传控股").otherwise("公告").alias("raw_text"), F.lit(1).cast("long").alias("source_id"), F.when(k % 3 == 0, "VERIFIED").otherwise("open").alias("verification_status"))
    made, issues = B.enterprise_relations(links, sources(spark, d))
    none = F.lit(None).cast("string")
    rows = made.select(F.lit("relation").alias("row_kind"), F.col("relation_id").alias("id"), "start_node_id", "end_node_id", F.col("relation_type").alias("kind"), "status")
    return rows.unionByName(issues.select(F.lit("issue").alias("row_kind"), F.col("source_pk").alias("id"), none.alias("start_node_id"), none.alias("end_node_id"), F.col("reason").alias("kind"), F.col("severity").alias("status")))


@query(
    "graph_family",
    """SELECT concat('family-member:', o_orderkey) AS node_id, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN concat('SON_', o_orderkey) ELSE concat('FamilyMember:', o_orderkey) END
      WHEN o_orderkey % 3 = 1 THEN concat('名', o_orderkey) ELSE CASE WHEN o_orderkey % 2 = 0 THEN concat('SON_', o_orderkey) ELSE concat('FamilyMember:', o_orderkey) END END AS name, o_custkey AS person_id, 'PENDING' AS status FROM orders
    UNION ALL SELECT concat('family-profile:', o_custkey), '家庭', o_custkey, 'PENDING' FROM orders GROUP BY o_custkey""",
)
def graph_family(spark: SparkSession, d: str) -> DataFrame:
    """Restricted members go by alias, and so do those without a name."""
    k = F.col("o_orderkey")
    members = table(spark, d, "orders").select(k.alias("family_member_id"), F.col("o_custkey").alias("person_id"), F.when(k % 3 < 2, F.concat(F.lit("名"), k.cast("string"))).alias("member_name"), F.when(k % 2 == 0, F.concat(F.lit("SON_"), k.cast("string"))).otherwise("未公开").alias("protected_alias"), F.when(k % 3 == 0, "restricted").otherwise("PUBLIC").alias("public_disclosure_level"), F.lit(1).cast("long").alias("source_id"))
    return B.family_nodes(members).select("node_id", "name", "person_id", "status")


@query(
    "graph_careers",
    """SELECT concat('person:', c_custkey) AS a, kind, concat('enterprise:', c_custkey % 10 + 1) AS b, CASE WHEN c_custkey % 3 = 0 THEN 'CONFIRMED' ELSE 'PENDING' END AS status FROM customer, (SELECT unnest([0, 1, 2, 2]) AS m, unnest(['CHAIRMAN_OF', 'WORKS_AT', 'CEO_OF', 'FOUNDED']) AS kind)
    WHERE c_custkey % 5 = m AND NOT (c_custkey % 2 = 0 AND kind = 'CEO_OF')
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'MAPPING_PENDING', NULL, 'WARNING' FROM customer WHERE c_custkey % 5 = 3
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'UNMATCHED_RELATION', NULL, 'WARNING' FROM customer WHERE c_custkey % 5 = 4
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'DUPLICATE_RELATION_CANDIDATE', NULL, 'INFO' FROM customer WHERE c_custkey % 5 = 2 AND c_custkey % 2 = 0""",
)
def graph_careers(spark: SparkSession, d: str) -> DataFrame:
    """Roles of a title at a known organization (of equal names the last one), unless an explicit relation says so; what can't be one is an issue."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    entity = table(spark, d, "supplier").where("s_suppkey <= 10")
    name = F.concat(F.lit("甲 公司"), F.col("s_suppkey").cast("string"))
    entities = entity.select(ids.enterprise_id(F.col("s_suppkey")).alias("node_id"), F.lit("Enterprise").alias("node_type"), name.alias("name"), F.lit(2).alias("position"))
    entities = entities.unionByName(entities.withColumn("node_id", F.lit("organization:0")).withColumn("position", F.lit(1)))
    title = F.when(k % 5 == 0, "董事会主席").when(k % 5 == 1, "经理").when(k % 5 == 2, "CEO、创始人").when(k % 5 == 4, "x")
    career = c.select(k.alias("career_id"), k.alias("person_id"), F.when(k % 5 == 4, "别处").otherwise(F.concat(F.lit("甲公司"), (k % 10 + 1).cast("string"), F.lit("（0700.HK）"))).alias("organization_name"), title.alias("position_title"), F.lit("").alias("career_description"), F.lit(1).cast("long").alias("source_id"), F.when(k % 3 == 0, "VERIFIED").alias("verification_status"))
    explicit = c.where(k % 2 == 0).select(ids.person_id(k).alias("start_node_id"), F.lit("CEO_OF").alias("relation_type"), ids.enterprise_id(k % 10 + 1).alias("end_node_id"))
    made, issues = B.career_relations(career, entities, explicit, sources(spark, d))
    rows = made.select(F.col("start_node_id").alias("a"), F.col("relation_type").alias("kind"), F.col("end_node_id").alias("b"), "status")
    return rows.unionByName(issues.select(F.col("source_pk").alias("a"), F.col("reason").alias("kind"), F.lit(None).cast("string").alias("b"), F.col("severity").alias("status")))


@query(
    "graph_social",
    """SELECT concat('person:', c_custkey) AS a, CASE WHEN c_custkey % 4 = 0 THEN 'MEMBER_OF' ELSE 'RELATED_TO' END AS kind, concat('organization:', c_nationkey) AS b FROM customer WHERE c_custkey % 4 < 2 AND c_nationkey < 20
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'UNMATCHED_RELATION', NULL FROM customer WHERE c_custkey % 4 < 2 AND c_nationkey >= 20
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'UNKNOWN_ENUM', NULL FROM customer WHERE c_custkey % 4 >= 2""",
)
def graph_social(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    links = table(spark, d, "customer").select(k.alias("person_social_relation_id"), k.alias("person_id"), F.col("c_nationkey").alias("social_organization_id"), F.when(k % 4 == 0, "member").when(k % 4 == 1, "PUBLIC_ROLE").when(k % 4 == 2, "?").alias("relation_type"), F.lit("x").alias("role_title"), F.lit("").alias("raw_text"), F.lit(1).cast("long").alias("source_id"), F.lit("VERIFIED").alias("verification_status"))
    made, issues = B.social_relations(links, table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("social_organization_id")), sources(spark, d))
    rows = made.select(F.col("start_node_id").alias("a"), F.col("relation_type").alias("kind"), F.col("end_node_id").alias("b"))
    return rows.unionByName(issues.select(F.col("source_pk").alias("a"), F.col("reason").alias("kind"), F.lit(None).cast("string").alias("b")))


@query(
    "graph_market",
    f"""WITH m AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 6 AS r FROM part)
    SELECT concat('enterprise:', k) AS a, CASE r WHEN 0 THEN 'HAS_UPSTREAM' WHEN 1 THEN 'HAS_DOWNSTREAM' ELSE 'COMPETES_WITH' END AS kind,
      CASE WHEN r < 2 THEN concat('market-segment:', {finger("concat('段', s)")}) WHEN s <= 5 THEN concat('enterprise:', s) ELSE concat('enterprise-reference:', {finger("concat('段', s)")}) END AS b FROM m WHERE r < 3
    UNION ALL SELECT CAST(k AS VARCHAR), CASE r WHEN 3 THEN 'COUNTERPART_NOT_ENTERPRISE' WHEN 4 THEN 'COUNTERPART_NAME_MISSING' ELSE 'UNKNOWN_ENUM' END, NULL FROM m WHERE r >= 3
    UNION ALL SELECT DISTINCT 'node', 'MarketSegment', concat('market-segment:', {finger("concat('段', s)")}) FROM m WHERE r < 2
    UNION ALL SELECT DISTINCT 'node', 'Enterprise', concat('enterprise-reference:', {finger("concat('段', s)")}) FROM m WHERE r = 2 AND s > 5""",
)
def graph_market(spark: SparkSession, d: str) -> DataFrame:
    """Rivals are known enterprises by name or references, never generic names; what is up or down the stream is a segment."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    r = k % 6
    name = F.when(r == 3, "广告主").when(r == 4, "不详").otherwise(F.concat(F.lit(" 段"), s, F.lit("。")))
    market = table(spark, d, "part").select(k.alias("enterprise_market_relation_id"), k.alias("enterprise_id"), F.when(r == 0, "UPSTREAM").when(r == 1, "downstream").when(r == 5, "PARTNER").otherwise("COMPETITOR").alias("relation_type"), name.alias("counterpart_name"), F.lit("").alias("relation_description"), F.lit(1).cast("long").alias("source_id"), F.lit("x").alias("verification_status"))
    known = table(spark, d, "supplier").where("s_suppkey <= 5").select(F.col("s_suppkey").alias("enterprise_id"), F.concat(F.lit("段"), F.col("s_suppkey").cast("string")).alias("enterprise_name"))
    known = known.unionByName(known.withColumn("enterprise_id", F.col("enterprise_id") + 100))
    made, nodes, issues = B.market_relations(market, known, sources(spark, d))
    rows = made.select(F.col("start_node_id").alias("a"), F.col("relation_type").alias("kind"), F.col("end_node_id").alias("b"))
    rows = rows.unionByName(issues.select(F.col("source_pk").alias("a"), F.col("reason").alias("kind"), F.lit(None).cast("string").alias("b")))
    return rows.unionByName(nodes.select(F.lit("node").alias("a"), F.col("node_type").alias("kind"), F.col("node_id").alias("b")))


@query(
    "graph_event_rows",
    f"""WITH e AS (SELECT event_id AS k, user_id AS u, event_id % 5 AS r FROM events)
    SELECT concat('event:', {finger("concat('person:', u)", "t", "'financial_event'", "k")}) AS id, t AS kind, concat('person:', u) AS subject, CASE r WHEN 0 THEN '2024-03' WHEN 1 THEN '2019' END AS date,
      CASE WHEN r = 0 AND k % 2 = 0 THEN 'CONFIRMED' ELSE 'PENDING' END AS status FROM (SELECT *, CASE WHEN r < 2 THEN 'INVESTMENT' WHEN r < 4 THEN 'GIFT' END AS t FROM e) WHERE r < 4
    UNION ALL SELECT CAST(k AS VARCHAR), 'UNKNOWN_ENUM', NULL, NULL, 'WARNING' FROM e WHERE r = 4
    UNION ALL SELECT CAST(k AS VARCHAR), 'PARSE_FAILED', NULL, NULL, 'WARNING' FROM e WHERE r = 2
    UNION ALL SELECT CAST(k AS VARCHAR), 'MAPPING_PENDING', NULL, NULL, 'INFO' FROM e WHERE r = 1""",
)
def graph_event_rows(spark: SparkSession, d: str) -> DataFrame:
    """Dates keep their precision, estimates and unreadable ones keep an event pending."""
    k = F.col("event_id")
    r = k % 5
    rows = table(spark, d, "events").select(k.alias("financial_event_id"), F.col("user_id").alias("person_id"), F.when(r < 2, "investment").when(r < 4, "GIFT").otherwise("ASSET_GIFT").alias("event_type"), F.when(r == 0, "2024年3月").when(r == 1, "约2019年").when(r == 2, "坏").alias("event_date"), F.lit("公告").alias("event_description"), F.lit(1).cast("long").alias("source_id"), F.when((r == 0) & (k % 2 == 0), "VERIFIED").otherwise("x").alias("verification_status"))
    made, _, issues = B.events(rows, "financial_event", "financial_event_id", "event_type", B.FINANCIAL_EVENTS, ids.person_id(F.col("person_id")), ["event_date"], "event_description", sources(spark, d))
    none = F.lit(None).cast("string")
    out = made.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("subject_node_id").alias("subject"), F.col("event_date").alias("date"), "status")
    return out.unionByName(issues.select(F.col("source_pk").alias("id"), F.col("reason").alias("kind"), none.alias("subject"), none.alias("date"), F.col("severity").alias("status")))


@query("graph_partners", """WITH n AS (SELECT p_brand AS name, min(p_partkey) AS k, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN n = 1 THEN concat('organization:', k) END AS node FROM part JOIN n ON name = p_brand""")
def graph_partners(spark: SparkSession, d: str) -> DataFrame:
    """A partner is the one organization of its name, or none."""
    p = table(spark, d, "part")
    organizations = p.select(F.col("p_partkey").alias("social_organization_id"), F.col("p_brand").alias("organization_name"))
    found = B.unique_partner(p.select("p_partkey", F.regexp_replace(F.lower("p_brand"), "#", " #").alias("partner_name")), organizations)
    return found.select("p_partkey", "node")


@query(
    "products_selected",
    """SELECT p_partkey AS product_id, CAST((p_partkey % 2 = 0)::INT + (p_partkey % 3 = 0)::INT + (p_size BETWEEN 10 AND 20)::INT AS INTEGER) AS score FROM part
    WHERE (p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_size BETWEEN 10 AND 20) AND p_partkey % 5 > 0""",
)
def products_selected(spark: SparkSession, d: str) -> DataFrame:
    """Terms of a query match a product, contradict it or say nothing; generic terms don't count."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    income = F.when(k % 5 == 0, "非保本浮动").otherwise("其他")
    rows = table(spark, d, "part").select(k.alias("product_id"), F.lit("甲").alias("product_name"), F.when(k % 2 == 0, "固定收益类").otherwise("权益类").alias("product_category"), income.alias("income_type"), *[none.alias(c) for c in ("operation_mode", "term_type", "liquidity_rule", "target_customer")], F.lit("稳健型").alias("eligibility_conditions"), F.when(k % 3 == 0, "pr2").otherwise("PR4").alias("risk_level"), (F.col("p_size") * 36.5).cast("int").alias("term_days"))
    found = P.selected(rows, ["理财产品 固收", "低风险，保本", "1-2年"])
    return found.select("product_id", F.col("score").cast("int").alias("score"))


@query("product_documents", """SELECT CAST(p_size AS DOUBLE) AS document_id, min(p_partkey) AS product_id FROM part WHERE p_partkey % 4 > 0 GROUP BY 1 UNION ALL SELECT NULL, p_partkey FROM part WHERE p_partkey % 4 = 0""")
def product_documents(spark: SparkSession, d: str) -> DataFrame:
    """A document's first product, and products without a document."""
    p = table(spark, d, "part")
    first, none = P.documents_of(p.select(F.col("p_partkey").alias("product_id"), F.col("p_partkey").alias("position")), p.where("p_partkey % 4 > 0").select(F.col("p_partkey").alias("product_id"), F.col("p_size").alias("document_id")))
    return first.select(F.col("document_id").cast("double").alias("document_id"), "product_id").unionByName(none.select(F.lit(None).cast("double").alias("document_id"), "product_id"))


@query(
    "masked_notes",
    """WITH n AS (SELECT c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey = m DESC, c_custkey) AS i FROM (SELECT *, min(c_custkey) OVER (PARTITION BY c_nationkey) AS m FROM customer))
    SELECT k AS c_custkey, concat('P-', i, ' 与 P-', i, ' 会面,', repeat('x', CAST(k % 30 AS INTEGER))) [1:40] AS note, length(concat('P-', i, ' 与 P-', i, ' 会面,')) + k % 30 > 40 AS truncated FROM n""",
)
def masked_notes(spark: SparkSession, d: str) -> DataFrame:
    """Names become aliases, whatever spaces or zero-width characters stand within them; wide forms are folded, then the text is cut."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("person_id"), F.concat(F.lit("甲客户"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("号")).alias("name"))
    least = c.groupBy("person_id").agg(F.min("c_custkey").alias("m"))
    entities = c.join(least, "person_id").select("person_id", F.lit("Person").alias("entity_type"), F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") == F.col("m")).alias("is_customer"))
    named = masking.aliases(entities).select("person_id", F.col("entity_id").alias("c_custkey"), "alias").join(c, ["person_id", "c_custkey"])
    spaced = F.concat(F.substring("name", 1, 3), F.lit(" ​"), F.substring("name", 4, 20))
    rows = c.select("c_custkey", "person_id", F.concat("name", F.lit(" 与 "), spaced, F.lit(" 会面，"), F.repeat(F.lit("x"), (F.col("c_custkey") % 30).cast("int"))).alias("note"))
    return masking.masked_text(rows, masking.name_bindings(named), "note", 40).select("c_custkey", "note", "truncated")


@query("restored_notes", """SELECT c_custkey, concat(c_name, '：P-10000x，F-9') AS note FROM customer""")
def restored_notes(spark: SparkSession, d: str) -> DataFrame:
    """Aliases back to names; others stay."""
    c = table(spark, d, "customer")
    rows = c.select("c_custkey", F.lit("P-1：P-10000x，F-9").alias("note"))
    return masking.restored(rows, c.select("c_custkey", F.lit("P-1").alias("alias"), F.col("c_name").alias("name")), "note", "c_custkey")


@query(
    "unsafe_notes",
    """SELECT c_custkey, 'note' AS field, CASE c_custkey % 4 WHEN 0 THEN 'BLANK' WHEN 1 THEN 'TOO_LONG' END AS problem FROM customer WHERE c_custkey % 4 < 2""",
)
def unsafe_notes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    note = F.when(k % 4 == 0, "  ").when(k % 4 == 1, F.repeat(F.lit("字"), 61)).when(k % 4 == 2, "一切正常")
    return masking.unsafe_fields(table(spark, d, "customer").select("c_custkey", note.alias("note")), ["c_custkey"], ["note"], 60)


@query(
    "omitted_fields",
    """SELECT o_custkey, o_orderkey AS position, CAST(n AS INTEGER) AS number, total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) WHERE n <= 5""",
)
def omitted_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("position"), F.lit("f").alias("field"), F.lit("r").alias("reason"))
    return masking.omissions(rows, "o_custkey", 5).select("o_custkey", "position", "number", "total")


@query("sealed_payloads", """SELECT c_custkey, sha256(concat('{"id":', c_custkey, ',"name":"', c_name, '"}')) AS sha, true AS fits FROM customer""")
def sealed_payloads(spark: SparkSession, d: str) -> DataFrame:
    _, sha, fits = masking.sealed(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    return table(spark, d, "customer").select("c_custkey", sha.alias("sha"), fits.alias("fits"))


@query(
    "result_violations",
    """SELECT o_orderkey, 'level' AS field, 'ENUM' AS problem FROM orders WHERE o_orderkey % 7 = 1 UNION ALL SELECT o_orderkey, 'summary', 'MISSING' FROM orders WHERE o_orderkey % 7 = 2
    UNION ALL SELECT o_orderkey, 'needs', 'TOO_MANY' FROM orders WHERE o_orderkey % 7 = 3 UNION ALL SELECT o_orderkey, '', 'UNKNOWN_FIELD' FROM orders WHERE o_orderkey % 7 = 4
    UNION ALL SELECT o_orderkey, 'sources', 'EVIDENCE' FROM orders WHERE o_orderkey % 7 = 5 UNION ALL SELECT o_orderkey, '', 'NOT_AN_OBJECT' FROM orders WHERE o_orderkey % 7 = 6""",
)
def result_violations(spark: SparkSession, d: str) -> DataFrame:
    """A result's fields, codes, lengths and evidence against its contract."""
    k = F.col("o_orderkey") % 7
    good = '{"level": "HIGH", "summary": "ok", "needs": ["a"], "sources": ["SRC-1"]}'
    changes = ((1, '"HIGH"', '"odd"'), (2, '"ok"', '" "'), (3, '["a"]', '["a", "b", "c"]'), (4, '"level"', '"more": 1, "level"'), (5, "SRC-1", "SRC-9"), (6, "{", "["))
    body = F.lit(good)
    for i, old, new in changes:
        body = F.when(k == i, good.replace(old, new)).otherwise(body)
    rows = table(spark, d, "orders").select("o_orderkey", body.alias("body"))
    return contracts.violations(rows, "o_orderkey", "body", ["summary"], {"level": ["HIGH", "LOW"]}, {"needs": 2}, "sources", F.array(F.lit("SRC-1"), F.lit("SRC-2")))


@query(
    "optimistic_locks",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat('new', c_custkey) ELSE c_name END AS value, CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS version FROM customer""",
)
def optimistic_locks(spark: SparkSession, d: str) -> DataFrame:
    """Updates that expect the current version count, the first of several; late ones don't."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    current = c.select("c_custkey", F.col("c_name").alias("value"), F.lit(1).alias("version"))
    updates = c.where(k % 3 == 0).select("c_custkey", F.concat(F.lit("new"), k.cast("string")).alias("value"), F.lit(1).alias("expected"), (k * 2).alias("position"))
    updates = updates.unionByName(updates.withColumn("value", F.lit("late")).withColumn("position", F.col("position") + 1)).unionByName(c.select("c_custkey", F.lit("old").alias("value"), F.lit(0).alias("expected"), F.lit(-1).cast("long").alias("position")))
    return contracts.compare_and_set(current, updates, "c_custkey", "value")[0]
