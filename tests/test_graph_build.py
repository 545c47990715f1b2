"""Relational rows to graph candidates, and product metadata, on invented rows."""

from pyspark.sql import functions as F

from quarrystone.functions import ids
from quarrystone.operators import graph_build as G
from quarrystone.operators import products as P


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_G01_persons(spark):
    person = frame(spark, "person_id long, full_name string, person_type string", (1, "甲", "X"), (2, "乙", None))
    profile = frame(spark, "person_id long, gender string, native_place string, education_level string, school_name string, marital_status string, birth_date string, source_id long, verification_status string", (1, "F", "未公开", "硕士", None, "已婚", "1970-02", 5, "VERIFIED"), (1, "M", None, None, None, None, None, 9, "x"))
    nodes, issues = G.person_nodes(person, profile, frame(spark, "source_id long", (5,)))
    got = {r.node_id: r for r in nodes.collect()}
    assert got["person:1"].status == "CONFIRMED" and got["person:1"].properties == {"person_type": "X", "gender": "F", "education_level": "硕士", "marital_status": "MARRIED", "birth_date": "1970-02"}
    assert got["person:2"].status == "PENDING" and [(r.reason, r.source_pk) for r in issues.collect()] == [("MISSING_SOURCE", "2")]


def test_G06_G07_relations(spark):
    sources = frame(spark, "source_id long", (5,))
    links = frame(spark, "person_enterprise_relation_id long, person_id long, enterprise_id long, relation_type string, title string, raw_text string, source_id long, verification_status string", (1, 1, 7, "chairman", "董事长", "", 5, "CONFIRMED"), (2, 1, 7, "CONTROLLER", None, "据传", 5, "CONFIRMED"), (3, 1, 8, "FRIEND", None, "", 5, None))
    made, issues = G.enterprise_relations(links, sources)
    assert {(r.relation_type, r.status) for r in made.collect()} == {("CHAIRMAN_OF", "CONFIRMED"), ("CONTROLS", "PENDING")}
    assert {(r.reason, r.source_pk) for r in issues.collect()} == {("UNKNOWN_ENUM", "3"), ("STRICT_RELATION_VERIFICATION", "2")}
    entities = frame(spark, "node_id string, node_type string, name string, position int", ("enterprise:7", "Enterprise", "某 公司", 1), ("organization:3", "Organization", "某会", 2))
    career = frame(spark, "career_id long, person_id long, organization_name string, position_title string, career_description string, source_id long, verification_status string", (1, 1, "某公司（0700.HK）", "董事长兼CEO", None, 5, "VERIFIED"), (2, 1, "某会", "秘书", None, 5, None), (3, 1, "别处", "x", None, 5, None), (4, 1, "某会", None, None, 5, None))
    more, issues = G.career_relations(career, entities, made, sources)
    assert {(r.relation_type, r.end_node_id) for r in more.collect()} == {("CEO_OF", "enterprise:7"), ("WORKS_FOR", "organization:3")}
    assert {(r.reason, r.source_pk) for r in issues.collect()} == {("DUPLICATE_RELATION_CANDIDATE", "1"), ("UNMATCHED_RELATION", "3"), ("MAPPING_PENDING", "4")}


def test_G10_G11(spark):
    sources = frame(spark, "source_id long", (5,))
    links = frame(spark, "person_social_relation_id long, person_id long, social_organization_id long, relation_type string, role_title string, raw_text string, source_id long, verification_status string", (1, 1, 3, "MEMBER", "x", "", 5, "VERIFIED"), (2, 1, 4, "MEMBER", "x", "", 5, None), (3, 1, 3, "?", "x", "", 5, None))
    made, issues = G.social_relations(links, frame(spark, "social_organization_id long", (3,)), sources)
    assert [r.end_node_id for r in made.collect()] == ["organization:3"] and {r.reason for r in issues.collect()} == {"UNMATCHED_RELATION", "UNKNOWN_ENUM"}
    market = frame(spark, "enterprise_market_relation_id long, enterprise_id long, relation_type string, counterpart_name string, relation_description string, source_id long, verification_status string", (1, 7, "COMPETITOR", "乙 厂", "", 5, "VERIFIED"), (2, 7, "COMPETITOR", "广告主", "", 5, None), (3, 7, "DOWNSTREAM", "广告主", "", 5, None), (4, 7, "UPSTREAM", "丙厂", "", 5, None), (5, 7, "UPSTREAM", "丙厂", "", 5, None), (6, 7, "UPSTREAM", "不详", "", 5, None), (7, 7, "COMPETITOR", "丁厂", "", 5, None))
    made, nodes, issues = G.market_relations(market, frame(spark, "enterprise_id long, enterprise_name string", (9, "乙厂"), (12, "乙厂")), sources)
    assert {(r.relation_type, r.end_node_id.split(":")[0]) for r in made.collect()} == {("COMPETES_WITH", "enterprise"), ("HAS_DOWNSTREAM", "market-segment"), ("HAS_UPSTREAM", "market-segment"), ("COMPETES_WITH", "enterprise-reference")}
    assert made.where(F.col("end_node_id") == "enterprise:9").count() == 1 and nodes.count() == 3 and made.count() == 5
    assert {(r.reason, r.source_pk) for r in issues.collect()} == {("COUNTERPART_NOT_ENTERPRISE", "2"), ("COUNTERPART_NAME_MISSING", "6")}


def test_G12_G13_events(spark):
    rows = frame(spark, "financial_event_id long, person_id long, event_type string, event_date string, event_description string, source_id long, verification_status string", (1, 1, "INVESTMENT", "2024-03", "x", 5, "VERIFIED"), (2, 1, "ASSET_GIFT", None, "x", 5, None), (3, 1, "GIFT", "约2019年", "x", 5, None), (4, 1, "GIFT", "坏", "可能", 5, "VERIFIED"))
    made, links, issues = G.events(rows, "financial_event", "financial_event_id", "event_type", G.FINANCIAL_EVENTS, ids.person_id(F.col("person_id")), ["event_date"], "event_description", frame(spark, "source_id long", (5,)))
    assert {(r.event_type, r.event_date, r.status) for r in made.collect()} == {("INVESTMENT", "2024-03", "CONFIRMED"), ("GIFT", "2019", "PENDING"), ("GIFT", None, "PENDING")}
    assert {r.relation_type for r in links.collect()} == {"HAS_EVENT"} and {(r.reason, r.source_pk) for r in issues.collect()} == {("UNKNOWN_ENUM", "2"), ("MAPPING_PENDING", "3"), ("PARSE_FAILED", "4")}
    partners = frame(spark, "activity_id long, partner_name string", (1, "甲大学"), (2, "乙"), (3, None))
    found = G.unique_partner(partners, frame(spark, "social_organization_id long, organization_name string", (1, "甲 大学"), (2, "乙"), (3, "乙")))
    assert {r.activity_id: r.node for r in found.collect()} == {1: "organization:1", 2: None, 3: None}


def test_G03_G04_family(spark):
    members = frame(spark, "family_member_id long, person_id long, member_name string, protected_alias string, public_disclosure_level string, source_id long", (1, 1, "甲", "SON_1", "RESTRICTED", 5), (2, 1, "乙", None, "PUBLIC", 6), (3, 2, None, None, "RESTRICTED", 7))
    assert {r.node_id: r.name for r in G.family_nodes(members).where("node_type = 'FamilyMember'").collect()} == {"family-member:1": "SON_1", "family-member:2": "乙", "family-member:3": "FamilyMember:3"}
    assert G.family_nodes(members).where("node_type = 'FamilyProfile'").count() == 2


def test_R02_R03_metadata(spark):
    schema = "product_id string, product_name string, product_category string, income_type string, operation_mode string, term_type string, liquidity_rule string, target_customer string, eligibility_conditions string, risk_level string, term_days int"
    df = frame(spark, schema, ("a", "甲", "固定收益类", "非保本浮动", None, None, None, None, "稳健型", "pr2", 400), ("b", "乙", "权益类", "保本固定", None, None, None, None, "进取型", "PR4", 90))
    pick = lambda *q: [(r.product_id, r.issue) for r in P.selected(df, list(q)).collect()]
    assert pick("固收 1-2年") == [("a", None)] and pick("理财产品") == [("a", None), ("b", None)] and pick("没有的词") == [("a", None), ("b", None)]
    assert pick("保本") == [("b", None)] and pick("低风险，保本") == [("b", None)] and pick("低风险 确定收益 非保本") == [("b", None)]
    links = frame(spark, "product_id string, document_id string", ("a", "d1"), ("b", "d1"))
    first, none = P.documents_of(df.withColumn("position", F.when(F.col("product_id") == "b", 0).otherwise(1)), links)
    assert first.first().product_id == "b" and none.count() == 0
