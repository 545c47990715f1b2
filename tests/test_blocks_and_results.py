"""Numbered runs, tables, pages, embedding batches, codes of texts and contracts of results."""

import json

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import rules, security
from quarrystone.operators import chunks as C
from quarrystone.operators import result_contracts as R
from quarrystone.plans.results import GOOD, changed

BLOCKS = "page_id int, position int, kind string, level int, text string, path array<string>, page_start int, page_end int"
LONG = "投资者应当在签约以前知悉本条所列全部风险并自行承担"


def blocks(spark, rows):
    return spark.createDataFrame([(1, i, k, n, t, path, page, page) for i, (k, n, t, path, page) in enumerate(rows)], BLOCKS)


def steadied(df):
    return [(r.position, r.kind, r.level) for r in df.where("steadied").orderBy("position").collect()]


def test_W08_clauses(spark):
    p = ["章"]
    rows = [("paragraph", None, "1. 甲。", p, 1), ("heading", 3, "2．" + LONG, [*p, "2．" + LONG], 1), ("list", None, "x", p, 1), ("paragraph", None, " 3. 丙； ", p, 2), ("heading", 3, "4. 名称", p, 2)]
    assert steadied(C.steady_clauses(blocks(spark, rows))) == [(1, "paragraph", None)]
    wall = [*rows[:2], ("table", None, "x", p, 1), *rows[3:]]
    far = [*rows[:3], ("paragraph", None, "3. 丙；", p, 4), rows[4]]
    two = [*rows[:3], ("list", None, "y", p, 1), *rows[3:]]
    other = [*rows[:3], ("paragraph", None, "3. 丙；", ["乙"], 2), rows[4]]
    for broken in (wall, far, two, other, rows[:2]):
        assert steadied(C.steady_clauses(blocks(spark, broken))) == []
    few = [("paragraph", None, "1. 甲", p, 1), ("heading", 3, "2. 乙。", p, 1), ("paragraph", None, "3. 丙", p, 1)]
    assert steadied(C.steady_clauses(blocks(spark, few))) == [] and steadied(C.steady_clauses(blocks(spark, []))) == []


def test_W07_siblings(spark):
    p = ["章"]
    rows = [("list", None, "（1）甲", p, 1), ("heading", None, "（2）乙", [*p, "（2）乙"], 1), ("paragraph", None, "x", p, 1), ("paragraph", None, "y", p, 1), ("paragraph", None, "（3）丙", p, 1)]
    assert steadied(C.steady_siblings(blocks(spark, rows))) == [(1, "list", None)]
    uneven = [rows[0], rows[1], ("paragraph", None, "（3）" + "丙" * 40, p, 1)]
    assert steadied(C.steady_siblings(blocks(spark, uneven))) == []
    assert steadied(C.steady_siblings(blocks(spark, [*uneven[:2], ("paragraph", None, "（3）" + "丙" * 40 + "。", p, 1)]))) == [(1, "list", None)]
    assert steadied(C.steady_siblings(blocks(spark, [("heading", None, f"（{i}）甲", p, 1) for i in range(1, 4)]))) == []


TABLE = "id int, rows array<array<string>>, pairs array<struct<key:string,value:string>>, text string"


def test_N22_tables(spark):
    rows = [["名 称", "甲"], ["1", "2"], [None, " 乙 ", "甲"], ["", ""]]
    df = spark.createDataFrame([(1, rows, [("类", "丁"), ("名称", "甲"), (" ", "")], ""), (2, rows, None, ""), (3, None, None, " t "), (4, None, [], None), (5, [["x" * 900]], None, "")], TABLE)
    got = {r.id: r.u for r in df.select("id", C.table_units(F.col("rows"), F.col("pairs")).alias("u")).collect()}
    assert got[1] == ["名称：甲", "乙", "类：丁"] and got[2] == ["名 称 | 甲", "1 | 2", " | 乙 | 甲"] and got[3] == []
    parts = {}
    for r in C.table_chunks(df, "id").orderBy("id", "position").collect():
        parts.setdefault(r.id, []).append((r.content, r.split))
    assert parts[3] == [("t", False)] and 4 not in parts and all(s for _, s in parts[5]) and "".join(c for c, _ in parts[5]) == "x" * 900
    assert parts[1] == [("名称：甲\n乙\n类：丁", False)]


def test_S19_pages(spark):
    pages = spark.createDataFrame([(1, 1, "t" * 20), (1, 2, " t "), (1, 3, "u" * 30), (1, 4, None), (2, 1, "v" * 20)], "doc_id int, page int, text string")
    held = spark.createDataFrame([(1, "table", "x", 1, 2), (2, "table", "  ", 1, 1)], "doc_id int, kind string, text string, page_start int, page_end int")
    found, issues = C.page_fallback(pages, held)
    assert sorted((r.doc_id, r.page_start, r.text[0]) for r in found.where("kind = 'paragraph'").collect()) == [(1, 3, "u"), (2, 1, "v")] and found.count() == 4
    assert sorted((r.doc_id, r.page, r.severity) for r in issues.collect()) == [(1, 2, "WARNING"), (1, 3, "INFO"), (1, 4, "WARNING"), (2, 1, "INFO")]


def test_C02_documents(spark):
    docs = spark.createDataFrame([("a", "PRD001", "S00001", 1), ("b", None, "", 0)], "doc_id string, product_code string, sales_code string, page_count int")
    held = spark.createDataFrame([("a", "、".join(C.IMPORTANT)), ("a", "产品代码：PRD001"), ("a", "销售代码 S99999")], "doc_id string, text string")
    issues = C.document_issues(docs, held)
    assert {(r.doc_id, r.reason) for r in issues.where("reason <> 'IMPORTANT_CONTENT_NOT_FOUND'").collect()} == {("a", "FILENAME_METADATA_MISMATCH"), ("b", "MISSING_PRODUCT_CODE"), ("b", "INVALID_PAGE_COUNT"), ("b", "EMPTY_BLOCKS")}
    assert issues.where("reason = 'IMPORTANT_CONTENT_NOT_FOUND'").count() == 6
    assert {r.doc_id: r.status for r in C.document_status(docs, issues).collect()} == {"a": "SUCCESS_WITH_WARNINGS", "b": "FAILED"}


def test_C07_batches(spark):
    rows = [(1, i, f"c{i}", "x") for i in range(12)] + [(2, 0, "d", " "), (3, 0, "e", "x"), (3, 1, "e", "x"), (4, 0, "f", "x"), (5, 0, "g", "x")]
    batches = C.embedding_batches(spark.createDataFrame(rows, "doc int, position int, chunk_id string, embedding_text string"), "doc")
    assert {(r.doc, r.batch): r["count"] for r in batches.groupBy("doc", "batch").count().collect()} == {(1, 0): 10, (1, 1): 2, (2, 0): 1, (3, 0): 2, (4, 0): 1, (5, 0): 1}
    answers = [(r.doc, r.batch, r["index"], [1.0, 2.0]) for r in batches.collect() if r.doc != 4] + [(4, 0, 1, [1.0, 2.0])]
    answers = [(*a[:3], [1.0, float("inf")]) if a[0] == 5 else a for a in answers]
    good, bad = C.embedded(batches, spark.createDataFrame(answers, "doc int, batch int, index int, vector array<double>"), "doc", 2)
    assert good.count() == 12 and {r.doc: r.problem for r in bad.collect()} == {2: "EMPTY_TEXT", 3: "DUPLICATE_CHUNK", 4: "ANSWER_INDEX", 5: "INVALID_VECTOR"}


@pytest.mark.parametrize(("value", "want"), [("广东省深圳市南山区", "广东省/深圳市"), ("江苏", "江苏省"), ("新疆", "新疆维吾尔自治区"), ("住杭州市西湖", "住杭州市"), ("Paris", "LOCATION_REDACTED"), (" ", None), (None, None)])
def test_P12_places(spark, value, want):
    assert spark.createDataFrame([(value,)], "t string").select(security.coarse_location(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("field", "value", "want"), [("gender", "女", "FEMALE"), ("gender", "x_1", "X_1"), ("healthStatus", "基本健康，一般", "GOOD"), ("maritalStatus", "未婚姻", "UNMARRIED"), ("investmentHorizon", "3-5年", "MEDIUM_TERM"), ("metricName", "其他", None), ("metricName", None, None)])
def test_P13_codes(spark, field, value, want):
    assert spark.createDataFrame([(value,)], "t string").select(security.mapped_code(F.col("t"), field)).first()[0] == want


def test_P14_groups(spark):
    df = spark.createDataFrame([("投资 content 与 AI",)], "t string")
    got = {g: df.select(security.semantic_codes(F.col("t"), table)).first()[0] for g, table in rules.SEMANTIC.items()}
    assert got["REPUTATION_RISK"] == ["CONTENT_GOVERNANCE", "INVESTMENT_EXPANSION"] and got["ENTERPRISE_EVENT"] == ["AI_STRATEGY"] and got["ROLE"] == [] and len(got) == 10


@pytest.mark.parametrize(
    ("answer", "graph", "want"),
    [
        (json.dumps(GOOD), ["REL-1"], set()),
        (json.dumps(GOOD), [], {("graphAssessment", "NOT_GRAPH_EVIDENCE"), ("graphAssessment", "GRAPH_NOT_AVAILABLE")}),
        (None, ["REL-1"], {("", "OBJECT")}),
        (changed(("graphAssessment", "evidenceRefs"), [], GOOD), ["REL-1"], {("graphAssessment", "NO_EVIDENCE")}),
        (changed(("findings", 0, "riskLevel"), 3, GOOD), ["REL-1"], {("findings[0].riskLevel", "ENUM")}),
        (changed(("findings", 0, "evidenceRefs"), [], GOOD), ["REL-1"], {("findings[0].evidenceRefs", "SIZE"), ("graphAssessment", "NO_FINDING")}),
        (changed(("followUpQuestions", 1, "question"), " x ", GOOD), ["REL-1"], {("followUpQuestions.question", "REPEATED")}),
        (changed(("followUpQuestions", 0), None, GOOD), ["REL-1"], {("followUpQuestions[0]", "OBJECT")}),
    ],
)
def test_P22_customer(spark, answer, graph, want):
    df = spark.createDataFrame([(1, answer, ["SRC-1", "REL-1"], graph)], "id int, answer string, allowed array<string>, graph array<string>")
    assert {(r.field, r.problem) for r in R.customer_problems(df, "id", "answer", "allowed", "graph").collect()} == want


def test_P23_others(spark):
    insight = {"customerId": "c", "kycArtifactRef": "r", "sourceRefs": [], "industryInsights": [{}], "competitorInsights": [None], "bankAdvantageMappings": [], "differentiatedViews": [], "marketingOpportunities": [], "riskFlags": [], "unresolvedItems": None}
    check = {"cfsArtifactRef": "a", "checkSummary": "s", "complianceResult": "MAYBE", "conclusionExplanations": [], "evidenceChain": [], "reviewRequiredItems": [], "findings": [{"location": "l", "ruleId": "r", "severity": "s", "message": "m", "suggestion": ""}]}
    product = {"mode": "m", "customerId": "c", "kycArtifactRef": "k", "unresolvedItems": [], "recommendedItems": [], "rejectedItems": [{"productId": "p", "productName": "n", "reason": "r"}], "reviewRequiredItems": [], "ruleCheckResults": []}
    df = spark.createDataFrame([(1, json.dumps(insight)), (2, json.dumps(check)), (3, json.dumps(product))], "id int, body string")
    found = {i: {(r.field, r.problem) for r in R.result_problems(df.where(F.col("id") == i), "id", "body", s).collect()} for i, s in ((1, R.INSIGHTS), (2, R.COMPLIANCE), (3, R.PRODUCTS))}
    assert found[1] == {("competitorInsights[0]", "MISSING"), ("unresolvedItems", "LIST")}
    assert found[2] == {("complianceResult", "ENUM"), ("findings[0].suggestion", "TEXT"), ("findings[0].evidenceRefs", "MISSING")}
    assert found[3] == {("rejectedItems[0].ruleId", "TEXT"), ("productEvidenceRefs", "LIST")}
