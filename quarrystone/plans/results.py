"""Results of assessments against their contracts: results with one planted fault each, by the keys of customers."""

from __future__ import annotations

import copy
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import result_contracts as C
from quarrystone.plans.registry import query
from quarrystone.sources.tables import spread, table

GOOD: dict[str, Any] = {
    "riskLevel": "LOW",
    "summary": "s",
    "findings": [{"dimension": "PERSON", "riskLevel": "HIGH", "finding": "f", "evidenceRefs": ["SRC-1", "REL-1"]}],
    "riskAlerts": [],
    "recommendedActions": ["a"],
    "dataGaps": [],
    "graphAssessment": {"contribution": "INCREMENTAL", "summary": "g", "evidenceRefs": ["REL-1"]},
    "followUpQuestions": [{"id": "q1", "question": "x"}, {"id": "q2", "question": "y"}],
}


def changed(at: tuple[str | int, ...], value: Any, base: dict[str, Any]) -> str:
    """The base with another value at one place."""
    out = copy.deepcopy(base)
    here: Any = out
    for step in at[:-1]:
        here = here[step]
    here[at[-1]] = value
    return json.dumps(out, ensure_ascii=False)


ANSWERS = [
    json.dumps(GOOD),
    "```json\n" + json.dumps(GOOD) + "\n```",
    "{",
    changed(("riskLevel",), "ODD", GOOD),
    changed(("summary",), "x" * 1201, GOOD),
    changed(("more",), 1, GOOD),
    changed(("findings", 0, "evidenceRefs"), ["SRC-9", "REL-1"], GOOD),
    changed(("findings", 0, "evidenceRefs"), ["SRC-1"], GOOD),
    changed(("graphAssessment", "evidenceRefs"), ["SRC-1"], GOOD),
    changed(("graphAssessment", "contribution"), "NOT_AVAILABLE", GOOD),
    changed(("followUpQuestions", 1, "id"), "q1", GOOD),
    changed(("riskAlerts",), [" "], GOOD),
    changed(("findings",), {}, GOOD),
]
FAULTS = """(VALUES (2, '', 'OBJECT'), (3, 'riskLevel', 'ENUM'), (4, 'summary', 'TEXT'), (5, '', 'UNKNOWN_FIELD'), (6, 'findings.evidenceRefs', 'NOT_ALLOWED'), (7, 'graphAssessment', 'NO_FINDING'),
    (8, 'graphAssessment', 'NOT_GRAPH_EVIDENCE'), (9, 'graphAssessment', 'GRAPH_AVAILABLE'), (10, 'followUpQuestions.id', 'REPEATED'), (11, 'riskAlerts[0]', 'TEXT'), (12, 'findings', 'LIST'), (12, 'graphAssessment', 'NO_FINDING')) AS t(form, field, problem)"""


def answers(spark: SparkSession, d: str, texts: list[str]) -> DataFrame:
    form = (F.col("c_custkey") % len(texts) + 1).cast("int")
    return spread(table(spark, d, "customer").select("c_custkey")).select("c_custkey", F.element_at(F.array(*[F.lit(t) for t in texts]), form).alias("answer"))


@query("customer_results", f"SELECT c_custkey, field, problem FROM customer JOIN {FAULTS} ON c_custkey % {len(ANSWERS)} = form")
def customer_results(spark: SparkSession, d: str) -> DataFrame:
    rows = answers(spark, d, ANSWERS).withColumn("allowed", F.array(F.lit("SRC-1"), F.lit("REL-1"))).withColumn("graph", F.array(F.lit("REL-1"), F.lit("REL-2")))
    return C.customer_problems(rows, "c_custkey", "answer", "allowed", "graph")


SCHEME = {
    "customerId": "c", "marketingStrategy": "m", "communicationGuide": "g", "comprehensiveRiskAssessment": "r", "pendingVerificationItems": [], "estimatedDataItems": [], "sourceRefs": [], "ruleRefs": [],
    "inputArtifactRefs": {"kyc": "a", "market": "b", "kyp": "c"}, "cfsVersion": 1, "productEvidenceRefs": [],
    "cfsStructure": {"chapter1CustomerInfo": "1", "chapter2ServicePlan": "2", "chapter3MarketingStrategy": "3", "attachments": list("abcdef")},
}
SCHEMES = [json.dumps(SCHEME), changed(("cfsVersion",), 0, SCHEME), changed(("cfsStructure", "attachments"), list("abcde"), SCHEME), changed(("inputArtifactRefs", "kyp"), "", SCHEME), changed(("productEvidenceRefs",), [{"chunkId": "1", "documentId": "2", "productId": "3", "sourceId": "4"}], SCHEME)]


@query(
    "scheme_results",
    """SELECT c_custkey, field, problem FROM customer JOIN (VALUES (1, 'cfsVersion', 'NOT_POSITIVE'), (2, 'cfsStructure.attachments', 'SIZE'), (3, 'inputArtifactRefs.kyp', 'TEXT'), (4, 'productEvidenceRefs[0].content', 'TEXT')) AS t(form, field, problem) ON c_custkey % 5 = form""",
)
def scheme_results(spark: SparkSession, d: str) -> DataFrame:
    return C.result_problems(answers(spark, d, SCHEMES), "c_custkey", "answer", C.SCHEME)
