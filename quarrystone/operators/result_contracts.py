"""Contracts of JSON results, stated as shapes and checked in the JVM: each departure is a row with its place and its kind.

A shape is a text, one of some values, a list, an object or anything that isn't null. Lengths are in code points.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import strip


@dataclass(frozen=True)
class Text:
    most: int | None = None


@dataclass(frozen=True)
class OneOf:
    values: Sequence[str]


@dataclass(frozen=True)
class Present:
    pass


@dataclass(frozen=True)
class Positive:
    pass


@dataclass(frozen=True)
class Many:
    item: Shape | None = None
    most: int | None = None
    least: int = 0


@dataclass(frozen=True)
class Object:
    """exact: these fields and no others."""

    fields: Mapping[str, Shape]
    exact: bool = False


Shape = Text | OneOf | Present | Positive | Many | Object
FOUND = "array<struct<field:string,problem:string>>"

#: Levels, dimensions and contributions of a customer's result, and verdicts of a check.
LEVELS, DIMENSIONS = ("LOW", "MEDIUM", "HIGH", "UNKNOWN"), ("PERSON", "ENTERPRISE", "FAMILY", "SOCIAL")
CONTRIBUTIONS = ("INCREMENTAL", "CONFIRMATORY", "NO_INCREMENT", "NOT_AVAILABLE")
VERDICTS = ("PASS", "REJECT", "REVIEW_REQUIRED")

REMARKS = Many(Text(600), most=20)
CUSTOMER = Object(
    {
        "riskLevel": OneOf(LEVELS),
        "summary": Text(1200),
        "findings": Many(Object({"dimension": OneOf(DIMENSIONS), "riskLevel": OneOf(LEVELS), "finding": Text(800), "evidenceRefs": Many(Text(), most=10, least=1)}, exact=True), most=20),
        "riskAlerts": REMARKS,
        "recommendedActions": REMARKS,
        "dataGaps": REMARKS,
        "graphAssessment": Object({"contribution": OneOf(CONTRIBUTIONS), "summary": Text(600), "evidenceRefs": Many(Text(), most=20)}, exact=True),
        "followUpQuestions": Many(Object({"id": Text(64), "question": Text(600)}, exact=True), most=10),
    },
    exact=True,
)


def texts(*names: str) -> dict[str, Shape]:
    return {n: Text() for n in names}


def lists(*names: str) -> dict[str, Shape]:
    return {n: Many() for n in names}


EVIDENCE = Many(Object(texts("chunkId", "documentId", "productId", "sourceId", "content")))
PRODUCTS = Object(
    texts("mode", "customerId", "kycArtifactRef")
    | lists("unresolvedItems")
    | {
        "recommendedItems": Many(Object(texts("productId", "productName", "reason") | {"limitations": Present(), "evidenceRefs": Present()})),
        "rejectedItems": Many(Object(texts("productId", "productName", "reason", "ruleId"))),
        "reviewRequiredItems": Many(Object(texts("productId", "productName", "reason"))),
        "ruleCheckResults": Many(Object(texts("ruleId", "productId", "message"))),
        "productEvidenceRefs": EVIDENCE,
    }
)
SCHEME = Object(
    texts("customerId", "marketingStrategy", "communicationGuide", "comprehensiveRiskAssessment")
    | lists("pendingVerificationItems", "estimatedDataItems", "sourceRefs", "ruleRefs")
    | {
        "inputArtifactRefs": Object(texts("kyc", "market", "kyp")),
        "cfsVersion": Positive(),
        "cfsStructure": Object(texts("chapter1CustomerInfo", "chapter2ServicePlan", "chapter3MarketingStrategy") | {"attachments": Many(Text(), most=6, least=6)}),
        "productEvidenceRefs": EVIDENCE,
    }
)
INSIGHTS = Object(
    texts("customerId", "kycArtifactRef")
    | lists("sourceRefs")
    | {n: Many(Present()) for n in ("industryInsights", "competitorInsights", "bankAdvantageMappings", "differentiatedViews", "marketingOpportunities", "riskFlags", "unresolvedItems")}
)
COMPLIANCE = Object(
    texts("cfsArtifactRef", "checkSummary")
    | lists("conclusionExplanations", "evidenceChain", "reviewRequiredItems")
    | {"complianceResult": OneOf(VERDICTS), "findings": Many(Object(texts("location", "ruleId", "severity", "message", "suggestion") | {"evidenceRefs": Present()}))}
)


def _found(when: Column, path: Column, problem: str) -> Column:
    row = F.array(F.struct(path.alias("field"), F.lit(problem).alias("problem")))
    return F.when(F.coalesce(when, F.lit(False)), row).otherwise(F.array().cast(FOUND))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), an array, with the value computed once however often f names it."""
    return F.flatten(F.transform(F.array(value), f))


def departures(value: Column, shape: Shape, path: Column) -> Column:
    """Array of (field, problem) of a variant that should have that shape. What isn't a list or an object has one problem."""
    if isinstance(shape, Many):
        return _once(F.try_variant_get(value, "$", "array<variant>"), lambda items: _list(items, shape, path))
    if isinstance(shape, Object):
        return _once(F.try_variant_get(value, "$", "map<string,variant>"), lambda fields: _object(fields, shape, path))
    return _once(value, lambda v: _single(v, shape, path))


def _single(value: Column, shape: Shape, path: Column) -> Column:
    if isinstance(shape, Positive):
        return _found(F.coalesce(F.try_variant_get(value, "$", "double"), F.lit(0.0)) <= 0, path, "NOT_POSITIVE")
    kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
    if isinstance(shape, Present):
        return _found(kind == "VOID", path, "MISSING")
    text = F.try_variant_get(value, "$", "string")
    if isinstance(shape, OneOf):
        return _found((kind != "STRING") | ~text.isin(*shape.values), path, "ENUM")
    return _found((kind != "STRING") | (strip(text) == "") | ((F.length(text) > shape.most) if shape.most else F.lit(False)), path, "TEXT")


def _list(items: Column, shape: Many, path: Column) -> Column:
    """items: null where the value is no list."""
    size = F.size(items)
    wrong = ((size > shape.most) if shape.most is not None else F.lit(False)) | (size < shape.least)
    rows = F.concat(_found(items.isNull(), path, "LIST"), _found(items.isNotNull() & wrong, path, "SIZE"))
    if shape.item is None:
        return rows
    item = shape.item
    inner = F.flatten(F.transform(items, lambda x, i: departures(x, item, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
    return F.concat(rows, F.coalesce(inner, F.array().cast(FOUND)))


def _object(fields: Column, shape: Object, path: Column) -> Column:
    """fields: null where the value is no object."""
    parts = [departures(F.try_element_at(fields, F.lit(n)), s, F.concat(F.when(path == "", "").otherwise(F.concat(path, F.lit("."))), F.lit(n))) for n, s in shape.fields.items()]
    if shape.exact:
        more = F.array_except(F.map_keys(fields), F.array(*[F.lit(n) for n in shape.fields]))
        parts.append(_found(F.size(more) > 0, path, "UNKNOWN_FIELD"))
    return F.when(fields.isNotNull(), F.concat(*parts)).otherwise(F.array(F.struct(path.alias("field"), F.lit("OBJECT").alias("problem"))))


def parsed(c: Column) -> Column:
    """The JSON of an answer, without the fence that models put around it."""
    return F.try_parse_json(strip(F.regexp_replace(strip(c), r"(?s)^```[^\n]*\n(.*?)(?:```)?$", "$1")))


def result_problems(df: DataFrame, key: str, column: str, shape: Shape) -> DataFrame:
    """key, field, problem: departures of each result from its contract; a result that is no JSON is no object."""
    return df.select(key, parsed(F.col(column)).alias("_v")).select(key, F.explode(departures(F.col("_v"), shape, F.lit(""))).alias("_x")).select(key, "_x.*")


def _texts(items: Column) -> Column:
    return F.coalesce(items, F.array().cast("array<string>"))


def _said(items: Column, name: str) -> Column:
    return F.transform(items, lambda x: strip(F.try_variant_get(x, f"$.{name}", "string")))


def customer_problems(df: DataFrame, key: str, column: str, allowed: str, graph: str) -> DataFrame:
    """result_problems of a customer's result, and what its evidence stands against.

    allowed and graph are columns of references: those that may be cited, and those of graph relations among them. Questions
    don't repeat; cited evidence is allowed; an assessment of the graph cites graph relations only, says NOT_AVAILABLE just
    where there are none, cites some unless it brings nothing new, and where it does, a finding cites one too.
    """
    rows = df.select(key, F.col(allowed).alias("_a"), F.array_intersect(graph, allowed).alias("_g"), parsed(F.col(column)).alias("_v"))
    v = F.col("_v")
    objects = {n: F.try_variant_get(v, f"$.{n}", "array<variant>") for n in ("findings", "followUpQuestions")}
    cited = _texts(F.flatten(F.transform(objects["findings"], lambda x: _texts(F.try_variant_get(x, "$.evidenceRefs", "array<string>")))))
    shown = _texts(F.try_variant_get(v, "$.graphAssessment.evidenceRefs", "array<string>"))
    brings = F.try_variant_get(v, "$.graphAssessment.contribution", "string")
    rows_of = [departures(v, CUSTOMER, F.lit(""))]
    for name in ("id", "question"):
        said = _said(objects["followUpQuestions"], name)
        rows_of.append(_found(F.size(F.array_distinct(said)) < F.size(said), F.lit(f"followUpQuestions.{name}"), "REPEATED"))
    rows_of.append(_found(F.size(F.array_except(cited, F.col("_a"))) > 0, F.lit("findings.evidenceRefs"), "NOT_ALLOWED"))
    at, none = F.lit("graphAssessment"), F.size("_g") == 0
    rows_of.append(_found(F.size(F.array_except(shown, F.col("_g"))) > 0, at, "NOT_GRAPH_EVIDENCE"))
    rows_of.append(_found(none & (brings != "NOT_AVAILABLE"), at, "GRAPH_NOT_AVAILABLE"))
    rows_of.append(_found(~none & (brings == "NOT_AVAILABLE"), at, "GRAPH_AVAILABLE"))
    rows_of.append(_found(~none & brings.isin("INCREMENTAL", "CONFIRMATORY") & (F.size(shown) == 0), at, "NO_EVIDENCE"))
    rows_of.append(_found(~none & (brings == "INCREMENTAL") & ~F.arrays_overlap(cited, F.col("_g")), at, "NO_FINDING"))
    return rows.select(key, F.explode(F.concat(*rows_of)).alias("_x")).select(key, "_x.*")
