"""Product metadata: which products fit the terms of a query, and which documents they have."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms with a meaning of their own.
GENERIC = ("产品", "理财", "理财产品", "产品知识")
SUITABILITY = ("保守型", "稳健型", "平衡型", "成长型", "进取型")
RISKS = {"低风险": ("PR1", "PR2"), "中低风险": ("PR1", "PR2", "PR3")}
TEXTS = ("product_name", "product_category", "income_type", "operation_mode", "term_type", "liquidity_rule", "target_customer", "eligibility_conditions")


def term_match(term: Column) -> Column:
    """recognized, matched, contradicted of a term against a product's columns; what no rule knows counts only where it occurs."""
    text = F.lower(F.concat_ws("\n", *TEXTS))
    years = [F.regexp_extract(term, r"^(\d+)\s*[-~至]\s*(\d+)年$", i).try_cast("int") * 365 for i in (1, 2)]
    income, yes, no = F.coalesce("income_type", F.lit("")), F.lit(True), F.lit(False)

    def verdict(matched: Column, against: Column = no) -> Column:
        return F.struct(yes.alias("recognized"), F.coalesce(matched, no).alias("matched"), F.coalesce(against, no).alias("contradicted"))

    ignored = F.struct(no.alias("recognized"), no.alias("matched"), no.alias("contradicted"))
    safe, fixed = income.contains("保本") & ~income.contains("非保本"), ~income.contains("浮动") & income.rlike("固定|保证|确定")
    out = F.when(term.isin(*GENERIC), ignored).when(years[0].isNotNull(), verdict(F.col("term_days").between(*years))).when(term.isin(*SUITABILITY), verdict(F.coalesce("eligibility_conditions", F.lit("")).contains(term)))
    for name, levels in RISKS.items():
        out = out.when(term == name, verdict(F.upper("risk_level").isin(*levels)))
    out = out.when(term.isin("固收", "固收类"), verdict(F.col("product_category").rlike("固定收益|固收")))
    out = out.when(term.isin("本金安全", "保本"), verdict(safe, income.contains("非保本"))).when(term.isin("确定性收益", "确定收益"), verdict(fixed, income.contains("浮动")))
    return out.otherwise(F.when(text.contains(term), verdict(yes)).otherwise(ignored))


def scored(products: DataFrame, queries: list[str]) -> DataFrame:
    """products with recognized, score and contradicted over all terms of the queries. Terms come from the caller, so they are literals, not a join."""
    terms = [r for r in dict.fromkeys(t for q in queries for t in _split(q))]
    zero, no = F.lit(0), F.lit(False)
    hits = [term_match(F.lit(t)) for t in terms]
    total = lambda field: reduce(lambda a, b: a + b, [h[field].cast("int") for h in hits], zero)
    return products.withColumn("recognized", total("recognized")).withColumn("score", total("matched")).withColumn("contradicted", reduce(lambda a, b: a | b, [h["contradicted"] for h in hits], no))


def _split(query: str) -> list[str]:
    return [t for t in re.split(r"[\s,，;；、|/]+", query.lower()) if t]


def selected(products: DataFrame, queries: list[str]) -> DataFrame:
    """Products that fit, by score and id."""
    return fitting(scored(products, queries)).orderBy(F.desc("score"), "product_id")


def fitting(rows: DataFrame) -> DataFrame:
    """Of scored products all if no term is known to any, else those without contradiction that match, else those that match at all, with `issue`."""
    seen = rows.agg(F.max("recognized").alias("_seen"), F.max((~F.col("contradicted") & (F.col("score") > 0)).cast("int")).alias("_good"))
    rows = rows.crossJoin(F.broadcast(seen))  # one row
    free = F.col("_seen") == 0
    keep = free | (F.col("score") > 0) & ((F.col("_good") == 0) | ~F.col("contradicted"))
    note = F.when(~free & (F.col("_good") == 0), "METADATA_PREFERENCE_FALLBACK")
    return rows.where(keep).withColumn("issue", note).drop("_seen", "_good")


def documents_of(products: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """document_id with its first product in order of position, and products without a document."""
    found = links.join(products.select("product_id", "position"), "product_id")
    first = found.groupBy("document_id").agg(F.min_by("product_id", F.struct("position", "product_id")).alias("product_id"))
    return first, products.join(links, "product_id", "left_anti")


