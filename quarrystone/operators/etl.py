"""Cells of staging records to typed facts: one row per fact with the cell's keys, in the order of the text.

Input rows have keys (owner ids, source) and a text column; output rows keep the keys. A text without a fact gives no row; the
issues that this calls for come from `quality_issues`. All rules are expressions: nothing here runs Python on rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import rules, text

MONEY = "decimal(20,4)"
#: Patterns of assets (category, type, pattern); the ratio is a percentage, the rest are amounts.
ASSETS = (
    ("TOTAL_ASSET", "TOTAL_ASSET", r"(?:个人)?总资产约?\s*([\d.]+)亿元"),
    ("EQUITY", "EQUITY", r"(?:企业)?股权(?:占比约?\d+%[；;，,]?\s*)?约?\s*([\d.]+)亿元"),
    ("INVESTABLE_FINANCIAL_ASSET", "OTHER", r"可投资金融资产约?\s*([\d.]+)亿元"),
    ("REAL_ESTATE", "REAL_ESTATE", r"不动产约?\s*([\d.]+)亿元"),
    ("MOVABLE_ASSET", "OTHER", r"(?:动产|艺术品收藏|私人飞机、游艇)约?\s*([\d.]+)亿元"),
    ("TOTAL_DEBT", "OTHER", r"(?:个人)?负债约?\s*([\d.]+)亿元"),
    ("LIQUID_ASSET_RATIO", "CASH", r"流动性资产占比约?\s*([\d.]+)%"),
)
#: Names of amounts and percentages in reports; of equal names the first pattern goes first.
AMOUNTS = (
    ("TOTAL_PREMIUM_INCOME", "总保费收入"), ("TOTAL_REVENUE", "(?:总营收|营收)"), ("NET_PROFIT", "归母净利润"), ("NET_PROFIT", "(?<!归母)净利润"), ("NET_PROFIT", "净亏损"), ("TOTAL_ASSETS", "总资产"),
    ("TOTAL_LIABILITIES", "总负债"), ("OPERATING_CASH_FLOW", "经营现金流"), ("CASH_RESERVES", "现金储备"), ("AUM", "管理资产规模"), ("OPERATING_PROFIT", "经营利润"), ("RND_EXPENSE", "研发投入"),
)
PERCENTS = (("GROSS_MARGIN", "毛利率"), ("NET_MARGIN", "净利率"), ("RND_RATIO", "研发投入占比"), ("OVERSEAS_REVENUE_RATIO", "海外收入占比"), ("INNOVATIVE_DRUG_REVENUE_RATIO", "创新药收入占比"))
#: Code points before a match in which its year is looked for.
BEFORE = 36


def exploded(df: DataFrame, keys: Sequence[str], rows: Column) -> DataFrame:
    """keys and the fields of an array of structs, with position; null structs are left out."""
    out = df.select(*keys, F.posexplode(F.array_compact(rows)).alias("position", "_x"))
    return out.select(*keys, "position", "_x.*")


def parts_of(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return df.select(*keys, F.posexplode(text.split_parts(F.col(column))).alias("position", "part"))


def assets(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """category, asset_type, amount or percentage: each pattern's first match. All are estimates."""
    rows = []
    for category, kind, pattern in ASSETS:
        value = text.found(F.col(column), pattern).try_cast(MONEY)
        ratio = pattern.endswith("%")
        none = F.lit(None).cast(MONEY)
        rows.append(F.when(value.isNotNull(), F.struct(F.lit(category).alias("category"), F.lit(kind).alias("asset_type"), (none if ratio else value).alias("amount"), (value if ratio else none).alias("percentage"), F.lit(True).alias("estimated"))))
    return exploded(df, keys, F.array(*rows))


def keyed_amounts(df: DataFrame, keys: Sequence[str], column: str, table: Sequence, wan: bool = False) -> DataFrame:
    """kind, amount, part: parts with a keyword and an amount in 100 millions, or in ten thousands if asked for."""
    rows = parts_of(df, keys, column)
    amount = text.amount_100m(F.col("part"))
    if wan:
        small = text.found(F.col("part"), r"([+-]?\d+(?:\.\d+)?)万元").try_cast("decimal(20,8)")
        amount = F.coalesce(amount.cast("decimal(24,8)"), (small / 10_000).cast("decimal(24,8)"))
    return rows.select(*keys, "position", text.first_rule(F.col("part"), table).alias("kind"), amount.alias("amount"), "part").where("kind is not null and amount is not null")


def holdings(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return keyed_amounts(df, keys, column, rules.HOLDINGS)


def financial_events(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return keyed_amounts(df, keys, column, rules.EVENTS)


def financial_events_again(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The second reading of cells whose first one left an issue: more keywords and a smaller unit."""
    return keyed_amounts(df, keys, column, rules.EVENTS_AGAIN, wan=True)


def risk_preference(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    c = F.col(column)

    def clause(start: str) -> Column:
        return text.strip(text.found(c, rf"{start}([^；;]+)"))

    level = F.coalesce(text.found(c, r"[（(](C[1-5])[）)]"), F.lit("UNKNOWN"))
    drawdown = text.found(c, r"最大回撤约?\s*(\d+(?:\.\d+)?)%").try_cast("decimal(9,4)")
    return df.select(*keys, level.alias("risk_level"), drawdown.alias("max_drawdown"), clause("投资期限偏好").alias("horizon"), clause("对流动性要求").alias("liquidity"), clause("实际投资偏").alias("actual"))


def services(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    rows = []
    for kind, name in (("PRIVATE_BANKING", "私银客户年限"), ("DEDICATED_MANAGER", "专属客户经理服务")):
        years = text.found(F.col(column), rf"{name}：?(\d+(?:\.\d+)?)年").try_cast("decimal(5,2)")
        rows.append(F.when(years.isNotNull(), F.struct(F.lit(kind).alias("service_type"), years.alias("years"))))
    return exploded(df, keys, F.array(*rows))


def notes(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    rows = parts_of(df, keys, column).withColumn("note_type", text.first_rule(F.col("part"), rules.NOTES, "GENERAL_NOTE"))
    return rows.select(*keys, "position", "note_type", F.col("part").contains("明确表示").alias("explicit"), "part")


def core_relation(registration: Column, name: Column) -> Column:
    """CHAIRPERSON only if the registration names the person as such."""
    return F.when(registration.contains(F.concat(F.lit("董事长："), name)), "CHAIRPERSON").otherwise("CORE_ASSOCIATED")


def career_title(c: Column) -> Column:
    return text.found(c, r"(?:现任|任)([^；;]{0,40}(?:董事长|CEO|首席执行官|总裁|创始人|合伙人))")


def business_lines(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Segments that introduce products are one line each, with what follows the colon; others give a line for each item."""
    rows = parts_of(df, keys, column)
    core = F.col("part").rlike("核心产品|核心服务")
    body = F.when(F.instr("part", "：") > 0, F.substring("part", F.instr("part", "：") + 1, F.length("part"))).otherwise(F.col("part"))
    items = F.when(core, F.array(text.strip(body))).otherwise(text.split_top_level(F.col("part")))
    return rows.select(*keys, "position", F.when(core, "CORE_PRODUCTS").otherwise("BUSINESS_LINE").alias("kind"), F.posexplode(items).alias("item", "line"))


def market_relations(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """relation, name for each item after a label and a colon of either width; bracketed remarks go."""
    rows = parts_of(df, keys, column)
    kind = F.lit(None).cast("string")
    for label, code in rules.MARKET:
        kind = F.when(F.col("part").rlike(rf"^{label}[^：:]*[：:]"), code).otherwise(kind)
    items = text.split_top_level(F.regexp_replace("part", r"^[^：:]*[：:]", ""))
    found = rows.select(*keys, "position", kind.alias("relation"), F.posexplode(items).alias("item", "raw")).where("relation is not null")
    return found.select(*keys, "position", "relation", "item", text.without_brackets(F.col("raw")).alias("name")).where("name <> ''")


def event_type(c: Column, kind: str) -> Column:
    """The type of an event's text. kind: POLICY, CAPITAL or OPERATING."""
    if kind == "POLICY":
        return text.first_rule(c, ((("政策导向",), "INDUSTRY_POLICY"),), "INDUSTRY_TREND")
    table = rules.ENTERPRISE_EVENTS if kind == "CAPITAL" else (*rules.ENTERPRISE_EVENTS, rules.CAPITAL)
    return text.first_rule(c, table, "CAPITAL_OPERATION" if kind == "CAPITAL" else "OPERATING_EVENT")


def enterprise_events(df: DataFrame, keys: Sequence[str], column: str, kind: str) -> DataFrame:
    """event_type, risk_level of each part; parts that say there is none are skipped. kind: POLICY, CAPITAL or OPERATING."""
    return enterprise_events_by(df, keys, column, {"event_type": kind})


def enterprise_events_by(df: DataFrame, keys: Sequence[str], column: str, kinds: Mapping[str, str]) -> DataFrame:
    """enterprise_events of several kinds (column of the type: kind) in one pass over the parts, which need no join."""
    rows = parts_of(df, keys, column).where(~F.col("part").startswith("无"))
    c = F.col("part")
    return rows.select(*keys, "position", *[event_type(c, kind).alias(name) for name, kind in kinds.items()], text.first_rule(c, rules.EVENT_RISK, "PENDING_VERIFICATION").alias("risk_level"), "part")


def family_members(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """relation, ordinal, name or alias of each labelled part. The ordinal counts the person's relations of a kind in order."""
    label, rest = text.strip(F.substring_index("part", "：", 1)), text.strip(F.substring("part", F.instr("part", "：") + 1, F.length("part")))
    table = F.create_map(*[F.lit(x) for kv in rules.FAMILY.items() for x in kv])
    rows = parts_of(df, keys, column).where(F.col("part").contains("：")).select(*keys, "position", F.try_element_at(table, label).alias("relation"), rest.alias("rest")).where("relation is not null")
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys, "relation").orderBy("position")))
    name = text.strip(F.regexp_extract("rest", r"(?s)^([^（(，,]*)", 1))
    hidden = (name == "") | name.isin("1人", "一人") | name.rlike("未公开|信息较少")
    return rows.select(*keys, "position", "relation", "ordinal", F.when(hidden, F.concat("relation", F.lit("_"), F.col("ordinal").cast("string"))).otherwise(name).alias("name"), hidden.alias("alias"))


def succession(c: Column) -> Column:
    return text.first_rule(c, rules.SUCCESSION, "PENDING_CONFIRMATION")


def governance(c: Column, kind: str) -> Column:
    return text.first_rule(c, rules.GOVERNANCE[kind])


def social_relations(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    rows = parts_of(df, keys, column)
    name, role = text.organization_and_role(F.col("part"), rules.ROLES)
    rows = rows.select(*keys, "position", name.alias("organization"), role.alias("role"))
    return rows.select("*", text.first_rule(F.col("organization"), rules.ORGANIZATIONS, "OTHER").alias("organization_type"), text.organization_key(F.col("organization")).alias("organization_key"))


def organizations(relations: DataFrame, order: str) -> DataFrame:
    """One organization per key with the name and type seen first, by a total order."""
    first = F.min(F.struct(order, "organization", "organization_type"))
    return relations.groupBy("organization_key").agg(first.alias("x")).select("organization_key", "x.organization", "x.organization_type")


def activities(df: DataFrame, keys: Sequence[str], column: str, kind: str) -> DataFrame:
    """activity_type, name of each part, once per person and text; charity that is about climate is ESG."""
    rows = parts_of(df, keys, column)
    kinds = text.first_rule(F.col("part"), (rules.ESG,), kind) if kind == "CHARITY_ESG" else F.lit(kind)
    return first_of(rows.select(*keys, "position", kinds.alias("activity_type"), F.substring("part", 1, 255).alias("name")), [*keys, "activity_type", "name"])


def reputations(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    c = F.col("part")
    return parts_of(df, keys, column).select(*keys, "position", text.first_rule(c, rules.REPUTATION, "HONOR_OR_PUBLIC_EVALUATION").alias("reputation_type"), text.first_rule(c, rules.PUBLISHERS).alias("publisher"), F.substring(c, 1, 500).alias("title"))


def reputation_risks(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    c = F.col("part")
    rows = parts_of(df, keys, column).where(~c.startswith("无"))
    return rows.select(*keys, "position", F.substring(c, 1, 255).alias("topic"), text.first_rule(c, rules.REPUTATION_RISK, "PENDING_VERIFICATION").alias("risk_level"))


def first_of(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First row of each key in the order of position."""
    w = Window.partitionBy(*keys).orderBy("position")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def matches(c: Column, name: str, rest: str) -> Column:
    """All matches of name and rest: period (the last year before the match, else 2025), the groups of rest as text, and the match.

    Most texts hold few of the names, so whether there is a match comes first. What stands before matches is cut from the text by its
    place, as looking back from every place costs far more.
    """
    pattern, groups = rf"(?s){name}{rest}", rf"(?s)({name}{rest})"
    both = F.struct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("found"), F.split(c, pattern).alias("between"))

    def row(b: Column, m: Column, i: Column) -> Column:
        start = F.length(F.array_join(F.slice(b["between"], F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(b["found"], F.lit(1), i), ""))
        before = F.substring(c, F.greatest(start - BEFORE, F.lit(0)) + 1, F.least(start, F.lit(BEFORE)))
        year = F.regexp_extract(before, r"(?s)^.*(20\d{2})年", 1)
        return F.struct(F.when(year == "", "2025").otherwise(year).alias("period"), m.alias("all"), F.regexp_extract(m, groups, 2).alias("value"), F.regexp_extract(m, groups, 3).alias("unit"))

    rows = F.flatten(F.transform(F.array(both), lambda b: F.transform(b["found"], lambda m, i: row(b, m, i))))  # in a lambda both are computed once
    return F.when(c.rlike(pattern), rows).otherwise(F.array().cast("array<struct<period:string,all:string,value:string,unit:string>>"))


def financial_metrics(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """metric, period, value, unit: all amounts, the first of each period and metric, then all percentages. A net loss is a negative profit."""
    c, rows = F.col(column), []
    for metric, name in AMOUNTS:
        found = matches(c, name, r"(?:约|超|估算)?\s*([+-]?\d+(?:\.\d+)?)\s*(万亿美元|亿美元|万亿元|亿元)")

        def fact(m: Column, metric: str = metric) -> Column:
            value, unit = text.scaled_amount(m["value"], m["unit"])
            return F.struct(F.lit(metric).alias("metric"), m["period"].alias("period"), F.when(m["all"].contains("净亏损"), -F.abs(value)).otherwise(value).alias("value"), unit.alias("unit"), F.lit(True).alias("once"))

        rows.append(F.transform(found, _unary(fact)))
    for metric, name in PERCENTS:
        found = matches(c, name, r"(?:约|超)?\s*([+-]?\d+(?:\.\d+)?)(%)")

        def share(m: Column, metric: str = metric) -> Column:
            return F.struct(F.lit(metric).alias("metric"), m["period"].alias("period"), m["value"].cast("decimal(28,4)").alias("value"), F.lit("PERCENT").alias("unit"), F.lit(False).alias("once"))

        rows.append(F.transform(found, _unary(share)))
    facts = exploded(df, keys, F.flatten(F.array(*rows)))
    first = F.row_number().over(Window.partitionBy(*keys, "metric", "period", "once").orderBy("position"))
    return facts.withColumn("_n", first).where("not once or _n = 1").drop("_n", "once")


def _unary(f):
    """f with its first argument alone, as Spark counts a lambda's parameters."""
    return lambda m: f(m)


def quality_issues(cells: DataFrame, keys: Sequence[str], facts: DataFrame, code: str, severity: str) -> DataFrame:
    """An issue for each cell without any fact."""
    return cells.select(*keys).join(facts.select(*keys).distinct(), list(keys), "left_anti").select(*keys, F.lit(code).alias("issue"), F.lit(severity).alias("severity"), F.lit("OPEN").alias("status"))


def resolved(issues: DataFrame, keys: Sequence[str], facts: DataFrame) -> DataFrame:
    """Issues, RESOLVED where a later reading found a fact."""
    found = facts.select(*keys).distinct().withColumn("_found", F.lit(True))
    return issues.join(found, list(keys), "left").withColumn("status", F.when(F.col("_found"), "RESOLVED").otherwise(F.col("status"))).drop("_found")


def upgraded_relation(evidence: Column) -> Column:
    """FOUNDER before CHAIRPERSON before CONTROLLING_SHAREHOLDER; null leaves the relation unresolved."""
    return text.first_rule(evidence, rules.CONTROL)
