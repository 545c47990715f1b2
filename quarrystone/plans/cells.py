"""Cells of records, made from the driver's tables, through the ETL operators. The SQL says what each cell holds, not how it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import text
from quarrystone.operators import etl as E
from quarrystone.plans.registry import query
from quarrystone.sources.tables import spread, table

KEYS = ["p_partkey"]


def cells(spark: SparkSession, d: str, *pieces: str | Column) -> DataFrame:
    """p_partkey, p_size, cell: pieces of a cell, with {s} for the part's size."""
    size = F.col("p_size").cast("string")
    made = [F.replace(F.lit(p), F.lit("{s}"), size) if isinstance(p, str) else p for p in pieces]
    return spread(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", "p_size", F.concat(*made).alias("cell"))


def union(*rows: str, where: str = "") -> str:
    """SQL of rows made from each part."""
    return " UNION ALL ".join(f"SELECT p_partkey, {r.partition(' IF ')[0]} FROM part{f' WHERE {r.partition(" IF ")[2]}' if ' IF ' in r else where}" for r in rows)


@query(
    "etl_assets",
    f"""SELECT p_partkey, category, asset_type, CAST(amount AS DOUBLE) AS amount, CAST(percentage AS DOUBLE) AS percentage FROM ({union(
        "'TOTAL_ASSET' AS category, 'TOTAL_ASSET' AS asset_type, CAST(p_size AS DOUBLE) AS amount, NULL::DOUBLE AS percentage",
        "'EQUITY', 'EQUITY', p_size + 1, NULL", "'INVESTABLE_FINANCIAL_ASSET', 'OTHER', p_size + 0.5, NULL",
        "'TOTAL_DEBT', 'OTHER', 2, NULL IF p_partkey % 2 = 1", "'LIQUID_ASSET_RATIO', 'CASH', NULL, p_size")})""",
)
def etl_assets(spark: SparkSession, d: str) -> DataFrame:
    debt = F.when(F.col("p_partkey") % 2 == 1, "负债约2亿元；").otherwise("")
    rows = cells(spark, d, "个人总资产约 {s}亿元；企业股权占比约30%；约", (F.col("p_size") + 1).cast("string"), "亿元；可投资金融资产{s}.5亿元；", debt, "流动性资产占比约{s}%")
    found = E.assets(rows, KEYS, "cell")
    return found.select("p_partkey", "category", "asset_type", F.col("amount").cast("double").alias("amount"), F.col("percentage").cast("double").alias("percentage"))


@query("etl_holdings", union("'CASH' AS kind, 3.0::DOUBLE AS amount, 0 AS position", "'FIXED_INCOME', p_size::DOUBLE, 1", "'PRIVATE_EQUITY', p_size + 0.25, 3"))
def etl_holdings(spark: SparkSession, d: str) -> DataFrame:
    """A part needs a keyword and an amount."""
    found = E.holdings(cells(spark, d, "现金管理类3亿元；债券{s}亿元；权益类若干；私募{s}.25亿元；其他9亿元"), KEYS, "cell")
    return found.select("p_partkey", "kind", F.col("amount").cast("double").alias("amount"), "position")


@query("etl_financial_events", union("'DIVESTMENT' AS kind, p_size::DOUBLE AS amount, 0 AS position", "'INVESTMENT', 2.5, 1", "'DONATION', 0.5, 3"))
def etl_financial_events(spark: SparkSession, d: str) -> DataFrame:
    found = E.financial_events(cells(spark, d, "减持股份{s}亿元；追加资金2.5亿元；投资意向；捐赠0.5亿元；分红7亿元"), KEYS, "cell")
    return found.select("p_partkey", "kind", F.col("amount").cast("double").alias("amount"), "position")


@query("etl_events_again", union("'DIVIDEND_INCOME' AS kind, p_size::DOUBLE AS amount, 0 AS position", "'INVESTMENT', round(p_size / 10000.0, 8), 1", "'ASSET_RESTRUCTURING', 4, 3"))
def etl_events_again(spark: SparkSession, d: str) -> DataFrame:
    """Amounts in ten thousands count as well."""
    found = E.financial_events_again(cells(spark, d, "分红{s}亿元；购买股票{s}万元；偿还贷款；资产置换4亿元"), KEYS, "cell")
    return found.select("p_partkey", "kind", F.col("amount").cast("double").alias("amount"), "position")


@query(
    "etl_risk_preference",
    """SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN 'UNKNOWN' ELSE concat('C', p_partkey % 6 % 5 + 1) END AS risk_level, CAST(p_size + 0.5 AS DOUBLE) AS max_drawdown, '长期' AS horizon, '较高' AS liquidity, '稳健' AS actual FROM part""",
)
def etl_risk_preference(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    level = F.when(k == 5, "（D9）").otherwise(F.concat(F.lit("（C"), (k % 5 + 1).cast("string"), F.lit("）")))
    found = E.risk_preference(cells(spark, d, "进取型", level, "，最大回撤约{s}.5%；投资期限偏好长期；对流动性要求 较高 ；实际投资偏稳健"), KEYS, "cell")
    return found.withColumn("max_drawdown", F.col("max_drawdown").cast("double"))


@query("etl_services", union("'PRIVATE_BANKING' AS service_type, p_size::DOUBLE AS years", "'DEDICATED_MANAGER', 3.5 IF p_partkey % 2 = 0"))
def etl_services(spark: SparkSession, d: str) -> DataFrame:
    manager = F.when(F.col("p_partkey") % 2 == 0, "；专属客户经理服务3.5年").otherwise("；专属客户经理服务")
    found = E.services(cells(spark, d, "私银客户年限：{s}年", manager), KEYS, "cell")
    return found.select("p_partkey", "service_type", F.col("years").cast("double").alias("years"))


@query("etl_notes", union("0 AS position, 'EXPLICIT_NEED' AS note_type, true AS explicit", "1, 'PREFERENCE', false", "2, 'COMMUNICATION_STYLE', false", "3, 'GENERAL_NOTE', false"))
def etl_notes(spark: SparkSession, d: str) -> DataFrame:
    return E.notes(cells(spark, d, "客户明确表示偏好{s}号产品；喜欢沟通；多为电话沟通；其他"), KEYS, "cell").select("p_partkey", "position", "note_type", "explicit")


@query(
    "etl_titles",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'CHAIRPERSON' ELSE 'CORE_ASSOCIATED' END AS relation, CASE WHEN s_suppkey % 3 > 0 THEN concat(s_name, '董事长') END AS title,
    CASE s_suppkey % 4 WHEN 0 THEN 'FOUNDER' WHEN 1 THEN 'CHAIRPERSON' WHEN 2 THEN 'CONTROLLING_SHAREHOLDER' END AS upgraded, CASE WHEN s_suppkey % 2 = 0 THEN 12.5 END AS share FROM supplier""",
)
def etl_titles(spark: SparkSession, d: str) -> DataFrame:
    """The core relation of a registration, a career's title, the upgrade by evidence, and shares held by name."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    registration = F.concat(F.lit("法定代表人：某甲；董事长："), F.when(k % 2 == 0, name).otherwise("某乙"))
    career = F.concat(F.when(k % 3 > 0, "现任").otherwise("曾在"), name, F.lit("董事长；其他"))
    evidence = F.when(k % 4 == 0, "董事长兼创始人").when(k % 4 == 1, "任董事长").when(k % 4 == 2, "绝对控制").otherwise("无")
    held = F.concat(F.lit("股东结构："), F.when(k % 2 == 0, name).otherwise("某乙"), F.lit("持股约12.5%"))
    rows = table(spark, d, "supplier").withColumn("held", held)
    return rows.select("s_suppkey", E.core_relation(registration, name).alias("relation"), E.career_title(career).alias("title"), E.upgraded_relation(evidence).alias("upgraded"), text.share_of("held", "s_name").cast("double").alias("share"))


@query("etl_business_lines", union("0 AS position, 'CORE_PRODUCTS' AS kind, 0 AS item, concat('甲', p_size, '、乙') AS line", "1, 'BUSINESS_LINE', 0, '云计算（含存储、网络）'", "1, 'BUSINESS_LINE', 1, concat('广告', p_size)"))
def etl_business_lines(spark: SparkSession, d: str) -> DataFrame:
    return E.business_lines(cells(spark, d, "核心产品：甲{s}、乙；云计算（含存储、网络）、广告{s}"), KEYS, "cell")


@query("etl_market_relations", union("0 AS position, 'UPSTREAM' AS relation, 0 AS item, concat('甲', p_size) AS name", "0, 'UPSTREAM', 1, '乙'", "1, 'COMPETITOR', 0, '丙'", "1, 'COMPETITOR', 1, '丁'"))
def etl_market_relations(spark: SparkSession, d: str) -> DataFrame:
    return E.market_relations(cells(spark, d, "上游供应商：甲{s}（主要）、乙；竞争对手:丙，丁（海外）；其他：戊"), KEYS, "cell")


@query(
    "etl_enterprise_events",
    union("0 AS position, 'REGULATORY_OR_LEGAL' AS operating, 'REGULATORY_OR_LEGAL' AS capital, 'INDUSTRY_TREND' AS policy, 'MEDIUM' AS risk", "1, 'CORPORATE_GOVERNANCE', 'CORPORATE_GOVERNANCE', 'INDUSTRY_TREND', 'PENDING_VERIFICATION'", "2, 'CAPITAL_OPERATION', 'CAPITAL_OPERATION', 'INDUSTRY_TREND', 'PENDING_VERIFICATION'", "3, 'OPERATING_EVENT', 'CAPITAL_OPERATION', 'INDUSTRY_POLICY', 'PENDING_VERIFICATION'"),
)
def etl_enterprise_events(spark: SparkSession, d: str) -> DataFrame:
    rows = cells(spark, d, "第{s}次被监管处罚；董事长连任；完成回购；政策导向明确；无重大事件")
    found = E.enterprise_events_by(rows, KEYS, "cell", {"operating": "OPERATING", "capital": "CAPITAL", "policy": "POLICY"})
    return found.select("p_partkey", "position", "operating", "capital", "policy", F.col("risk_level").alias("risk"))


@query(
    "etl_family_members",
    union("0 AS position, 'SON' AS relation, 1 AS ordinal, concat('张', p_size) AS name, false AS alias", "1, 'SON', 2, 'SON_2', true", "2, 'DAUGHTER', 1, 'DAUGHTER_1', true", "4, 'SPOUSE', 1, '王某', false"),
)
def etl_family_members(spark: SparkSession, d: str) -> DataFrame:
    return E.family_members(cells(spark, d, "儿子：张{s}（留学），在读；儿子：姓名未公开；女儿：1人；朋友：李某；妻子：王某，教师；备注"), KEYS, "cell").drop("rest")


@query(
    "etl_succession",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'NO_FORMAL_SUCCESSOR' WHEN 1 THEN 'SUCCESSOR_IDENTIFIED' ELSE 'PENDING_CONFIRMATION' END AS succession,
    CASE p_partkey % 3 WHEN 0 THEN 'EDUCATION_TRUST_AND_INSURANCE' WHEN 1 THEN 'INSURANCE_PROTECTION' END AS protection,
    CASE p_partkey % 3 WHEN 0 THEN 'FAMILY_TRUST' WHEN 2 THEN 'WILL_AND_INHERITANCE_PLAN' END AS wealth, CASE p_partkey % 3 WHEN 0 THEN 'PROFESSIONAL_MANAGER_GOVERNANCE' WHEN 1 THEN 'FAMILY_GOVERNANCE' END AS corporate FROM part""",
)
def etl_succession(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    cell = F.when(k == 0, "暂无明确接班人；教育信托与保险；聘请职业经理人，家族监督").when(k == 1, "已确定由长子接班；保险；家族治理").otherwise("商讨中；已立遗嘱")
    return table(spark, d, "part").select("p_partkey", E.succession(cell).alias("succession"), *[E.governance(cell, kind.upper()).alias(kind) for kind in ("protection", "wealth", "corporate")])


@query(
    "etl_social",
    union("0 AS position, concat('第', p_size, '慈善基金会') AS organization, '名誉会长' AS role, 'FOUNDATION' AS organization_type, concat('第', p_size, '慈善基金会') AS organization_key", "1, '某 大学', '校董', 'ACADEMIC', '某大学'", "2, 'A.B·C俱乐部', NULL, 'INDUSTRY_ASSOCIATION', 'abc俱乐部'", "3, '其他', '理事', 'OTHER', '其他'"),
)
def etl_social(spark: SparkSession, d: str) -> DataFrame:
    return E.social_relations(cells(spark, d, "第{s}慈善基金会（深圳）名誉会长；某 大学校董；A.B·C俱乐部；其他理事"), KEYS, "cell")


@query("etl_organizations", """SELECT DISTINCT concat('第', p_size, '慈善基金会') AS organization_key, concat('第', p_size, '慈善基金会') AS organization, 'FOUNDATION' AS organization_type FROM part UNION ALL SELECT 'a商会', 'A 商会', 'INDUSTRY_ASSOCIATION' FROM part HAVING count(*) > 0""")
def etl_organizations(spark: SparkSession, d: str) -> DataFrame:
    """One organization for each key, named as its first row does."""
    rows = E.social_relations(cells(spark, d, "第{s}慈善基金会理事；A 商会会长；a·商会会长"), KEYS, "cell")
    return E.organizations(rows.withColumn("order", F.col("p_partkey") * 10 + F.col("position")), "order")


@query(
    "etl_reputation",
    union("0 AS position, 'HONOR_OR_PUBLIC_EVALUATION' AS reputation_type, 'FORBES' AS publisher, concat('登上福布斯榜第', p_size) AS title", "1, 'MEDIA_ATTENTION', NULL, '媒体关注度高'", "2, 'HONOR_OR_PUBLIC_EVALUATION', 'CCTV', '接受CCTV采访'"),
)
def etl_reputation(spark: SparkSession, d: str) -> DataFrame:
    return E.reputations(cells(spark, d, "登上福布斯榜第{s}；媒体关注度高；接受CCTV采访"), KEYS, "cell")


@query("etl_activities", union("0 AS position, 'CHARITY_ESG' AS kind, concat('捐建第', p_size, '所学校') AS name, NULL AS risk", "1, 'ESG', '碳中和基金', NULL", "0, 'RISK', '旧案被调查', 'MEDIUM'", "1, 'RISK', '网络争议', 'PENDING_VERIFICATION'"))
def etl_activities(spark: SparkSession, d: str) -> DataFrame:
    """Charity, where climate is a kind of its own and repeated parts count once; and risks, but not the mention of none."""
    good = E.activities(cells(spark, d, "捐建第{s}所学校；碳中和基金；捐建第{s}所学校"), KEYS, "cell", "CHARITY_ESG")
    risks = E.reputation_risks(cells(spark, d, "旧案被调查；网络争议；无其他"), KEYS, "cell")
    a = good.select("p_partkey", "position", F.col("activity_type").alias("kind"), "name", F.lit(None).cast("string").alias("risk"))
    return a.unionByName(risks.select("p_partkey", "position", F.lit("RISK").alias("kind"), F.col("topic").alias("name"), F.col("risk_level").alias("risk")))


@query(
    "etl_metrics",
    union("'TOTAL_REVENUE' AS metric, '2023' AS period, p_size::DOUBLE AS value, 'CNY_100M' AS unit", "'NET_PROFIT', '2023', 3, 'CNY_100M'", "'NET_PROFIT', '2024', -1.5, 'USD_100M'", "'TOTAL_ASSETS', '2024', 20000, 'CNY_100M'", "'GROSS_MARGIN', '2024', 35.5, 'PERCENT'"),
)
def etl_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The year before an amount is its period; the first amount of a metric and period counts; a loss is negative."""
    found = E.financial_metrics(cells(spark, d, "2023年总营收约{s}亿元，净利润3亿元，净利润4亿元；2024年净亏损1.5亿美元，毛利率约35.5%，总资产2万亿元"), KEYS, "cell")
    return found.select("p_partkey", "metric", "period", F.col("value").cast("double").alias("value"), "unit")


@query("etl_issues", """SELECT p_partkey, 'NO_ASSET' AS issue, 'WARNING' AS severity, CASE WHEN p_partkey % 3 = 1 THEN 'RESOLVED' ELSE 'OPEN' END AS status FROM part WHERE p_partkey % 3 > 0""")
def etl_issues(spark: SparkSession, d: str) -> DataFrame:
    """A cell without a fact is an issue, until a second reading finds one."""
    k = F.col("p_partkey") % 3
    rows = cells(spark, d, F.when(k == 0, "总资产约1亿元").when(k == 1, "购买股票{s}万元").otherwise("无数据"))
    issues = E.quality_issues(rows, KEYS, E.assets(rows, KEYS, "cell"), "NO_ASSET", "WARNING")
    return E.resolved(issues, KEYS, E.financial_events_again(rows.withColumn("cell", F.replace("cell", F.lit("{s}"), F.lit("5"))), KEYS, "cell"))


@query(
    "text_keys",
    """SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1950 + p_size END AS DOUBLE) AS year, CAST(p_size * 1000 + 0.25 AS DOUBLE) AS number, CASE WHEN p_partkey % 3 = 0 THEN '0700.HK' END AS stock,
    concat('a', p_size, 'b') AS person, concat('某', p_size, 'co公司') AS organization FROM part""",
)
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    """Years of two centuries, grouped numbers, exchange codes in brackets, and what names are matched by."""
    k, s = F.col("p_partkey"), F.col("p_size")
    year = F.concat(F.lit("生于"), F.when(k % 2 == 0, 1950 + s).otherwise(1750 + s).cast("string"), F.lit("年"))
    number = F.concat(F.lit("共 "), s.cast("string"), F.lit(",000.25 股"))
    stock = F.when(k % 3 == 0, "腾讯（0700.hk）").otherwise("腾讯0700.hk")
    names = F.concat(F.lit(" A　"), s.cast("string"), F.lit(" b ")), F.concat(F.lit("某·"), s.cast("string"), F.lit("（Co）、公司。"))
    return table(spark, d, "part").select("p_partkey", text.parse_year(year).cast("double").alias("year"), text.parse_decimal(number).cast("double").alias("number"), text.parse_stock_code(stock).alias("stock"), text.name_key(names[0]).alias("person"), text.organization_key(names[1]).alias("organization"))
