"""Text of records to facts: rule tables, amounts, dates, keys, and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import records, rules, security, strict, text
from quarrystone.plans.registry import query
from quarrystone.sources.tables import table


def case(column: str, table_: tuple, default: str = "NULL") -> str:
    """SQL of an ordered rule table."""
    whens = " ".join("WHEN " + " OR ".join(f"contains({column}, '{k}')" for k in keys) + f" THEN '{code}'" for keys, code in table_)
    return f"CASE {whens} ELSE {default} END"


def sentence() -> Column:
    """A sentence of a record made from an event."""
    words = F.create_map(*[F.lit(x) for x in ("click", "客户重点关注养老规划", "purchase", "追加投资", "error", "赎回部分产品", "signup", "通过电话沟通", "view", "偏好稳健")])
    return F.concat(F.try_element_at(words, F.col("event_type")), F.format_string("，金额%.2f亿元；", F.col("value")))


SENTENCE = """CASE event_type WHEN 'click' THEN '客户重点关注养老规划' WHEN 'purchase' THEN '追加投资' WHEN 'error' THEN '赎回部分产品' WHEN 'signup' THEN '通过电话沟通' WHEN 'view' THEN '偏好稳健' END"""


@query(
    "rule_event_type",
    f"""WITH t AS (SELECT event_id, {SENTENCE} AS s FROM events) SELECT event_id, {case("s", rules.EVENTS)} AS event_type, {case("s", rules.EVENTS_AGAIN)} AS again, {case("s", rules.NOTES, "'GENERAL_NOTE'")} AS note FROM t""",
)
def rule_event_type(spark: SparkSession, d: str) -> DataFrame:
    """First keyword of each ordered table."""
    rows = table(spark, d, "events").select("event_id", sentence().alias("s"))
    s = F.col("s")
    return rows.select("event_id", text.first_rule(s, rules.EVENTS).alias("event_type"), text.first_rule(s, rules.EVENTS_AGAIN).alias("again"), text.first_rule(s, rules.NOTES, "GENERAL_NOTE").alias("note"))


@query(
    "kv_parse",
    """SELECT p_partkey, p_brand AS brand, CAST(p_size + 1 AS VARCHAR) AS size, '3' AS keys FROM part""",
)
def kv_parse(spark: SparkSession, d: str) -> DataFrame:
    """key：value parts; a later key overwrites an earlier one."""
    cell = F.concat(F.lit("品牌："), F.col("p_brand"), F.lit("； 尺寸："), F.col("p_size").cast("string"), F.lit(";无值;类型："), F.col("p_type"), F.lit("；尺寸： "), (F.col("p_size") + 1).cast("string"))
    rows = table(spark, d, "part").select("p_partkey", text.key_values(cell).alias("m"))
    return rows.select("p_partkey", F.col("m")["品牌"].alias("brand"), F.col("m")["尺寸"].alias("size"), F.size("m").cast("string").alias("keys"))


@query(
    "split_explode",
    """SELECT p_partkey, CAST(i AS INTEGER) AS position, trim(w) AS word FROM (SELECT p_partkey, unnest(string_split(concat(p_name, ' ', p_type), ' ')) AS w, generate_subscripts(string_split(concat(p_name, ' ', p_type), ' '), 1) - 1 AS i FROM part)""",
)
def split_explode(spark: SparkSession, d: str) -> DataFrame:
    """Parts between separators at bracket depth 0; what is in brackets stays together."""
    line = F.replace(F.concat_ws(" ", "p_name", "p_type"), F.lit(" "), F.lit("、"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(text.split_top_level(line)).alias("position", "word"))


@query(
    "bracketed_parts",
    """SELECT p_partkey, concat(p_brand, '（', p_size, '、a）') AS first_part, p_name AS second_part FROM part""",
)
def bracketed_parts(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.col("p_brand"), F.lit("（"), F.col("p_size").cast("string"), F.lit("、a）、 "), F.col("p_name"))
    parts = text.split_top_level(line, "、")
    return table(spark, d, "part").select("p_partkey", F.try_element_at(parts, F.lit(1)).alias("first_part"), F.try_element_at(parts, F.lit(2)).alias("second_part"))


@query(
    "amount_scale",
    """SELECT o_orderkey, CAST(CAST(round(o_totalprice, 2) AS DECIMAL(20,4)) * CASE WHEN o_orderkey % 2 = 0 THEN 10000 ELSE 1 END AS DOUBLE) AS amount,
    CASE WHEN o_orderkey % 3 = 0 THEN 'USD_100M' ELSE 'CNY_100M' END AS unit FROM orders""",
)
def amount_scale(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    unit = F.concat(F.when(k % 2 == 0, "万亿").otherwise("亿"), F.when(k % 3 == 0, "美元").otherwise("元"))
    amount, code = text.scaled_amount(F.round("o_totalprice", 2), unit)
    return table(spark, d, "orders").select("o_orderkey", amount.cast("double").alias("amount"), code.alias("unit"))


@query(
    "money_parse",
    """SELECT p_partkey, (CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS DECIMAL(20,6)) * 100000000 WHEN 1 THEN CAST(p_size AS DECIMAL(20,6)) * 10000 WHEN 2 THEN CAST(p_size AS DECIMAL(20,6)) * 1000000 END)::DOUBLE AS amount,
    CASE p_partkey % 6 WHEN 0 THEN 'CNY' WHEN 1 THEN 'USD' WHEN 2 THEN 'HKD' WHEN 3 THEN NULL WHEN 4 THEN 'CNY' END AS currency,
    CASE p_partkey % 6 WHEN 3 THEN 'MISSING_UNIT' WHEN 4 THEN 'PARSE_FAILED' END AS error, p_partkey % 6 = 1 AS estimated FROM part""",
)
def money_parse(spark: SparkSession, d: str) -> DataFrame:
    """Amounts with unit and currency; problems are codes, the rows stay."""
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    forms = F.when(k == 0, F.concat(F.lit("人民币"), n, F.lit("亿元"))).when(k == 1, F.concat(F.lit("约$"), n, F.lit("万"))).when(k == 2, F.concat(F.lit("HK$ "), n, F.lit("百万元"))).when(k == 3, n).when(k == 4, F.concat(n, F.lit("-"), n, F.lit("万元人民币"))).otherwise("未披露")
    m = table(spark, d, "part").select("p_partkey", strict.money(forms).alias("m"))
    return m.select("p_partkey", F.col("m.value").cast("double").alias("amount"), F.col("m.currency").alias("currency"), F.col("m.error").alias("error"), F.col("m.estimated").alias("estimated"))


@query(
    "date_precision",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN strftime(o_orderdate, '%Y') END AS value,
    CASE o_orderkey % 5 WHEN 0 THEN 'DAY' WHEN 1 THEN 'MONTH' WHEN 2 THEN 'YEAR' WHEN 3 THEN 'YEAR' END AS precision, o_orderkey % 5 = 3 AS estimated, CASE WHEN o_orderkey % 5 = 4 THEN 'INVALID_DATE' END AS error FROM orders""",
)
def date_precision(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("o_orderkey") % 5, F.col("o_orderdate")
    s = F.when(k == 0, F.date_format(t, "yyyy/M/d")).when(k == 1, F.date_format(t, "yyyy'年'M'月'")).when(k == 2, F.date_format(t, "yyyy'年'")).when(k == 3, F.concat(F.lit("约"), F.date_format(t, "yyyy"), F.lit("年前后"))).otherwise(F.concat(F.date_format(t, "yyyy"), F.lit("-13-41")))
    r = table(spark, d, "orders").select("o_orderkey", strict.partial_date(s).alias("r"))
    return r.select("o_orderkey", F.col("r.value").alias("value"), F.col("r.precision").alias("precision"), F.col("r.estimated").alias("estimated"), F.col("r.error").alias("error"))


@query(
    "null_tokens",
    """SELECT event_id, CASE event_type WHEN 'click' THEN NULL WHEN 'error' THEN NULL WHEN 'view' THEN 'a b' ELSE event_type END AS cleaned FROM events""",
)
def null_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    s = F.when(t == "click", " 未公开　").when(t == "error", "N/A").when(t == "view", "\ta 　 b ").otherwise(t)
    return table(spark, d, "events").select("event_id", strict.clean_text(s).alias("cleaned"))


@query(
    "employee_counts",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size * 1000 AS BIGINT) END AS value, CASE WHEN p_partkey % 3 = 2 THEN 'PARSE_FAILED' END AS error FROM part""",
)
def employee_counts(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey") % 3, F.col("p_size")
    s = F.when(k == 0, F.concat(n.cast("string"), F.lit(",000"))).when(k == 1, (n * 1000).cast("string")).otherwise(F.concat(F.lit("-"), n.cast("string")))
    r = table(spark, d, "part").select("p_partkey", strict.employee_count(s).alias("r"))
    return r.select("p_partkey", F.col("r.value").alias("value"), F.col("r.error").alias("error"))


@query(
    "marital_states",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'MARRIED' WHEN 1 THEN 'DIVORCED' WHEN 4 THEN 'UNKNOWN' END AS value, CASE c_custkey % 5 WHEN 2 THEN 'MARITAL_STATUS_CONFLICT' WHEN 3 THEN 'UNKNOWN_ENUM' END AS error FROM customer""",
)
def marital_states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    s = F.when(k == 0, "已婚，育有二子").when(k == 1, "离异").when(k == 2, "离异后已婚").when(k == 3, "不便透露").otherwise("unknown")
    r = table(spark, d, "customer").select("c_custkey", strict.marital_status(s).alias("r"))
    return r.select("c_custkey", F.col("r.value").alias("value"), F.col("r.error").alias("error"))


@query(
    "organization_roles",
    """SELECT s_suppkey, concat(s_name, '商会') AS organization, CASE s_suppkey % 2 WHEN 0 THEN '副会长' ELSE '理事' END AS role, 'INDUSTRY_ASSOCIATION' AS kind FROM supplier""",
)
def organization_roles(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat("s_name", F.lit("商会"), F.when(F.col("s_suppkey") % 2 == 0, "副会长").otherwise("理事"))
    name, role = text.organization_and_role(s, rules.ROLES)
    return table(spark, d, "supplier").select("s_suppkey", name.alias("organization"), role.alias("role"), text.first_rule(name, rules.ORGANIZATIONS, "OTHER").alias("kind"))


def masked_run(sql: str, left: str, hidden: int, right: str) -> str:
    """SQL that hides digits between two parts. The oracle's engine can't look around, so the pattern takes its neighbours with it and is applied twice."""
    for _ in range(2):
        sql = f"regexp_replace({sql}, '(^|[^0-9])({left})[0-9]{{{hidden}}}({right})($|[^0-9])', '\\1\\2{'*' * hidden}\\3\\4', 'g')"
    return sql


MAIL = r"regexp_replace(%s, '([A-Za-z0-9._%%+-]{2})[A-Za-z0-9._%%+-]*(@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', '\1***\2', 'g')"
DISPLAYED = masked_run(MAIL % masked_run("text", "1[0-9]{2}", 4, "[0-9]{4}"), "[0-9]{6}", 8, "[0-9Xx]{4}")


@query("redact_display", f"SELECT doc_id, {DISPLAYED} AS text FROM documents")
def redact_display(spark: SparkSession, d: str) -> DataFrame:
    """Phones, addresses and identity numbers half shown."""
    return table(spark, d, "documents").select("doc_id", security.redact_display(F.col("text")).alias("text"))


def guarded(pattern: str) -> str:
    """A pattern of identifiers for an engine that can't look around: one neighbour on each side is part of the match."""
    for ahead, behind, neighbour in ((r"(?!\d)", r"(?<!\d)", "[^0-9]"), (r"(?![0-9A-Z])", r"(?<![0-9A-Z])", "[^0-9A-Za-z]"), (r"(?![A-Z0-9])", r"(?<![A-Z0-9])", "[^0-9A-Za-z]")):
        pattern = pattern.replace(behind, f"(^|{neighbour})").replace(ahead, f"({neighbour}|$)")
    return pattern.replace("IsHan", "Han")


def redacted_sql(column: str) -> tuple[str, str]:
    """SQL of the text without direct identifiers, and of the first kind found; texts hold no compatibility forms here."""
    text, kinds = column, ""
    for pattern, to, kind in security.IDENTIFIERS:
        p = guarded(pattern)
        kinds += f" WHEN regexp_matches({column}, '{p}') THEN '{kind}'"
        around = p != pattern.replace("IsHan", "Han")
        for _ in range(2 if around else 1):
            text = f"regexp_replace({text}, '{p}', '{chr(92) + '1' + to + chr(92) + '2' if around else to}', 'g')"
    return text, f"CASE{kinds} END"


REDACTED, KIND = redacted_sql("text")


@query("redact_direct", f"SELECT conv_id, turn, {REDACTED} AS text, {KIND} AS category FROM conversations")
def redact_direct(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", security.redact_direct(t).alias("text"), security.detected(t).alias("category"))


@query(
    "semantic_codes",
    """SELECT event_id, concat_ws('|', CASE WHEN event_type = 'click' THEN 'LONG_TERM_PLANNING' END, CASE WHEN event_type = 'view' THEN 'DIGITAL_TECHNOLOGY' END,
    CASE WHEN event_type IN ('purchase', 'view') THEN 'WEALTH_MANAGEMENT' END, CASE WHEN event_type = 'signup' THEN 'CROSS_BORDER' END) AS codes FROM events""",
)
def semantic_codes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    s = F.when(t == "click", "a LONG term plan").when(t == "view", "AI与投资").when(t == "purchase", "said: 资产配置").when(t == "signup", "海外")
    s = F.coalesce(F.when(t == "view", "AI 投资").otherwise(s), F.lit("plain maid"))
    return table(spark, d, "events").select("event_id", F.array_join(security.semantic_codes(s, security.INTERACTION), "|").alias("codes"))


@query(
    "controlled_codes",
    """SELECT p_partkey, CASE WHEN regexp_full_match(replace(upper(p_brand), '#', '_'), '[A-Z][A-Z0-9_]{0,79}') THEN replace(upper(p_brand), '#', '_') END AS code FROM part""",
)
def controlled_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", security.controlled_code(F.replace(F.upper("p_brand"), F.lit("#"), F.lit("_"))).alias("code"))


@query("coarse_locations", """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '广东省/深圳市' WHEN 1 THEN '北京市' WHEN 2 THEN 'LOCATION_REDACTED' ELSE '杭州市' END AS location FROM nation""")
def coarse_locations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    s = F.when(k == 0, "广东省深圳市南山区科技路1号").when(k == 1, "北京市朝阳区").when(k == 2, F.col("n_name")).otherwise("杭州市西湖区")
    return table(spark, d, "nation").select("n_nationkey", security.coarse_location(s).alias("location"))


@query(
    "short_places",
    """SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN '广西壮族自治区/南宁市' WHEN 1 THEN '内蒙古自治区' WHEN 2 THEN '江苏省' WHEN 3 THEN '香港特别行政区' WHEN 4 THEN '北京市' WHEN 5 THEN 'LOCATION_REDACTED' END AS location FROM supplier""",
)
def short_places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 7
    s = F.when(k == 0, "广西壮族自治区 南宁市青秀区").when(k == 1, "内蒙古").when(k == 2, " 江苏 ").when(k == 3, "香港特别行政区").when(k == 4, "北京").when(k == 5, F.col("s_name")).otherwise(" ")
    return table(spark, d, "supplier").select("s_suppkey", security.coarse_location(s).alias("location"))


@query(
    "field_codes",
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'FEMALE' WHEN 1 THEN 'MALE' WHEN 3 THEN 'OTHER_X' END AS gender, CASE c_custkey % 6 WHEN 2 THEN 'UNMARRIED' WHEN 4 THEN 'DIVORCED' END AS marital,
    CASE c_custkey % 6 WHEN 5 THEN 'MASTER' END AS education, CASE c_custkey % 6 WHEN 0 THEN 'LOW' ELSE 'MEDIUM' END AS liquidity, CASE WHEN c_custkey % 6 < 3 THEN 'NET_PROFIT' ELSE 'GROSS_MARGIN' END AS metric FROM customer""",
)
def field_codes(spark: SparkSession, d: str) -> DataFrame:
    """Profile texts to codes; a text that is a code already stays one."""
    k = F.col("c_custkey") % 6
    gender = F.when(k == 0, "女性").when(k == 1, "男").when(k == 3, "other_x").otherwise("未说明")
    marital = F.when(k == 2, "未婚").when(k == 4, "婚变后离异").otherwise("不详 ")
    education = F.when(k == 5, "研究生（在职）").otherwise("其他学历")
    liquidity = F.when(k == 0, "流动性要求不高").otherwise("一般")
    metric = F.when(k < 3, "归母净利润").otherwise("综合毛利率")
    texts = {"gender": (gender, "gender"), "marital": (marital, "maritalStatus"), "education": (education, "educationLevel"), "liquidity": (liquidity, "liquidityRequirement"), "metric": (metric, "metricName")}
    return table(spark, d, "customer").select("c_custkey", *[security.mapped_code(c, f).alias(n) for n, (c, f) in texts.items()])


@query(
    "subject_codes",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'CLOUD_COMPUTING|ARTIFICIAL_INTELLIGENCE' WHEN 1 THEN 'MANUFACTURING' ELSE '' END AS business, CASE p_partkey % 5 WHEN 2 THEN 'FIXED_INCOME' WHEN 4 THEN 'INSURANCE' END AS asset,
    CASE p_partkey % 5 WHEN 3 THEN 'FAMILY_GOVERNANCE|TRUST_STRUCTURE' ELSE '' END AS governance FROM part""",
)
def subject_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    s = F.when(k == 0, "Cloud 与大模型, 前瞻").when(k == 1, "MANUFACTURING of chairs").when(k == 2, "bond ladder, 固收").when(k == 3, "家族信托").otherwise("保险与现金")
    codes = {g: security.semantic_codes(s, rules.SEMANTIC[g]) for g in ("BUSINESS", "ASSET", "GOVERNANCE")}
    return table(spark, d, "part").select("p_partkey", F.array_join(codes["BUSINESS"], "|").alias("business"), F.get(codes["ASSET"], F.lit(0)).alias("asset"), F.array_join(codes["GOVERNANCE"], "|").alias("governance"))


@query(
    "identifier_kinds",
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN concat('致电[PHONE_REDACTED],编号', c_custkey) WHEN 1 THEN concat('见 [EMAIL_REDACTED] ', c_custkey) WHEN 2 THEN '证[ID_REDACTED]。' WHEN 3 THEN '[PERSON_REDACTED],已联系' WHEN 4 THEN '卡[ACCOUNT_REDACTED]。' ELSE concat('无 ', c_custkey) END AS text,
    CASE c_custkey % 6 WHEN 0 THEN 'PHONE' WHEN 1 THEN 'EMAIL' WHEN 2 THEN 'IDENTITY_DOCUMENT' WHEN 3 THEN 'LABELED_PERSON_NAME' WHEN 4 THEN 'BANK_ACCOUNT' END AS category FROM customer""",
)
def identifier_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Texts in which each kind of identifier stands once; wide punctuation becomes narrow."""
    key = F.col("c_custkey")
    k, n, t = key % 6, F.lpad(key.cast("string"), 8, "0"), key.cast("string")
    s = F.when(k == 0, F.concat(F.lit("致电138"), n, F.lit("，编号"), t)).when(k == 1, F.concat(F.lit("见 a.b"), t, F.lit("@x-y.com "), t)).when(k == 2, F.concat(F.lit("证110101"), n, F.lit("123X。")))
    s = s.when(k == 3, "联系人：张三丰，已联系").when(k == 4, F.concat(F.lit("卡62220000"), n, F.lit("123。"))).otherwise(F.concat(F.lit("无 "), t))
    return table(spark, d, "customer").select("c_custkey", security.redact_direct(s).alias("text"), security.detected(s).alias("category"))


@query(
    "loose_keys",
    """SELECT c_custkey, coalesce(CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN CAST(c_nationkey AS VARCHAR) WHEN 2 THEN c_name WHEN 3 THEN c_mktsegment END, '-') AS display_name FROM customer""",
)
def loose_keys(spark: SparkSession, d: str) -> DataFrame:
    """Records with keys of mixed styles: the name as it is, then without case and underscores, then the next name; blank values count as none."""
    c = table(spark, d, "customer")
    styles = (
        F.create_map(F.lit("display_name"), F.col("c_name"), F.lit("DisplayName"), F.lit("other")),
        F.create_map(F.lit("DISPLAY NAME"), F.lit(" "), F.lit("alias"), F.col("c_nationkey").cast("string")),
        F.create_map(F.lit("Display_Name"), F.col("c_name"), F.lit("alias"), F.lit("other")),
        F.create_map(F.lit("A-lias"), F.col("c_mktsegment"), F.lit("note"), F.col("c_name")),
        F.create_map(F.lit("note"), F.col("c_name")),
    )
    record = styles[4]
    for n in range(4):
        record = F.when(F.col("c_custkey") % 5 == n, styles[n]).otherwise(record)
    return c.select("c_custkey", F.coalesce(records.loose_value(record, "display_name", "alias"), F.lit("-")).alias("display_name"))


@query(
    "canonical_records",
    """SELECT o_orderkey, sha256(concat('{"a":{"b":', o_orderkey % 7, ',"y":"', o_orderstatus, '"},"items":[{"k":"', o_orderpriority, '","v":', o_custkey, '}],"tags":{"p":"1","q":"', o_orderpriority, '"}}')) AS sha256 FROM orders""",
)
def canonical_records(spark: SparkSession, d: str) -> DataFrame:
    """Nested records in either order of keys hash alike."""
    item = F.struct(F.col("o_custkey").alias("v"), F.col("o_orderpriority").alias("k"))
    tags = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("q"), F.col("o_orderpriority"), F.lit("p"), F.lit("1"))).otherwise(F.create_map(F.lit("p"), F.lit("1"), F.lit("q"), F.col("o_orderpriority")))
    inner = F.struct(F.col("o_orderstatus").alias("y"), (F.col("o_orderkey") % 7).alias("b"))
    rows = table(spark, d, "orders").select("o_orderkey", F.struct(tags.alias("tags"), F.array(item).alias("items"), inner.alias("a")).alias("record"))
    return rows.select("o_orderkey", F.sha2(records.canonical_json(F.col("record"), rows.schema["record"].dataType), 256).alias("sha256"))
