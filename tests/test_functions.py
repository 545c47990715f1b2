"""Scalar functions on inline values; names and numbers are invented."""

import hashlib
import uuid
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import ids, rules, security, strict, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("value", "want"),
    [("甲：1；乙： 2 ;丙", {"甲": "1", "乙": "2"}), ("甲：1；甲：3", {"甲": "3"}), ("a：b：c", {"a": "b：c"}), ("", {}), ("没有", {})],
)
def test_T01_key_values(spark, value, want):
    assert one(spark, value, text.key_values) == want


@pytest.mark.parametrize(("value", "want"), [("生于1971年3月9日", date(1971, 3, 9)), ("2024-5-1 到期", date(2024, 5, 1)), ("2024-13-01", None), ("无", None), (None, None)])
def test_T02_date(spark, value, want):
    assert one(spark, value, text.parse_date) == want


@pytest.mark.parametrize(("f", "value", "want"), [(text.parse_year, "成立于1998年和2003年", 1998), (text.parse_year, "1798", None), (text.parse_decimal, "约1,234.5人", Decimal("1234.5000")), (text.parse_stock_code, "某司（0700.hk）", "0700.HK"), (text.name_key, " Ab　C d ", "abcd"), (text.amount_100m, "减持-3.5亿元", Decimal("-3.5000"))])
def test_T03_T06_scalars(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize(("value", "want"), [("甲、乙（丙、丁），戊", ["甲", "乙（丙、丁）", "戊"]), ("a)，b", ["a)", "b"]), ("、、", []), ("(a(b,c),d),e", ["(a(b,c),d)", "e"]), ("", [])])
def test_T17_top_level(spark, value, want):
    assert one(spark, value, text.split_top_level) == want


def test_T12_T25_rule_tables(spark):
    assert one(spark, "现金管理和债券", lambda c: text.first_rule(c, rules.HOLDINGS)) == "CASH"
    assert one(spark, "追加后减持", lambda c: text.first_rule(c, rules.EVENTS)) == "DIVESTMENT"
    assert one(spark, "平淡", lambda c: text.first_rule(c, rules.NOTES, "GENERAL_NOTE")) == "GENERAL_NOTE"
    assert one(spark, "已确定，但暂无明确", lambda c: text.first_rule(c, rules.SUCCESSION, "PENDING_CONFIRMATION")) == "NO_FORMAL_SUCCESSOR"


@pytest.mark.parametrize(("value", "want"), [("某某商会副会长", ("某某商会", "副会长")), ("会长", ("会长", None)), ("某大学（北区）校董", ("某大学", "校董"))])
def test_T26_roles(spark, value, want):
    got = spark.createDataFrame([(value,)], "x string").select(*text.organization_and_role(F.col("x"), rules.ROLES)).first()
    assert tuple(got) == want


def test_T30_scaled(spark):
    rows = spark.createDataFrame([("1.5", "万亿元"), ("2", "亿美元")], "v string, u string")
    assert [tuple(r) for r in rows.select(*text.scaled_amount(F.col("v"), F.col("u"))).collect()] == [(Decimal("15000.0000"), "CNY_100M"), (Decimal("2.0000"), "USD_100M")]


def test_T35_share(spark):
    rows = spark.createDataFrame([("王某(甲)持股约12.5%，", "王某(甲)"), ("李某持股3%", "王某"), ("a.c持股9%", "a.c"), ("abc持股9%", "a.c")], "t string, n string")
    assert [r[0] for r in rows.select(text.share_of("t", "n")).collect()] == [Decimal("12.5000"), None, Decimal("9.0000"), None]


@pytest.mark.parametrize(("value", "want"), [(" a \t　b ", "a b"), ("N/A", None), ("未披露", None), ("None", None), (None, None), ("0", "0")])
def test_N01_clean(spark, value, want):
    assert one(spark, value, strict.clean_text) == want


@pytest.mark.parametrize(("value", "want"), [("已婚", ("MARRIED", None)), ("离异，一女", ("DIVORCED", None)), ("UNKNOWN", ("UNKNOWN", None)), ("已婚/离异", (None, "MARITAL_STATUS_CONFLICT")), ("保密", (None, "UNKNOWN_ENUM")), ("不详", (None, None)), (None, (None, None))])
def test_N03_marital(spark, value, want):
    assert tuple(one(spark, value, strict.marital_status)) == want


@pytest.mark.parametrize(("value", "want"), [("1,234", (1234, None)), ("12", (12, None)), ("12,34", (None, "PARSE_FAILED")), ("-3", (None, "PARSE_FAILED")), ("未知", (None, None))])
def test_N04_employees(spark, value, want):
    assert tuple(one(spark, value, strict.employee_count)) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("2024-5-1", ("2024-05-01", None, "DAY", False)), ("2024年5月1日", ("2024-05-01", None, "DAY", False)), ("2024.05", ("2024-05", None, "MONTH", False)), ("2024Q3", ("2024-Q3", None, "QUARTER", False)),
        ("2024年", ("2024", None, "YEAR", False)), ("约1998年", ("1998", None, "YEAR", True)), ("2024-02-31", (None, "INVALID_DATE", None, False)), ("2024-13", (None, "INVALID_DATE", None, False)),
        ("去年", (None, "PARSE_FAILED", None, False)), ("2019年至2021年", (None, None, None, False)), ("未公开", (None, None, None, False)),
    ],
)
def test_N06_dates(spark, value, want):
    got = one(spark, value, strict.partial_date)
    assert (got.value, got.error, got.precision, got.estimated) == want
    assert got.range == (value if "至" in value else None)


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("3.5亿元", (Decimal("350000000"), None, None, False)), ("约 1,200万元人民币", (Decimal("12000000"), None, "CNY", True)), ("HK$20百万", (Decimal("20000000"), None, "HKD", False)), ("$5亿", (Decimal("500000000"), None, "USD", False)),
        ("5亿美元", (Decimal("500000000"), None, "USD", False)), ("123", (None, "MISSING_UNIT", None, False)), ("3-5亿元", (None, "PARSE_FAILED", None, False)), ("5亿EUR", (None, "UNKNOWN_CURRENCY", None, False)), ("5亿日元", (None, "UNKNOWN_CURRENCY", None, False)), ("若干亿", (None, "PARSE_FAILED", None, False)), ("暂无", (None, None, None, False)),
    ],
)
def test_N09_money(spark, value, want):
    got = one(spark, value, strict.money)
    assert (got.value, got.error, got.currency, got.estimated) == want


def test_N09_explicit(spark):
    got = one(spark, "7", lambda c: strict.money(c, F.lit("万元"), F.lit("usd")))
    assert (got.value, got.error, got.currency) == (Decimal("70000"), None, "USD")
    assert one(spark, "7万", lambda c: strict.money(c, None, F.lit("XYZ"))).error == "UNKNOWN_CURRENCY"
    assert one(spark, "$7万", lambda c: strict.money(c, None, F.lit("CNY"))).currency == "CNY"
    assert one(spark, "7万美元", lambda c: strict.money(c, None, F.lit("CNY"))).error == "UNKNOWN_CURRENCY"


@pytest.mark.parametrize(("value", "want"), [("1.500", "1.5"), ("-0.00", "0"), ("100", "100"), ("0.10", "0.1")])
def test_N17_plain(spark, value, want):
    assert one(spark, value, lambda c: strict.plain_decimal(c)) == want


@pytest.mark.parametrize(("value", "want"), [("20240101", "NUMERIC_STRING"), ("2024-1-1", "DATE_STRING"), ("a@b.co", "EMAIL_STRING"), ('{"a":1}', "JSON_STRING"), ("{a", "MALFORMED_JSON_LIKE_STRING"), ("+86 138 0000", "PHONE_LIKE_STRING"), ("a；b", "DELIMITED_STRING"), ("words", "PLAIN_STRING"), (" ", "EMPTY_STRING"), (None, "NULL")])
def test_N25_formats(spark, value, want):
    assert one(spark, value, strict.value_format) == want


def test_I01_fingerprint(spark):
    got = spark.createDataFrame([(" a ", None, "b")], "x string, y string, z string").select(ids.fingerprint(F.col("x"), F.col("y"), F.col("z"))).first()[0]
    assert got == hashlib.sha256(b"a\x1f\x1fb").hexdigest()[:24]


def test_I07_points(spark):
    names = [f"D{i:06d}_C{i:04d}" for i in range(200)]
    rows = spark.createDataFrame([(n,) for n in [*names, "  "]], "x string").select("x", ids.point_id(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == [str(uuid.uuid5(ids.POINTS, n)) for n in names] + [None]


def test_P01_display(spark):
    assert one(spark, "13812345678 ab.cd@x.org 11010119900307123X", security.redact_display) == "138****5678 ab***@x.org 110101********123X"


def test_P05_P07_identifiers(spark):
    value = "邮箱：a.b@c.com，手机１３８１２３４５６７８，联系人：张三丰，地址在幸福路 12号"
    got = one(spark, value, security.redact_direct)
    assert "[EMAIL_REDACTED]" in got and "[PHONE_REDACTED]" in got and "[PERSON_REDACTED]" in got and "[LOCATION_REDACTED]" in got and "张三丰" not in got
    assert one(spark, value, security.detected) == "EMAIL" and one(spark, "平安", security.detected) is None
    assert one(spark, "1​38—", security.normalized) == "138-"


def test_P12_P14_P25(spark):
    assert one(spark, "said AI, maid", lambda c: security.semantic_codes(c, security.INTERACTION)) == ["DIGITAL_TECHNOLOGY"]
    assert one(spark, "plain maid", lambda c: security.semantic_codes(c, security.INTERACTION)) == []
    assert one(spark, {"apiKey": "x", "host": "y"}, security.masked_configuration, "map<string,string>") == {"apiKey": "******", "host": "y"}
    assert one(spark, "password=abc, host=x", security.redact_credentials) == "password=[REDACTED], host=x"
