"""Strict normalizers: a struct of the value and an error code each; bad input is data, never a failed job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions import rules
from quarrystone.functions.text import found, strip

DECIMAL = "decimal(38,6)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_text(c: Column) -> Column:
    """White space squeezed and trimmed; null for the words that mean nothing is known."""
    t = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(~F.lower(t).isin(*rules.NULLS), t)


def contains_speculation(c: Column) -> Column:
    return F.coalesce(c.rlike("|".join(rules.SPECULATION)), F.lit(False))


def result(value: Column, error: Column, **more: Column) -> Column:
    return F.struct(value.alias("value"), error.alias("error"), *[v.alias(k) for k, v in more.items()])


def marital_status(c: Column) -> Column:
    """value, error. An exact word, else the one state that the text names; several conflict, none is unknown."""
    raw = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    t = F.when(F.upper(raw) == "UNKNOWN", raw).otherwise(clean_text(c))
    codes = sorted({*rules.MARITAL.values(), "UNKNOWN"})
    exact = F.when(F.upper(t).isin(*codes), F.upper(t))
    for word, code in rules.MARITAL.items():
        exact = F.when(t == word, code).otherwise(exact)
    named = F.array(*[F.when(t.contains(w), rules.MARITAL[w]) for w in ("已婚", "未婚", "离异", "丧偶")])
    named = F.array_distinct(F.array_compact(named))
    value = F.coalesce(exact, F.when(F.size(named) == 1, F.try_element_at(named, F.lit(1))))
    error = F.when(t.isNull() | value.isNotNull(), F.lit(None)).when(F.size(named) > 1, "MARITAL_STATUS_CONFLICT").otherwise("UNKNOWN_ENUM")
    return result(value, error)


def employee_count(c: Column) -> Column:
    """value, error. Whole numbers, plain or grouped by threes."""
    t = clean_text(c)
    ok = t.rlike(r"^(?:\d+|\d{1,3}(?:,\d{3})+)$")
    value = F.when(ok, F.regexp_replace(t, ",", "").try_cast("bigint"))
    return result(value, F.when(t.isNotNull() & value.isNull(), "PARSE_FAILED"))


def percentage(c: Column) -> Column:
    """value, error. 0 to 100, with or without sign and grouping."""
    t = clean_text(c)
    v = F.regexp_replace(t, "[,%]", "").try_cast("decimal(20,4)")
    value = F.when(v.between(0, 100), v)
    return result(value, F.when(t.isNotNull() & value.isNull(), "PARSE_FAILED"))


def strict_year(c: Column) -> Column:
    return found(c, r"(?<!\d)((?:18|19|20|21)\d{2})(?!\d)").cast("int")


def currency(c: Column) -> Column:
    """value, error."""
    t = clean_text(c)
    value = F.lit(None).cast("string")
    for word, code in rules.CURRENCIES.items():
        value = F.when(F.lower(t) == word, code).otherwise(value)
    return result(value, F.when(t.isNotNull() & value.isNull(), "UNKNOWN_CURRENCY"))


_TOKEN = r"\d{4}(?:年(?:\d{1,2}月(?:\d{1,2}日?)?)?|[-/.]\d{1,2}(?:[-/.]\d{1,2})?)"
#: Full forms of a date in order: pattern, precision, number of parts.
_DATES = (
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", "DAY", 3),
    (r"^(\d{4})年(\d{1,2})月(\d{1,2})日?$", "DAY", 3),
    (r"^(\d{4})[-/.](\d{1,2})$", "MONTH", 2),
    (r"^(\d{4})年(\d{1,2})月$", "MONTH", 2),
    (r"^(\d{4})年?[Qq]([1-4])$", "QUARTER", 2),
    (r"^(\d{4})年?$", "YEAR", 1),
)


def partial_date(c: Column) -> Column:
    """value, error, precision, estimated, range. A range keeps its text only; a vague date keeps its year; else a full form must match."""
    def parsed(t: Column) -> Column:
        forms = []
        for pattern, kind, n in _DATES:
            p = [F.lpad(F.regexp_extract(t, pattern, i + 1), 4 if i == 0 else 2, "0") for i in range(n)]
            if kind == "DAY":
                text = F.date_format(F.try_to_timestamp(F.concat_ws("-", *p), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")
            elif kind == "MONTH":
                text = F.when(p[1].between("01", "12"), F.concat_ws("-", *p))
            elif kind == "QUARTER":
                text = F.concat(p[0], F.lit("-Q"), F.regexp_extract(t, pattern, 2))
            else:
                text = p[0]
            forms.append(F.when(t.rlike(pattern), F.struct(text.alias("text"), F.lit(kind).alias("kind"))))
        first = F.try_element_at(F.array_compact(F.array(*forms)), F.lit(1))
        ranged = t.rlike(rf"{_TOKEN}\s*(?:-|至|到|—|–|~|～)\s*{_TOKEN}")
        year = F.when(t.rlike("约|前后|左右"), found(t, r"(?<!\d)((?:18|19|20|21)\d{2})(?!\d)"))
        return let(F.struct(first.alias("first"), F.coalesce(ranged, F.lit(False)).alias("ranged"), year.alias("year")), lambda x: chosen(t, x))

    def chosen(t: Column, x: Column) -> Column:
        estimated = ~x.ranged & x.year.isNotNull()
        value = F.when(x.ranged, F.lit(None)).when(estimated, x.year).otherwise(x.first.text)
        precision = F.when(x.ranged, F.lit(None)).when(estimated, "YEAR").when(value.isNotNull(), x.first.kind)
        error = F.when(t.isNotNull() & ~x.ranged & value.isNull(), F.when(x.first.isNotNull(), "INVALID_DATE").otherwise("PARSE_FAILED"))
        return result(value, error, precision=precision, estimated=estimated, range=F.when(x.ranged, t))

    return let(F.when(clean_text(c).isNotNull(), strip(c)), parsed)


def money(c: Column, unit: Column | None = None, code: Column | None = None) -> Column:
    """value (decimal, in single units), error, unit, currency, estimated. unit and code, if given and not null, are explicit ones.

    Separators go, ranges fail, words for estimates are noted and go. An explicit currency must be known; one in the text, as a
    sign (longest first) or a word (longest first), must agree with it. The unit is the explicit one or the longest in the
    text; without one there is no amount. What is left must be a number.
    """
    unit, code = (F.lit(None).cast("string") if x is None else x for x in (unit, code))
    marks = "|".join(rules.ESTIMATES)

    def parsed(t: Column) -> Column:
        ranged, estimated = t.rlike(r"\d\s*(?:-|至|到|~|～|—)\s*\d"), t.rlike(marks)
        return let(F.regexp_replace(t, marks, ""), lambda x: signed(t, x, ranged, estimated))

    def signed(t: Column, x: Column, ranged: Column, estimated: Column) -> Column:
        sign = F.lit(None).cast("string")
        for s, k in reversed(rules.SYMBOLS):
            sign = F.when(x.contains(s), k).otherwise(sign)
        word = F.lit(None).cast("string")
        for w in sorted(rules.CURRENCIES, key=len):
            word = F.when(F.lower(x).contains(w), rules.CURRENCIES[w]).otherwise(word)
        # 元 of 美元 and 港元 belongs to the currency and is a unit as well
        bare = F.regexp_replace(F.regexp_replace(x, r"(?i)HK\$|[$¥￥]|人民币|港币|rmb|cny|hkd|usd", ""), "港元|美元", "元")
        return let(F.struct(sign.alias("sign"), word.alias("word"), bare.alias("bare")), lambda y: ended(t, y, ranged, estimated))

    def ended(t: Column, y: Column, ranged: Column, estimated: Column) -> Column:
        own = F.nullif(F.regexp_extract(y.bare, f"({'|'.join(sorted((n for n, _ in rules.UNITS), key=len, reverse=True))})$", 1), F.lit(""))
        number = F.substring(y.bare, F.lit(1), F.length(y.bare) - F.coalesce(F.length(own), F.lit(0)))
        return let(F.struct(own.alias("own"), number.alias("number"), currency(code).alias("given")), lambda z: valued(t, y, z, ranged, estimated))

    def valued(t: Column, y: Column, z: Column, ranged: Column, estimated: Column) -> Column:
        factors = F.create_map(*[x for n, k in rules.UNITS for x in (F.lit(n), F.lit(k).cast("decimal(12,0)"))])
        factor = F.try_element_at(factors, F.coalesce(unit, z.own, F.lit("")))
        named = F.coalesce(y.sign, y.word)
        conflict = z.given.value.isNotNull() & y.word.isNotNull() & (z.given.value != y.word) | z.given.value.isNull() & y.sign.isNotNull() & y.word.isNotNull() & (y.sign != y.word)
        amount = F.when(z.number.rlike(r"^[+-]?\d+(?:\.\d+)?$"), z.number.try_cast("decimal(24,6)"))
        ending = F.regexp_extract(y.bare, r"([一-鿿]{1,8}(?:元|币))$", 1)
        other = F.upper(y.bare).rlike("(?<![A-Z])[A-Z]{3}(?![A-Z])") | named.isNull() & z.given.value.isNull() & (ending != "") & ~ending.isin(*[n for n, _ in rules.UNITS])
        error = F.when(t.isNull(), F.lit(None)).when(ranged, "PARSE_FAILED").when(z.given.error.isNotNull() | conflict | other, "UNKNOWN_CURRENCY").when(factor.isNull(), "MISSING_UNIT").when(amount.isNull(), "PARSE_FAILED")
        return result(F.when(error.isNull(), (amount * factor).cast(DECIMAL)), error, unit=F.coalesce(unit, z.own), currency=F.coalesce(z.given.value, named), estimated=F.coalesce(estimated, F.lit(False)))

    return let(F.regexp_replace(clean_text(c), r"[,，\s　]", ""), parsed)


def plain_decimal(c: Column) -> Column:
    """Decimal as text: no trailing zeros, no exponent, no negative zero."""
    t = c.cast("string")
    t = F.when(t.contains("."), F.regexp_replace(F.regexp_replace(t, "0+$", ""), r"\.$", "")).otherwise(t)
    return F.when(t == "-0", "0").otherwise(t)


def preview(c: Column, most: int = 160) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def value_format(c: Column) -> Column:
    """What a value looks like, the first class that fits; eight digits are a number, never a date."""
    t = strip(c)
    classes = (
        (r"^$", "EMPTY_STRING"),
        (r"^[-+]?\d+(?:\.\d+)?$", "NUMERIC_STRING"),
        (r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:[ T].*)?$", "DATE_STRING"),
        (r"^\d{8}$", "COMPACT_DATE_OR_NUMBER"),
        (r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "EMAIL_STRING"),
        (r"^[+\d][\d\s()-]{5,}$", "PHONE_LIKE_STRING"),
    )
    json = F.when(F.try_parse_json(t).isNotNull(), "JSON_STRING").otherwise("MALFORMED_JSON_LIKE_STRING")
    out = F.when(t.rlike(r"^[\[{]"), json).when(t.rlike(r"[,，;；|、\n]"), "DELIMITED_STRING").otherwise("PLAIN_STRING")
    for pattern, code in reversed(classes):
        out = F.when(t.rlike(pattern), code).otherwise(out)
    return F.when(c.isNull(), "NULL").otherwise(out)
