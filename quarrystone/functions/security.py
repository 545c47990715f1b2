"""Redaction, detection and projection of sensitive text, all in the JVM's regular expressions."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrystone.functions import rules
from quarrystone.functions.text import first_rule, found, strip

#: Patterns of direct identifiers, in the order in which they are replaced, and what replaces them.
IDENTIFIERS = (
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[EMAIL_REDACTED]", "EMAIL"),
    (r"(?<!\d)(?:\+?86[- ]?)?1[3-9](?:[- ]?\d){9}(?!\d)", "[PHONE_REDACTED]", "PHONE"),
    (r"(?<!\d)(?:\+?86[- ]?)?0\d{2,3}[- ]?\d{7,8}(?:[- 转]\d{1,6})?(?!\d)", "[PHONE_REDACTED]", "PHONE"),
    (r"(?<!\d)\+[1-9]\d{0,2}(?:[- ]?\d){6,14}(?!\d)", "[PHONE_REDACTED]", "PHONE"),
    (r"(?i)(?<![0-9A-Z])(?:\d{15}|\d{17}[0-9X])(?![0-9A-Z])", "[ID_REDACTED]", "IDENTITY_DOCUMENT"),
    (r"(?i)(?<![A-Z0-9])(?:[EGPDS]\d{7,8}|[A-Z]{1,2}\d{6}\(?[0-9A]\)?|[A-Z][12]\d{8})(?![A-Z0-9])", "[ID_REDACTED]", "IDENTITY_DOCUMENT"),
    (r"(?<!\d)(?:\d[- ]?){15,18}\d(?!\d)", "[ACCOUNT_REDACTED]", "BANK_ACCOUNT"),
    (r"(?:(?:姓名|联系人|客户经理)|(?:配偶|子女)(?:姓名)?)\s*(?:[:：]|为|是|叫)\s*[\p{IsHan}·]{2,8}", "[PERSON_REDACTED]", "LABELED_PERSON_NAME"),
    (r"(?i)(?:(?:[\p{IsHan}]{2,12}(?:省|自治区|特别行政区|市|区|县)){1,4}[\p{IsHan}A-Za-z0-9]{1,20}(?:路|街|巷|弄)(?:\s*\d{1,6}号?)?|[\p{IsHan}A-Za-z0-9]{2,20}(?:路|街|巷|弄)\s*\d{1,6}号)(?:\s*\d{1,6}(?:栋|幢|单元|室))?", "[LOCATION_REDACTED]", "PRECISE_LOCATION"),
    (r"(?i)[\p{IsHan}A-Za-z0-9]{2,30}(?:SOHO|广场|园区|大厦|小区|公寓)(?:\s*\d{1,6}(?:号|栋|幢|单元|室))?", "[LOCATION_REDACTED]", "PRECISE_LOCATION"),
)
ZERO_WIDTH = r"[​-‏⁠﻿]"
#: Display redaction, in order.
DISPLAY = (
    (r"(?<!\d)(1\d{2})\d{4}(\d{4})(?!\d)", "$1****$2"),
    (r"(?i)([a-z0-9._%+-]{2})[a-z0-9._%+-]*(@[a-z0-9.-]+\.[a-z]{2,})", "$1***$2"),
    (r"(?<!\d)(\d{6})\d{8}([0-9Xx]{4})(?!\d)", "$1********$2"),
)
CREDENTIALS = r"(?i)\b(password|passwd|pwd|secret|token|api[_-]?key|authorization)(\s*[=:]\s*)[^\s,;]+"
CODE = r"^[A-Z][A-Z0-9_]{0,79}$"
INTERACTION = rules.SEMANTIC["INTERACTION"]


def redact_display(c: Column) -> Column:
    for pattern, to in DISPLAY:
        c = F.regexp_replace(c, pattern, to)
    return c


@F.pandas_udf(StringType())
def _compatible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.str.normalize("NFKC")


def normalized(c: Column) -> Column:
    """Compatibility forms folded, zero-width characters gone, long dashes short. ASCII text never leaves the JVM's plan branch."""
    folded = F.when(c.rlike(r"[^\x00-\x7F]"), _compatible(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)
    return F.translate(F.regexp_replace(folded, ZERO_WIDTH, ""), "—–", "--")


def redact_direct(c: Column) -> Column:
    c = normalized(c)
    for pattern, to, _ in IDENTIFIERS:
        c = F.regexp_replace(c, pattern, to)
    return c


def detected(c: Column) -> Column:
    """Category of the first identifier pattern that occurs; null if none does."""
    c = normalized(c)
    out = F.lit(None).cast("string")
    for pattern, _, kind in reversed(IDENTIFIERS):
        out = F.when(c.rlike(pattern), kind).otherwise(out)
    return out


def redact_credentials(c: Column) -> Column:
    return F.regexp_replace(c, CREDENTIALS, "$1$2[REDACTED]")


def controlled_code(c: Column) -> Column:
    return F.when(c.rlike(CODE), c)


def semantic_codes(c: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """Codes of all rules of which a keyword occurs, in order."""
    low = F.lower(c)

    def hit(word: str) -> Column:
        return low.rlike(rf"(?<![\p{{L}}\p{{Nd}}])\Q{word}\E(?![\p{{L}}\p{{Nd}}])") if word.isascii() else low.contains(word)

    marks = []
    for code, words in table.items():
        any_hit = F.lit(False)
        for w in words:
            any_hit = any_hit | hit(w)
        marks.append(F.when(any_hit, code))
    return F.array_compact(F.array(*marks))


def mapped_code(c: Column, field: str) -> Column:
    """The code of a profile field's text: the text itself if it is a code in any case, else the first rule's; null if none fits."""
    t = strip(normalized(c))
    return F.coalesce(controlled_code(F.upper(t)), first_rule(t, rules.FIELD_CODES[field]))


def coarse_location(c: Column) -> Column:
    """Province and the city after it, a city alone, the full name of a place given in short, or a redaction mark; null for a blank."""
    t = strip(normalized(c))
    province = found(t, r"([\p{IsHan}]{2,12}(?:省|自治区|特别行政区))")
    rest = F.regexp_replace(t, r"^.*?[\p{IsHan}]{2,12}(?:省|自治区|特别行政区)", "")
    city = found(rest, r"([\p{IsHan}]{2,8}市)")
    short = F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.PLACES.items() for x in kv]), t)
    place = F.when(province.isNotNull(), F.concat_ws("/", province, city)).otherwise(F.coalesce(found(t, r"([\p{IsHan}]{2,8}市)"), short, F.lit("LOCATION_REDACTED")))
    return F.when(t != "", place)


def truncated(c: Column, most: int) -> tuple[Column, Column]:
    """At most so many code points, and whether any were cut."""
    return F.substring(c, 1, most), F.coalesce(F.length(c) > most, F.lit(False))


def masked_configuration(c: Column) -> Column:
    """A map whose values under secret-looking keys are masked."""
    return F.transform_values(c, lambda k, v: F.when(F.lower(k).rlike("password|secret|token|key|credential"), F.lit("******")).otherwise(v))


def first_code(c: Column, table: Sequence[tuple[Sequence[str], str]]) -> Column:
    return first_rule(c, table)
