"""Text parsers of customer records, as column expressions.

A missing match is null. White space means Unicode's white space. First match wins where rules are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"(?U)[；;]\s*"
AMOUNT = r"([+-]?\d+(?:\.\d+)?)亿元"


def strip(c: Column) -> Column:
    """Without white space at both ends, tabs and wide spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without a match, or if the group took no part."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def first_rule(c: Column, rules: Sequence[tuple[Sequence[str], str]], default: str | None = None) -> Column:
    """The code of the first rule of which a keyword occurs in c."""
    out = F.lit(default).cast("string")
    for keywords, code in reversed(rules):
        hit = F.lit(False)
        for k in keywords:
            hit = hit | c.contains(k)
        out = F.when(hit, code).otherwise(out)
    return out


def split_parts(c: Column) -> Column:
    """Trimmed non-empty parts between semicolons of either width."""
    return F.filter(F.transform(F.split(c, PARTS), strip), lambda p: p != "")


def key_values(c: Column) -> Column:
    """Map of `key：value` parts, each split once; of equal keys the last one counts, at the first one's place."""
    parts = F.filter(F.split(c, PARTS), lambda p: p.contains("："))
    pairs = F.transform(parts, lambda p: F.struct(strip(F.substring_index(p, "：", 1)).alias("k"), strip(F.substring(p, F.instr(p, "：") + 1, F.length(p))).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda x: x.k))
    last = F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda x: x.k == k), -1).v)
    return F.map_from_arrays(keys, last)


def parse_date(c: Column) -> Column:
    """The first date like 2024-5-1 or 2024年5月1; null if there is no such day."""
    p = r"(\d{4})[-年](\d{1,2})[-月](\d{1,2})"
    y, m, d = (found(c, p, i) for i in (1, 2, 3))
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")))


def parse_year(c: Column) -> Column:
    """The first year of the 20th or 21st century."""
    return found(c, r"((?:19|20)\d{2})").cast("int")


def parse_decimal(c: Column, places: int = 4) -> Column:
    """The first number, grouped or not."""
    return F.regexp_replace(found(c, r"([+-]?\d[\d,]*(?:\.\d+)?)"), ",", "").try_cast(f"decimal(24,{places})")


def parse_stock_code(c: Column) -> Column:
    """An exchange code in brackets, upper case."""
    return F.upper(found(c, r"[（(]([0-9]{4,6}\.[A-Za-z]+)[）)]"))


def name_key(c: Column) -> Column:
    """What names are matched by: no white space, lower case."""
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def organization_key(c: Column) -> Column:
    """What organizations are matched by: no white space or punctuation, lower case, 255 characters at most."""
    return F.substring(F.lower(F.regexp_replace(c, r"(?U)[\s·•,，.。()（）\-—_、/]+", "")), 1, 255)


def amount_100m(c: Column) -> Column:
    """The first amount given in units of 100 million."""
    return found(c, AMOUNT).try_cast("decimal(20,4)")


def scaled_amount(value: Column, unit: Column) -> tuple[Column, Column]:
    """Amount in units of 100 million, and the unit's code; exact decimals, 万亿 counts 10,000."""
    factor = F.when(unit.startswith("万亿"), F.lit(10_000)).otherwise(F.lit(1)).cast("decimal(10,0)")
    code = F.when(unit.endswith("美元"), "USD_100M").when(unit.endswith("元"), "CNY_100M")
    return (value.cast("decimal(20,4)") * factor).cast("decimal(28,4)"), code


def split_top_level(c: Column, separators: str = "、，,") -> Column:
    """Trimmed non-empty parts between separators outside brackets; a closing bracket without an opening one is text.

    One fold over the characters keeps depth, the part so far and the parts.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, ch: Column) -> Column:
        depth = F.when(ch.isin("(", "（"), s.depth + 1).when(ch.isin(")", "）"), F.greatest(s.depth - 1, F.lit(0))).otherwise(s.depth)
        cut = (s.depth == 0) & ch.isin(*separators)
        return F.struct(depth.alias("depth"), F.when(cut, "").otherwise(F.concat(s.part, ch)).alias("part"), F.when(cut, F.concat(s.parts, F.array(s.part))).otherwise(s.parts).alias("parts"))

    ended = F.aggregate(F.split(c, ""), start, step, lambda s: F.concat(s.parts, F.array(s.part)))
    return F.filter(F.transform(ended, strip), lambda p: p != "")


def without_brackets(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"[（(][^（）()]*[）)]", ""))


def organization_and_role(c: Column, markers: Sequence[str]) -> tuple[Column, Column]:
    """Text before the last occurrence of the first marker that occurs after the start, and the text from there; else all and null."""
    name, role = c, F.lit(None).cast("string")
    for m in reversed(markers):
        p = rf"(?s)^(.+){m}"
        at = F.length(F.regexp_extract(c, p, 1))
        name = F.when(at > 0, F.substring(c, F.lit(1), at)).otherwise(name)
        role = F.when(at > 0, F.substring(c, at + 1, F.length(c))).otherwise(role)
    return without_brackets(name), strip(role)


def share_of(text: str, name: str) -> Column:
    """Percentage that the person of column name holds, by text of the form <name>持股…%. The name is data, not a pattern."""
    return F.expr(rf"try_cast(nullif(regexp_extract(`{text}`, concat('\\Q', replace(`{name}`, '\\E', ''), '\\E持股约?(\\d+(?:\\.\\d+)?)%'), 1), '') as decimal(9,4))")


def page_number(c: Column) -> Column:
    return c.rlike(r"^\s*(?:第\s*)?\d{1,4}(?:\s*页)?\s*$")
