"""Contracts of results: what a JSON result must hold, as violations in rows; read-only gates; optimistic locks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READS = re.compile(r"^\s*(?:select|show|describe|desc|explain)\b", re.IGNORECASE)
WRITES = re.compile(r"\b(?:insert|update|delete|replace|merge|drop|alter|create|truncate|grant|revoke|call|load|set|lock|into\s+(?:outfile|dumpfile))\b", re.IGNORECASE)


def is_read_only(sql: str) -> bool:
    """Whether a statement only reads: one statement, no comments, no word that writes."""
    body = re.sub(r"'(?:[^']|'')*'|`[^`]*`", "''", sql)
    return bool(READS.match(body)) and not re.search(r";|--|/\*|#", body) and not WRITES.search(body)


def violations(df: DataFrame, key: str, column: str, required: Sequence[str], enums: Mapping[str, Sequence[str]], most: Mapping[str, int], evidence: str | None = None, allowed: Column | None = None) -> DataFrame:
    """key, field, problem of JSON objects: not an object, unknown or missing fields, values outside an enum, lists that are too long, evidence that isn't allowed."""
    fields = sorted({*required, *enums, *most, *([evidence] if evidence else [])})
    parsed = F.try_parse_json(F.col(column))
    keys = F.json_object_keys(F.col(column))
    text = {f: F.get_json_object(F.col(column), f"$.{f}") for f in fields}
    lists = {f: F.from_json(text[f], "array<string>") for f in [*most, *([evidence] if evidence else [])]}

    def problem(field: str, code: str, when: Column) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(code).alias("problem")))

    broken = parsed.isNull() | keys.isNull()
    rows = [problem("", "NOT_AN_OBJECT", broken), problem("", "UNKNOWN_FIELD", F.size(F.array_except(keys, F.array(*[F.lit(f) for f in fields]))) > 0)]
    rows += [problem(f, "MISSING", ~broken & (text[f].isNull() | (F.trim(text[f]) == ""))) for f in required]
    rows += [problem(f, "ENUM", ~text[f].isin(*values)) for f, values in enums.items()]
    rows += [problem(f, "TOO_MANY", F.size(lists[f]) > n) for f, n in most.items()]
    if evidence and allowed is not None:
        rows.append(problem(evidence, "EVIDENCE", F.size(F.array_except(lists[evidence], allowed)) > 0))
    return df.select(key, F.explode(F.array_compact(F.array(*rows))).alias("x")).select(key, "x.field", "x.problem")


def compare_and_set(current: DataFrame, updates: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """The table after updates whose expected version is still the current one, each raising it by one; and updates that come too late. Of several updates of a version the first by `position` counts."""
    first = updates.groupBy(key, "expected").agg(F.min_by(F.struct(value, "position"), "position").alias("_u"))
    rows = current.join(first.withColumnRenamed("expected", "version"), [key, "version"], "left")
    hit = F.col("_u").isNotNull()
    after = rows.select(key, F.when(hit, F.col(f"_u.{value}")).otherwise(F.col(value)).alias(value), F.when(hit, F.col("version") + 1).otherwise(F.col("version")).alias("version"))
    used = rows.where(hit).select(key, F.col("_u.position").alias("position"))
    return after, updates.join(used, [key, "position"], "left_anti")


def shared_columns(schemas: DataFrame) -> DataFrame:
    """first, second, column_name: columns of equal name and type in two tables (table_name, column_name, data_type), ids and keys only."""
    a = schemas.where(F.col("column_name").endswith("_id")).select("column_name", "data_type", F.col("table_name").alias("first"))
    b = a.withColumnRenamed("first", "second")
    return a.join(b, ["column_name", "data_type"]).where("first < second").select("first", "second", "column_name")


def masked_sample(c: Column, field: str, most: int = 500) -> Column:
    """A sample value by what its field's name says it is, cut to so many characters."""
    name = field.lower()
    if "mail" in name:
        c = F.regexp_replace(c, r"^(.)[^@]*(@.*)$", "$1***$2")
    elif re.search("phone|mobile|tel|identity|id_card|passport", name):
        c = F.regexp_replace(c, r"^(.{3}).*(.{2})$", "$1****$2")
    elif re.search("card|account|bank", name):
        c = F.regexp_replace(c, r"^.*(.{4})$", "****$1")
    elif re.search("address|location", name):
        c = F.concat(F.substring(c, 1, 6), F.lit("***"))
    return F.substring(c, 1, most)
