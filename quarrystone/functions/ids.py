"""Deterministic identifiers. The same parts give the same id in every run and on every partitioning."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrystone.functions.text import organization_key, strip

UNIT = "\x1f"
POINTS = uuid.UUID("82912bcd-f200-54db-9a39-58fe08228bd8")


def fingerprint(*parts: Column) -> Column:
    """First 24 hex digits of SHA-256 over trimmed parts with a unit separator between; a null part is an empty one."""
    return F.substring(F.sha2(F.concat_ws(UNIT, *[F.coalesce(strip(p.cast("string")), F.lit("")) for p in parts]), 256), 1, 24)


def keyed(prefix: str, key: Column) -> Column:
    """prefix:key; null for a blank key, which is an issue and no node."""
    k = strip(key.cast("string"))
    return F.when(k != "", F.concat(F.lit(f"{prefix}:"), k))


def person_id(key: Column) -> Column:
    return keyed("person", key)


def enterprise_id(key: Column) -> Column:
    return keyed("enterprise", key)


def reference_id(name: Column) -> Column:
    return F.concat(F.lit("enterprise-reference:"), fingerprint(organization_key(name)))


def segment_id(name: Column) -> Column:
    return F.concat(F.lit("market-segment:"), fingerprint(organization_key(name)))


def event_id(subject: Column, kind: Column, table: Column, key: Column) -> Column:
    """Date and source are left out on purpose: a corrected date keeps the event."""
    return F.concat(F.lit("event:"), fingerprint(subject, kind, table, key))


def relation_id(start: Column, kind: Column, end: Column, source: Column, table: Column, key: Column) -> Column:
    return F.concat(F.lit("relation:"), fingerprint(start, kind, end, source, table, key))


def issue_id(reason: Column, table: Column, key: Column, field: Column, message: Column) -> Column:
    return F.concat(F.lit("issue:"), fingerprint(reason, table, key, field, message))


def point_id(chunk: Column, namespace: uuid.UUID = POINTS) -> Column:
    """UUID version 5 of the trimmed chunk id; null for a blank one."""
    t = strip(chunk)
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(t, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    text = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.when(t != "", text)
