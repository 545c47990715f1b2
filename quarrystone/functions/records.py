"""Records whose keys and order of keys vary: canonical JSON, and values by any of several names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def canonical(c: Column, kind: DataType) -> Column:
    """The same value with fields and keys in order at all depths; nulls stay null."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*[canonical(c.getField(f.name), f.dataType).alias(f.name) for f in fields])) if fields else c
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(e.getField("key").cast("string").alias("key"), canonical(e.getField("value"), kind.valueType).alias("value")))
        names = F.array_sort(F.transform(entries, lambda e: e.getField("key")))
        ordered = F.transform(names, lambda n: F.struct(n.alias("key"), F.get(F.filter(entries, lambda e: e.getField("key") == n), F.lit(0)).getField("value").alias("value")))
        return F.map_from_entries(ordered)
    return c


def canonical_json(c: Column, kind: DataType) -> Column:
    """JSON of a value; records that differ only in the order of keys, at any depth, have the same. Null values are left out."""
    return F.to_json(canonical(c, kind))


def loose_key(c: Column) -> Column:
    """A key without case, underscores, dashes and spaces."""
    return F.regexp_replace(F.lower(c), r"[_\-\s]", "")


def loose_value(record: Column, *names: str) -> Column:
    """The value of the first of the names that a record (map of strings) holds and that isn't blank: each name as it is, then without case and underscores.

    Keys that become equal count in their own order.
    """

    def kept(v: Column) -> Column:
        return F.when(F.trim(v) != "", v)

    def alike(name: str) -> Column:
        same = F.filter(F.map_entries(record), lambda e: loose_key(e.getField("key")) == loose_key(F.lit(name)))
        return F.get(F.filter(F.transform(F.array_sort(same), lambda e: kept(e.getField("value"))), lambda v: v.isNotNull()), F.lit(0))

    return F.coalesce(*[v for name in names for v in (kept(F.try_element_at(record, F.lit(name))), alike(name))])
