"""Graph rows as callers see them, and properties on their way into storage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.strict import clean_text
from quarrystone.operators.graph import first_kept, neighbourhood

LABELS = ("name", "enterprise_name", "organization_name", "description")


def allowed_properties(properties: Column, kind: Column, allowed: Mapping[str, Sequence[str]]) -> Column:
    """A property map cut down to what its node type may show; nothing for unknown types."""
    table = F.create_map(*[x for k, names in allowed.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in names]))])
    keys = F.coalesce(F.try_element_at(table, kind), F.array().cast("array<string>"))
    return F.map_filter(properties, lambda k, _: F.array_contains(keys, k))


def label(properties: Column, node_id: Column) -> Column:
    """The first property of LABELS that isn't blank, else the id."""
    return F.coalesce(*[clean_text(F.try_element_at(properties, F.lit(n))) for n in LABELS], node_id)


def view(nodes: DataFrame, edges: DataFrame, allowed: Mapping[str, Sequence[str]], edge_types: Sequence[str], most: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges for display. Of repeated ids the first counts; an edge without id is named by its ends and type; edges of other types, and those whose ends aren't shown, are left out. One node beyond the limit tells that there are more."""
    first = first_kept(nodes, "node_id", "position")
    n = F.row_number().over(Window.orderBy("position"))
    shown = first.orderBy("position").limit(most + 1).withColumn("_n", n)
    more = F.max("_n").over(Window.partitionBy()) > most
    shown = shown.withColumn("truncated", more).where(F.col("_n") <= most)
    out = shown.select("node_id", "node_type", label(F.col("properties"), F.col("node_id")).alias("label"), allowed_properties(F.col("properties"), F.col("node_type"), allowed).alias("properties"), "truncated")
    named = edges.where(F.col("relation_type").isin(*edge_types)).withColumn("edge_id", F.coalesce("edge_id", F.concat_ws("|", "source", "relation_type", "target")))
    named = first_kept(named, "edge_id", "position")
    ids = out.select("node_id")
    kept = named.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return out, kept.select("edge_id", "source", "target", "relation_type")


def scope_guard(asked: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """root, node_id, verdict: NOT_FOUND if there is no such node, FORBIDDEN if the root doesn't reach it within depth, else OK."""
    known = nodes.select("node_id", F.lit(True).alias("_known")).distinct()
    near = neighbourhood(edges, asked.select("root").distinct(), depth).select("root", F.col("node").alias("node_id"), F.lit(True).alias("_near"))
    rows = asked.join(known, "node_id", "left").join(near, ["root", "node_id"], "left")
    return rows.select("root", "node_id", F.when(F.col("_known").isNull(), "NOT_FOUND").when(F.col("_near").isNull(), "FORBIDDEN").otherwise("OK").alias("verdict"))


def flattened(own: Column, nested: Column) -> Column:
    """Properties with nested ones beside them: an own key wins over a nested one of the same name."""
    return F.map_concat(own, F.map_filter(nested, lambda k, _: ~F.map_contains_key(own, k)))


def storable(c: Column, kind: str) -> Column:
    """value, error of a property as it can be stored: numbers must be finite, structures become JSON with sorted keys."""
    if kind in ("double", "float"):
        bad = F.isnan(c) | (F.abs(c) == float("inf"))
        return F.struct(F.when(~bad, c.cast("string")).alias("value"), F.when(bad, "NOT_FINITE").alias("error"))
    if kind.startswith("map"):
        c = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    elif kind.startswith(("array", "struct")):
        c = F.to_json(c)
    return F.struct(c.cast("string").alias("value"), F.lit(None).cast("string").alias("error"))


#: Where fields of records go, in the order in which rules are tried.
TREATMENTS = ("IGNORE", "MYSQL_ONLY", "DIRECT", "LLM", "PENDING", "RULE")


def treatment(table: Column, field: Column, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> Column:
    """The treatment of the first rule (treatment, tables, fields) that fits; no tables or no fields means all of them."""
    out = F.lit("DIRECT")
    for name, tables, fields in reversed(rules):
        fits = (table.isin(*tables) if tables else F.lit(True)) & (field.isin(*fields) if fields else F.lit(True))
        out = F.when(fits, name).otherwise(out)
    return out


def field_scan(df: DataFrame, table: str, key: str, rules: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> DataFrame:
    """key, field, value, treatment of every field that holds something."""
    names = [c for c in df.columns if c != key]
    long = df.select(key, *[F.col(c).cast("string").alias(c) for c in names]).unpivot([key], names, "field", "value")
    long = long.where(clean_text(F.col("value")).isNotNull())
    return long.withColumn("treatment", treatment(F.lit(table), F.col("field"), rules))
