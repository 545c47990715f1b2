"""Which columns hold only values of which other columns: candidates for foreign keys where no catalogue names them.

Every column is a bit. Values of all columns meet once, each folded to the set of columns that hold it before it is shuffled, so a
value that fills a third of all rows is one row a task. Values then fold to the sets themselves, which are few, and pairs of columns
are counted over sets, never over values.

Edge cases. Nulls are no values. A column without values takes no part, neither as dependent nor as referenced. Whole numbers, texts,
dates, timestamps and booleans are compared among their own kind, whatever their width; fractions, arrays, maps and structs are left
out. Texts of over 64 characters are compared by SHA-256. Equal tables include each other, both ways.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns a word of a set holds.
BITS = 62
KINDS = ((T.IntegralType, "whole"), (T.StringType, "text"), (T.DateType, "date"), (T.TimestampType, "time"), (T.BooleanType, "truth"))


def kind_of(t: T.DataType) -> str | None:
    return next((name for kind, name in KINDS if isinstance(t, kind)), None)


def comparable(tables: Mapping[str, DataFrame]) -> list[tuple[str, str, str]]:
    """table, column and kind of all columns that can be compared."""
    return [(t, f.name, kind) for t, df in tables.items() for f in df.schema if (kind := kind_of(f.dataType))]


def _value(c: Column, kind: str) -> Column:
    if kind != "text":
        return c.cast("string")
    return F.when(F.length(c) > 64, F.concat(F.lit("sha256:"), F.sha2(c, 256))).otherwise(c)


def _word(n: int) -> str:
    return f"_set{n}"


def column_sets(tables: Mapping[str, DataFrame]) -> DataFrame:
    """columns (numbers in the order of `comparable`), n: how many values are held by just these columns."""
    columns = comparable(tables)
    words = range(-(-len(columns) // BITS))

    def entries(name: str, df: DataFrame) -> DataFrame:
        own = [(i, c, kind) for i, (t, c, kind) in enumerate(columns) if t == name]
        bits = {i: [F.lit(1 << i % BITS if i // BITS == w else 0).cast("long").alias(_word(w)) for w in words] for i, _, _ in own}
        cells = F.array(*[F.struct(F.lit(kind).alias("kind"), _value(F.col(f"`{c}`"), kind).alias("value"), *bits[i]) for i, c, kind in own])
        return df.select(F.explode(cells).alias("x")).select("x.*").where("value is not null")

    parts = [entries(t, df) for t, df in tables.items() if any(t == name for name, _, _ in columns)]
    held = [_word(w) for w in words]
    values = reduce(DataFrame.unionByName, parts).groupBy("kind", "value").agg(*[F.bit_or(w).alias(w) for w in held])
    sets = values.groupBy(*held).agg(F.count("*").alias("n"))
    members = [F.when(F.col(_word(i // BITS)).bitwiseAND(F.lit(1 << i % BITS)) != 0, F.lit(i)) for i in range(len(columns))]
    return sets.select(F.array_compact(F.array(*members)).alias("columns"), "n")


def filled(tables: Mapping[str, DataFrame]) -> DataFrame:
    """column (its number), filled: rows that hold a value; one pass over each table."""
    columns = comparable(tables)
    parts = []
    for name, df in tables.items():
        own = [(i, c) for i, (t, c, _) in enumerate(columns) if t == name]
        if own:
            counts = [F.struct(F.lit(i).alias("column"), F.count(F.col(f"`{c}`")).alias("filled")) for i, c in own]
            parts.append(df.agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)


def inclusions(tables: Mapping[str, DataFrame], least: float = 1.0) -> DataFrame:
    """dependent, referenced (table.column), shared, distinct_values, referenced_is_key.

    All pairs of which at least this share of the dependent's distinct values occurs in the referenced column; 1 gives exact
    inclusions, less those that a few wrong keys break. A column is a key if no value occurs twice in it.
    """
    columns = comparable(tables)
    if not columns:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "dependent string, referenced string, shared long, distinct_values long, referenced_is_key boolean")
    sets = column_sets(tables)
    pairs = sets.select(F.explode("columns").alias("a"), "columns", "n").select("a", F.explode("columns").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    # a row a pair of columns at most, whatever the tables hold
    own = pairs.where("a = b").select("a", F.col("shared").alias("distinct_values"))
    target = own.select(F.col("a").alias("b"), F.col("distinct_values").alias("_of"))
    found = pairs.where("a <> b").join(F.broadcast(own), "a").where(F.col("shared") >= F.lit(float(least)) * F.col("distinct_values"))
    found = found.join(F.broadcast(target), "b").join(F.broadcast(filled(tables).withColumnRenamed("column", "b")), "b")
    names = F.array(*[F.lit(f"{t}.{c}") for t, c, _ in columns])
    return found.select(F.get(names, F.col("a")).alias("dependent"), F.get(names, F.col("b")).alias("referenced"), "shared", "distinct_values", (F.col("_of") == F.col("filled")).alias("referenced_is_key"))
