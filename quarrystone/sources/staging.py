"""Reading and writing staging records: CSV and JSON with checks, evidence of cells, file hashes, batches that can be replaced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import strip

STAGING = "import_batch_id long, data_dimension string, source_sequence int, person_name string, core_enterprise_name string, source_file_name string, sheet_name string, source_row_number int, raw_cells string"
DIMENSIONS = ("PERSON", "ENTERPRISE", "FAMILY", "SOCIAL")
CODE = r"^(?=.{6,16}$)(?=.*[A-Za-z])(?=.*\d)[A-Za-z0-9]+$"


def read_staging(spark: SparkSession, path: str) -> DataFrame:
    """Staging rows from CSV. Fields become typed, empty ones null, cells a map; `problem` names what is wrong with a row."""
    names = [c.split(" ") for c in STAGING.split(", ")]
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{n} string" for n, _ in names), quote='"', escape='"', multiLine=True)
    typed = [F.nullif(strip(F.col(n)), F.lit("")).try_cast(t).alias(n) for n, t in names if n != "raw_cells"]
    cells = F.from_json("raw_cells", "map<string,string>")
    bad = [F.when(F.col(n).isNotNull() & (strip(F.col(n)) != "") & F.col(n).try_cast(t).isNull(), f"{n}: no {t}") for n, t in names if t in ("long", "int")]
    empty = [F.when(F.coalesce(strip(F.col(n)), F.lit("")) == "", f"{n}: missing") for n in ("person_name", "core_enterprise_name")]
    return raw.select(*typed, cells.alias("raw_cells"), F.coalesce(*bad, *empty, F.when(cells.isNull(), "raw_cells: no JSON object"), F.lit(None)).alias("problem"))


def write_staging(df: DataFrame, path: str) -> None:
    """CSV with all fields quoted and compact JSON cells."""
    df.withColumn("raw_cells", F.to_json("raw_cells")).write.csv(path, header=True, quoteAll=True, escape='"', mode="overwrite")


def column_letters(n: Column) -> Column:
    """Letters of a sheet's column, from 1: A, Z, AA."""
    first = F.when(n > 26, F.char(F.floor((n - 1) / 26).cast("int") + 64)).otherwise("")
    return F.concat(first, F.char(((n - 1) % 26 + 65).cast("int")))


def evidence(rows: DataFrame) -> DataFrame:
    """One row per non-blank cell, with its reference and a locator file!sheet!A1. rows: file_name, sheet_name, source_row_number, header, cells (arrays)."""
    cells = rows.select("file_name", "sheet_name", "source_row_number", F.posexplode(F.arrays_zip("header", "cells")).alias("position", "x"))
    ref = F.concat(column_letters(F.col("position") + 1), F.col("source_row_number").cast("string"))
    found = cells.select("file_name", "sheet_name", "source_row_number", F.col("x.header").alias("column_name"), ref.alias("cell_reference"), F.col("x.cells").alias("original_text"), F.lit("S0").alias("source_level"))
    return found.where(strip(F.col("original_text")) != "").withColumn("source_locator", F.concat_ws("!", "file_name", "sheet_name", "cell_reference"))


def checked_header(header: Sequence[str], required: Sequence[str]) -> list[str]:
    """The trimmed header; an error if a name is empty, repeated or missing. The mark 、 stands for 序号."""
    names = ["序号" if (h or "").strip() == "、" else (h or "").strip() for h in header]
    if "" in names or len(set(names)) < len(names) or (missing := [r for r in required if r not in names]):
        raise ValueError(f"header must be complete and unique: {names}" + (f", missing {missing}" if "" not in names and len(set(names)) == len(names) else ""))
    return names


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of each file, hashed where it is read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def counts_as_expected(df: DataFrame, expected: dict[str, int]) -> DataFrame:
    """dimension, rows, expected, ok."""
    want = df.sparkSession.createDataFrame([*expected.items()], "data_dimension string, expected long")
    got = df.groupBy("data_dimension").agg(F.count("*").alias("rows"))
    return want.join(got, "data_dimension", "full_outer").select("data_dimension", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("expected", F.lit(0)).alias("expected")).withColumn("ok", F.col("rows") == F.col("expected"))


def replace_batch(df: DataFrame, path: str) -> None:
    """Writes the batches that df holds in place of earlier ones; other batches stay. A rerun gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("import_batch_id").parquet(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold one JSON array; rows that are no such record come with `problem`."""
    raw = spark.read.json(path, schema=f"{schema}, _bad string", multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return raw.withColumn("problem", F.when(F.col("_bad").isNotNull(), "INVALID_JSON")).drop("_bad")


def read_vectors(spark: SparkSession, path: str, dimensions: int) -> DataFrame:
    """chunk_id, vector, problem from JSON lines: bad line, blank or repeated id, wrong length, or a component that is not finite."""
    raw = spark.read.json(path, schema="chunk_id string, vector array<double>, _bad string", columnNameOfCorruptRecord="_bad")
    again = F.count("*").over(Window.partitionBy("chunk_id")) > 1
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    problem = F.when(F.col("_bad").isNotNull(), "INVALID_LINE").when(F.coalesce(strip(F.col("chunk_id")), F.lit("")) == "", "BLANK_ID").when(again, "DUPLICATE_ID").when(F.col("vector").isNull() | (F.size("vector") != dimensions), "DIMENSION").when(~fine, "NOT_FINITE")
    return raw.select("chunk_id", "vector", problem.alias("problem"))


def filename_metadata(name: Column) -> Column:
    """document_id, product_code, sales_code, product_name, error from names like D000001_AB1234_[code_]name_产品说明书.pdf."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?i)\.pdf$", ""), "_产品说明书$", "")
    parts = F.transform(F.split(stem, "_"), strip)
    code2, code3 = F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))
    has = (F.size(parts) >= 4) & code3.rlike(CODE)
    rest = F.array_join(F.slice(parts, F.when(has, 4).otherwise(3), F.size(parts)), "_")
    error = F.when(~F.lower(name).endswith(".pdf"), "NOT_PDF").when(F.size(parts) < 3, "TOO_FEW_FIELDS").when(~F.get(parts, F.lit(0)).rlike(r"(?i)^D\d{6}$"), "DOCUMENT_ID").when(~code2.rlike(CODE), "PRODUCT_CODE").when(rest == "", "PRODUCT_NAME")
    return F.struct(F.get(parts, F.lit(0)).alias("document_id"), code2.alias("product_code"), F.when(has, code3).otherwise(code2).alias("sales_code"), rest.alias("product_name"), error.alias("error"))
