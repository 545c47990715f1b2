"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a session on one machine may do without, there /tmp is shared."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if re.match(r"local($|\[)", spark.sparkContext.master):
        return "file:///tmp/checkpoints"
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/quarrystone-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: a lost executor repeats no step before it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it doesn't exist."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []
