"""Reading the driver's parquet tables; a table is a file or a folder of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`, in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to all tasks: a small file is read by one task, however much work its rows are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def by_key(df: DataFrame, *keys: str, rows: int = 250_000) -> DataFrame:
    """Rows dealt by keys into as many partitions as their count asks for, so that what a task sorts doesn't grow with the table."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // rows + 1)
    return df.repartition(n, *keys)
