"""State of batches, question histories and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import strip


def rolled_up(manifest: DataFrame) -> DataFrame:
    """success, failed, pending and status of each batch_id from rows with a status."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("SUCCESS", "FAILED", "PENDING")]
    df = manifest.groupBy("batch_id").agg(*counts, F.count("*").alias("n"))
    status = F.when(F.col("success") == F.col("n"), "SUCCESS").when(F.col("success") > 0, "PARTIAL_FAILED").otherwise("FAILED")
    return df.select("batch_id", "success", "failed", "pending", status.alias("status"))


def answer_history(rows: DataFrame, key: str) -> DataFrame:
    """key, question, position, answer: the last non-blank answer of each question, at its first place."""
    kept = rows.withColumn("answer", strip(F.col("answer"))).where("answer <> ''")
    return kept.groupBy(key, "question").agg(F.min("position").alias("position"), F.max_by("answer", "position").alias("answer"))


def sessions(events: DataFrame, key: str, minutes: int) -> DataFrame:
    """key, session, n, first, last: runs of events with no longer gap between neighbours."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(w)
    df = events.select(key, "ts", "event_id").withColumn("new", F.coalesce(gap > minutes * 60_000_000, F.lit(True)).cast("long"))
    df = df.withColumn("session", F.sum("new").over(w))
    return df.groupBy(key, "session").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
