"""Batch and workflow state: manifests, histories, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.operators.workflow import answer_history, rolled_up, sessions
from quarrystone.plans.registry import query
from quarrystone.sources.shared import new_path
from quarrystone.sources.tables import table
from quarrystone.streaming import timed


@query(
    "manifest_rollup",
    """WITH m AS (SELECT user_id % 20 AS batch_id, user_id, CASE WHEN bool_or(event_type = 'error') THEN 'FAILED' WHEN count(*) > 2 THEN 'SUCCESS' ELSE 'PENDING' END AS status FROM events GROUP BY 1, 2)
    SELECT batch_id, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'PENDING') AS pending,
    CASE WHEN count(*) FILTER (status = 'SUCCESS') = count(*) THEN 'SUCCESS' WHEN count(*) FILTER (status = 'SUCCESS') > 0 THEN 'PARTIAL_FAILED' ELSE 'FAILED' END AS status FROM m GROUP BY 1""",
)
def manifest_rollup(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("batch_id"), "user_id").agg(F.bool_or(F.col("event_type") == "error").alias("bad"), F.count("*").alias("n"))
    return rolled_up(per.select("batch_id", F.when(F.col("bad"), "FAILED").when(F.col("n") > 2, "SUCCESS").otherwise("PENDING").alias("status")))


@query(
    "qa_history_merge",
    """WITH a AS (SELECT conv_id, turn, substr(text, 1, 1) AS question, trim(text) AS answer FROM conversations WHERE trim(text) <> '')
    SELECT conv_id, question, min(turn) AS position, sha256(arg_max(answer, turn)) AS answer_sha256 FROM a GROUP BY 1, 2""",
)
def qa_history_merge(spark: SparkSession, d: str) -> DataFrame:
    """A new answer takes its question's place, a new question comes last, a blank answer changes nothing."""
    rows = table(spark, d, "conversations").select("conv_id", F.substring("text", 1, 1).alias("question"), F.col("turn").alias("position"), F.col("text").alias("answer"))
    return answer_history(rows, "conv_id").select("conv_id", "question", "position", F.sha2("answer", 256).alias("answer_sha256"))


@query(
    "window_tumbling",
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2""",
)
def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = F.window("ts", "1 hour")
    rows = table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "cents")


@query(
    "sessionize",
    """WITH g AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, TRUE) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY 1, 2""",
)
def sessionize(spark: SparkSession, d: str) -> DataFrame:
    return sessions(table(spark, d, "events"), "user_id", 30)


@query(
    "latest_version",
    """SELECT o_custkey, max(o_orderkey) + 1 AS next_version, arg_max(o_orderstatus, o_orderkey) AS latest FROM orders GROUP BY 1""",
)
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg((F.max("o_orderkey") + 1).alias("next_version"), F.max_by("o_orderstatus", "o_orderkey").alias("latest"))


@query(
    "resume_targets",
    """SELECT user_id FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) WHERE last <> 'purchase' AND user_id > 100 ORDER BY user_id LIMIT 50""",
)
def resume_targets(spark: SparkSession, d: str) -> DataFrame:
    """Ids that are not done yet, after a given one, in order."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.where("last <> 'purchase' and user_id > 100").select("user_id").orderBy("user_id").limit(50)


@query(
    "event_sequence",
    """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events""",
)
def event_sequence(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", "user_id", F.row_number().over(w).cast("long").alias("sequence"))


@query(
    "answered_actions",
    """WITH RECURSIVE s AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events),
    f AS (SELECT user_id, n, event_id, CASE WHEN ok THEN 'EXECUTED' ELSE 'FAILED' END AS outcome, CASE WHEN ok THEN event_id END AS held, ms AS since FROM s WHERE n = 1
      UNION ALL SELECT s.user_id, s.n, s.event_id, CASE WHEN held IS NOT NULL AND s.ms < since + 10800000 THEN 'REPLAYED' WHEN s.ok THEN 'EXECUTED' ELSE 'FAILED' END,
        CASE WHEN held IS NOT NULL AND s.ms < since + 10800000 THEN held WHEN s.ok THEN s.event_id END, CASE WHEN held IS NOT NULL AND s.ms < since + 10800000 THEN since ELSE s.ms END FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1)
    SELECT user_id, event_id, outcome, coalesce(held, -1) AS result_of FROM f""",
)
def answered_actions(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of actions, an error being one that failed: results stand for 180 minutes, failures for none."""
    path = f"{d.rstrip('/')}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")  # a pattern may stand for a file or a folder
    actions = stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("action_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"))
    out = new_path(spark, "answers")
    timed.answered(actions, late="3650 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("key").alias("user_id"), F.col("action_id").alias("event_id"), "outcome", F.coalesce("result_of", F.lit(-1)).alias("result_of"))
