"""Streams of events: windows, numbered events of a workflow, idempotent actions, and states that only move forward."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
#: Steps of a workflow, and what each needs: the fourth one waits for both the second and the third.
NEEDS = {"STARTED": (), "PROFILED": ("STARTED",), "RESEARCHED": ("STARTED",), "DESIGNED": ("PROFILED", "RESEARCHED"), "REVIEWED": ("DESIGNED",)}


def read_events(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, some at a time."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """start, event_type, n, total of tumbling windows; events later than the watermark are left out."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def once(actions: DataFrame, key: str = "key", within: str = "180 minutes") -> DataFrame:
    """Each key's first action within the time; repetitions are dropped and the state behind them forgotten afterwards."""
    return actions.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def numbered(events: DataFrame) -> DataFrame:
    """workflow_id, event_id, sequence: a running number per workflow, in order of time within a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        rows = pd.DataFrame({"workflow_id": key[0], "event_id": rows["event_id"].to_numpy(), "sequence": range(last + 1, last + 1 + len(rows))})
        state.update((last + len(rows),))
        yield rows

    return events.groupBy("workflow_id").applyInPandasWithState(step, "workflow_id long, event_id long, sequence long", "last long", "append", GroupStateTimeout.NoTimeout)


def advanced(events: DataFrame) -> DataFrame:
    """workflow_id, step, accepted: steps of workflows (workflow_id, ts, step); one whose needs aren't met, or that was taken before, is refused."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = set(filter(None, state.get[0].split(","))) if state.exists else set()
        rows = []
        for s in pd.concat(list(batches)).sort_values("ts")["step"]:
            ok = s in NEEDS and s not in done and all(n in done for n in NEEDS[s])
            rows.append((key[0], s, ok))
            if ok:
                done.add(s)
        state.update((",".join(sorted(done)),))
        yield pd.DataFrame(rows, columns=["workflow_id", "step", "accepted"])

    return events.groupBy("workflow_id").applyInPandasWithState(run, "workflow_id long, step string, accepted boolean", "done string", "append", GroupStateTimeout.NoTimeout)


def resumable(chunks: DataFrame, cached: DataFrame, model: str, dimensions: int, source_hash: str) -> tuple[DataFrame, DataFrame]:
    """Chunks still to embed, and cached vectors that may be used again: same model, size and source, one valid row per chunk."""
    fine = (F.size("vector") == dimensions) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    same = cached.where((F.col("model") == model) & (F.col("source_hash") == source_hash) & fine)
    single = same.join(same.groupBy("chunk_id").count().where("count = 1").select("chunk_id"), "chunk_id", "left_semi")
    use = single.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return chunks.join(use.select("chunk_id"), "chunk_id", "left_anti"), use
