"""State that ends with time: actions whose first result stands for a while, and branches that wait for each other.

Both keep a row a key, set a timer in event time when they begin, and are gone when it rings, so state is bounded by what happens
within the time. State is in the stream's checkpoint: a stream that starts again goes on where it stopped.

Edge cases. Rows of one batch are taken in order of time, then of id. Null keys are one key. Rows later than the watermark are left out by
Spark. A repetition at just the end of the time is a new action. A branch that comes twice counts once, with its first row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MINUTE = 60_000


def answered(actions: DataFrame, minutes: int = 180, late: str = "1 hour") -> DataFrame:
    """key, action_id, outcome, result_of of actions (key, action_id, ts, ok): EXECUTED, FAILED, or REPLAYED.

    The first action of a key that succeeds is executed, and its result (result_of) is returned to those that come within
    `minutes` of it. A failure leaves nothing behind, so the next action of the key is tried again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else None  # (action_id, milliseconds)
        parts = list(batches)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        # a key has few rows, so what is done once a key is kept to arrays: a frame's own steps cost more than the rows
        ids, times, fine = (rows[c].to_numpy() for c in ("action_id", "at", "ok"))
        order = np.lexsort((ids, times))
        ids, outcomes, results = ids[order], [], []
        for i, at, ok in zip(ids.tolist(), times[order].tolist(), fine[order].tolist(), strict=True):
            if held and at >= held[1] + minutes * MINUTE:
                held = None
            if held:
                outcomes.append("REPLAYED")
            elif ok:
                held = (int(i), int(at))
                outcomes.append("EXECUTED")
            else:
                outcomes.append("FAILED")
            results.append(held and held[0])
        ends = held and held[1] + minutes * MINUTE
        if held and ends > state.getCurrentWatermarkMs():
            state.update(held)
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()
        none = np.array([r is None for r in results])
        found = pd.arrays.IntegerArray(np.array([r or 0 for r in results], np.int64), none)
        yield pd.DataFrame({"key": [key[0]] * len(ids), "action_id": ids, "outcome": outcomes, "result_of": found})

    kind = actions.schema["key"].dataType.simpleString()
    timed = actions.withWatermark("ts", late).select("key", F.col("action_id").cast("long").alias("action_id"), "ts", F.unix_millis("ts").alias("at"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return timed.groupBy("key").applyInPandasWithState(step, f"key {kind}, action_id long, outcome string, result_of long", "action_id long, at long", "append", GroupStateTimeout.EventTimeTimeout)


def met(results: DataFrame, left: str, right: str, minutes: int, late: str = "1 hour") -> DataFrame:
    """key, left_id, right_id, outcome of branches' results (key, branch, result_id, ts).

    MET as soon as both branches have a result, the second within `minutes` of the first; TIMED_OUT, with the one result there is,
    once the watermark has passed that time. What comes afterwards begins anew.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(("side", "id", "at"), state.get, strict=True)) if state.exists else None
        rows = []

        def alone() -> tuple:
            return (key[0], held["id"] if held["side"] == left else None, held["id"] if held["side"] == right else None, "TIMED_OUT")

        if state.hasTimedOut:
            rows.append(alone())
            held = None
        else:
            for r in pd.concat(list(batches)).sort_values(["at", "result_id"]).itertuples():
                if held and r.at > held["at"] + minutes * MINUTE:
                    rows.append(alone())
                    held = None
                if held is None:
                    held = {"side": r.branch, "id": int(r.result_id), "at": int(r.at)}
                elif held["side"] != r.branch:
                    both = {held["side"]: held["id"], r.branch: int(r.result_id)}
                    rows.append((key[0], both[left], both[right], "MET"))
                    held = None
            if held and held["at"] + minutes * MINUTE < state.getCurrentWatermarkMs():
                rows.append(alone())
                held = None
        if held:
            state.update((held["side"], held["id"], held["at"]))
            state.setTimeoutTimestamp(max(held["at"] + minutes * MINUTE, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["key", "left_id", "right_id", "outcome"]).astype({"left_id": "Int64", "right_id": "Int64"})

    kind = results.schema["key"].dataType.simpleString()
    timed = results.where(F.col("branch").isin(left, right)).withWatermark("ts", late).select("key", "branch", F.col("result_id").cast("long").alias("result_id"), "ts", F.unix_millis("ts").alias("at"))
    return timed.groupBy("key").applyInPandasWithState(step, f"key {kind}, left_id long, right_id long, outcome string", "side string, id long, at long", "append", GroupStateTimeout.EventTimeTimeout)
