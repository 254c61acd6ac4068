"""Structured Streaming: cumulative route counters, resumable requests, event-time windows, per-trajectory state."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memloom.session import ship


def route_counts(calls: DataFrame) -> DataFrame:
    """Running totals per route; to be written in complete mode."""
    return calls.groupBy(F.coalesce(F.nullif(F.trim("route"), F.lit("")), F.lit("unknown")).alias("route")).agg(F.count(F.lit(1)).alias("calls"))


def windowed(events: DataFrame, time: str, length: str, late: str, keys: list[str]) -> DataFrame:
    """Counts and sums in event-time windows; rows later than ``late`` are dropped by the watermark."""
    t = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    g = t.groupBy(F.window("__t", length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def unseen(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Rows whose key did not occur within the watermark: bounded state."""
    return stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late).dropDuplicatesWithinWatermark([key]).drop("__t")


def process_once(requests: DataFrame, key: str, done_path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Runs ``work`` on the requests whose key has not come before and keeps the results as Parquet under ``done_path``: each key is
    answered once. Keys that have come are the query's state, so no batch reads earlier results; a batch that is run again after a failure
    overwrites its own folder (the columns ``run`` and ``batch`` of the results). Only where results are there but the checkpoint is new are their keys excluded by a join."""
    spark = requests.sparkSession
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    exists = lambda p: path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(p))
    todo = requests.dropDuplicates([key])
    if exists(done_path) and not exists(f"{checkpoint}/commits"):
        todo = todo.join(spark.read.parquet(done_path).select(key).distinct(), key, "left_anti").select(*requests.columns)

    def batch(df: DataFrame, batch_id: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{done_path}/run={run}/batch={batch_id}")

    return todo.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# States of a trajectory.
PENDING, GENERATING, TOOLS, DONE = "pending", "generating", "tools", "done"


def trajectory_states(steps: DataFrame) -> DataFrame:
    """(trajectory, state, turns, calls, after each batch): a trajectory generates, waits for its tools, generates again, and is done at its
    ``final`` step. ``steps``: trajectory, seq, kind (generate, call, result, final). State per trajectory is four values."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, turns, calls, waiting = state.get if state.exists else (PENDING, 0, 0, 0)
        for kind in pd.concat(list(frames)).sort_values("seq")["kind"]:
            if now == DONE:
                break
            if kind == "generate":
                now, turns = GENERATING, turns + 1
            elif kind == "call":
                now, calls, waiting = TOOLS, calls + 1, waiting + 1
            elif kind == "result":
                waiting = max(0, waiting - 1)
                now = TOOLS if waiting else GENERATING
            elif kind == "final":
                now = DONE
        state.update((now, turns, calls, waiting))
        yield pd.DataFrame({"trajectory": [key[0]], "state": [now], "turns": [turns], "calls": [calls]})

    ship(steps.sparkSession)
    kind = steps.schema["trajectory"].dataType.simpleString()
    return steps.groupBy("trajectory").applyInPandasWithState(
        advance, f"trajectory {kind}, state string, turns long, calls long", "now string, turns long, calls long, waiting long", "update", GroupStateTimeout.NoTimeout
    )
