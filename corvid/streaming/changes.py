"""The change feed, agents and locks as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema: object, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def latest_versions(stream: DataFrame) -> DataFrame:
    """The last version of each path so far: one row of state a path."""
    return stream.groupBy("path").agg(F.max_by(F.struct("seq", "op", "size"), "seq").alias("v")).select("path", "v.*")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of an agent's heartbeats with no gap of `gap`: agent, first, last, beats. An agent counts as gone once its session has closed."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy("agent", w).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("beats")).drop("session_window")


def grants(requests: pd.DataFrame, holder: str | None, until: float, ttl: float) -> tuple[list[bool], str | None, float]:
    """Whether each request (in order of time) gets the lock: it is free, run out, or the asker's own (which extends it)."""
    out = []
    for agent, at in zip(requests["agent"], requests["at"], strict=True):
        ok = holder is None or holder == agent or at >= until
        if ok:
            holder, until = agent, at + ttl
        out.append(ok)
    return out, holder, until


def lock_grants(requests: DataFrame, ttl: float, late: str = "1 hour") -> DataFrame:
    """path, agent, at, granted of a batch or a stream of lock requests (path, agent, at in seconds); one holder and a time are kept for each path.

    A stream's state of a path goes once the watermark, ``late`` behind the latest request, has passed the end of its lock.
    """
    schema = "path string, agent string, at double, granted boolean"
    if not requests.isStreaming:

        def whole(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["at", "agent"], kind="stable")
            return part.assign(granted=grants(part, None, 0.0, ttl)[0])[["path", "agent", "at", "granted"]]

        return requests.groupBy("path").applyInPandas(whole, schema)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        holder, until = state.get if state.exists else (None, 0.0)
        part = pd.concat(list(parts)).sort_values(["at", "agent"], kind="stable")
        got, holder, until = grants(part, holder, until, ttl)
        state.update((holder, until))
        state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs()) + 1)
        yield part.assign(granted=got)[["path", "agent", "at", "granted"]]

    requests = requests.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    return requests.groupBy("path").applyInPandasWithState(step, schema, "holder string, until double", "append", GroupStateTimeout.EventTimeTimeout)
