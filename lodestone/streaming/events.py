"""Structured Streaming forms of the keyed-state operators, and windowed counts of late data (an addition of this engine)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limit(events: DataFrame, key: str, limit: int, seconds: int) -> DataFrame:
    """(key, id, count, allowed) of a stream of (key, id, at): a key's window starts with its first event and lasts
    `seconds`; state is (start, count) alone, and times out with the window. `at` must have a watermark."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (float("-inf"), 0)
        out = []
        for f in frames:
            f = f.sort_values(["at", "id"])
            for i, at in zip(f["id"], f["at"].astype("int64") / (1e9 if str(f["at"].dtype).endswith("ns]") or "ns" in str(f["at"].dtype) else 1e6)):
                start, n = (at, 1) if at - start >= seconds else (start, n + 1)
                out.append((k[0], i, n, n <= limit))
        state.update((start, n))
        expiry = int((start + seconds) * 1000)
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "id", "count", "allowed"])

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, "id", "at").groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, id long, count int, allowed boolean", "start double, n int", "append", GroupStateTimeout.EventTimeTimeout
    )


def transitions(events: DataFrame, key: str) -> DataFrame:
    """(previous, next) of a stream of (key, id, at, action): state is a key's last action."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for f in frames:
            for action in f.sort_values(["at", "id"])["action"]:
                if last is not None:
                    out.append((last, action))
                last = action
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["previous", "next"])

    return events.select(key, "id", "at", "action").groupBy(key).applyInPandasWithState(step, "previous string, next string", "last string", "append", GroupStateTimeout.NoTimeout)


def session_counts(events: DataFrame, key: str, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a key that end after an idle time."""
    return events.withWatermark("at", late).groupBy(key, F.session_window("at", gap).alias("session")).agg(F.count("*").alias("n"))


def window_counts(events: DataFrame, by: Column, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts in tumbling or sliding windows of event time."""
    return events.withWatermark("at", late).groupBy(F.window("at", length, slide or length).alias("window"), by).agg(F.count("*").alias("n"))


def ingest(files: DataFrame, process: Callable[[DataFrame], DataFrame], table: str, manifest: str, checkpoint: str):
    """Starts a query that takes each batch of new files into a table and its manifest; a batch that is run again adds
    nothing that the manifest has."""
    from lodestone.sources import files as f

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        known = spark.read.schema(f.MANIFEST).parquet(manifest)
        new = f.new_files(rows, known).persist()
        process(new).write.mode("append").parquet(table)
        f.manifest_rows(new, F.lit(0)).write.mode("append").parquet(manifest)
        new.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
