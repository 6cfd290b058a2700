"""Keyed state as windows and ordered folds: transitions, sessions with a time to live, rate limits, running profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def transitions(actions: DataFrame, session: str, order: list[str], action: str) -> DataFrame:
    """How often each action follows each other within a session."""
    before = F.lag(action).over(W.partitionBy(session).orderBy(*order))
    return actions.select(before.alias("previous"), F.col(action).alias("next")).where("previous is not null").groupBy("previous", "next").agg(F.count("*").alias("n"))


def likely_next(counted: DataFrame, top: int = 3, least: float = 0.4) -> DataFrame:
    """Of each action's `top` followers the first, if it has at least that share of them."""
    rank = F.row_number().over(W.partitionBy("previous").orderBy(F.desc("n"), "next"))
    best = counted.withColumn("rank", rank).where(F.col("rank") <= top)
    share = F.col("n") / F.sum("n").over(W.partitionBy("previous"))
    return best.withColumn("share", F.round(share, 6)).where(F.col("rank") == 1).where(F.col("share") >= least).select("previous", "next", "n", "share")


def sessions(events: DataFrame, key: str, time: Column, seconds: int, order: str) -> DataFrame:
    """Number of the session that each event falls in: a new one starts when the key was idle for more than `seconds`."""
    by = W.partitionBy(key).orderBy("at", order)
    rows = events.withColumn("at", time.cast("timestamp").cast("double"))
    idle = F.col("at") - F.lag("at").over(by)
    rows = rows.withColumn("_new", F.when(idle.isNull() | (idle > seconds), 1).otherwise(0))
    return rows.withColumn("session_no", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def rate_limited(events: DataFrame, key: str, time: Column, order: str, limit: int, seconds: int) -> DataFrame:
    """Whether each event is allowed under a limit for each window, which starts at the first event after the last one's end.

    Keys are cut at idle times longer than a window, where state starts anew anyway; Spark sorts each stretch by time, and
    one pass carries (stretch, start, count) from row to row, so that no task holds a key's events.
    """
    rows = sessions(events.select(key, order, time.alias("_time")), key, F.col("_time"), seconds, order)
    rows = rows.select(key, order, "session_no", "at").repartition(key, "session_no").sortWithinPartitions(key, "session_no", "at", order)
    schema = f"`{key}` {events.schema[key].dataType.simpleString()}, `{order}` {events.schema[order].dataType.simpleString()}, count int, allowed boolean"

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, n = None, 0.0, 0
        for f in frames:
            counts = []
            for k, no, at in zip(f[key], f["session_no"], f["at"]):
                fresh = now != (k, no) or at - start >= seconds
                now, start, n = (k, no), at if fresh else start, 1 if fresh else n + 1
                counts.append(n)
            out = f[[key, order]].copy()
            out["count"] = counts
            out["allowed"] = out["count"] <= limit
            yield out

    return rows.mapInPandas(each, schema)


def running(rows: DataFrame, session: str, order: str, sums: list[str]) -> DataFrame:
    """The columns with their running sums within a session."""
    by = W.partitionBy(session).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.select("*", *(F.sum(c).over(by).alias(f"{c}_so_far") for c in sums))


def clamped_sum(steps: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """Sum of an ordered array of numbers, held between bounds after each step."""
    return F.aggregate(steps, F.lit(0.0), lambda s, x: F.greatest(F.lit(low), F.least(F.lit(high), s + x)))


def blended(old: Column, new: Column, weight: float = 0.3) -> Column:
    """A profile's number after a session: old and new parts; the new alone where there was none."""
    return F.when(old.isNull(), new).otherwise(weight * new + (1 - weight) * old)
