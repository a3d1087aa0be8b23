"""Streaming twins of usage statistics, quotas and the outbox."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_usage_stream(events: DataFrame, user: str, at: str, status: str, latency: str, late: str = "1 day") -> DataFrame:
    """Per user and day as ``operators.usage.daily_usage``, for append output once a day is past the watermark.

    Watermarks need an instant: zone-less times are read in the session's zone.
    """
    code = F.col(status)
    return (
        events.withColumn(at, F.col(at).cast("timestamp"))
        .withWatermark(at, late)
        .groupBy(user, F.window(at, "1 day").alias("w"))
        .agg(
            F.count("*").alias("requests"),
            F.count(F.when(code.between(200, 299), 1)).alias("successful"),
            F.count(F.when((code >= 400) & (code != 429), 1)).alias("failed"),
            F.count(F.when(code == 429, 1)).alias("limited"),
            F.sum(latency).alias("latency_sum"),
        )
        .select(user, F.to_date("w.start").alias("day"), "requests", "successful", "failed", "limited", "latency_sum")
    )


def quota_stream(events: DataFrame, key: str, at: str, order: str, limit: int, window_seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """(order, hit, allowed) with windows that start at a key's first event (X2). The state of a key is its window's start and count.

    Events of a batch are taken in time order; an event older than the open window counts in it. A key's state goes once the
    watermark, ``late`` behind the newest event, has passed its window; a key's events of one batch are held in memory.
    """
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    cols = timed.select(F.col(key).cast("string").alias("k"), F.col(order).cast("long").alias("o"), F.unix_micros(at).alias("t"), F.col(at).alias("at"))

    def walk(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["t", "o"])
        hits = []
        for t in rows["t"]:
            if start is None or t >= start + window_seconds * 1_000_000:
                start, n = int(t), 0
            n += 1
            hits.append(n)
        state.update((start, n))
        state.setTimeoutTimestamp(max(start // 1000 + window_seconds * 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"k": rows["k"], "o": rows["o"], "hit": hits, "allowed": [h <= limit for h in hits]})

    return cols.groupBy("k").applyInPandasWithState(
        walk, "k string, o long, hit int, allowed boolean", "start long, n int", "append", GroupStateTimeout.EventTimeTimeout
    )


def pending_outbox(versions: DataFrame, index_name: str) -> DataFrame:
    """A stream of content versions as entries to be indexed, one per version and index (X4). Needs a watermark on the stream to bound the state."""
    return versions.withColumn("index_name", F.lit(index_name)).dropDuplicates(["version_id", "index_name"])
