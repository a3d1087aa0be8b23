"""Usage statistics over time, quotas, percentiles and log counters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.layout import last_before, lay_out, same_key
from attestry.session import shared_checkpoint, shuffle_width


def daily_usage(events: DataFrame, user: str, at: str, status: str, latency: str) -> DataFrame:
    """Per user and day: requests, successful (2xx), limited (429), failed (4xx and 5xx but 429), latency sum."""
    code = F.col(status)
    return events.groupBy(user, F.to_date(at).alias("day")).agg(
        F.count("*").alias("requests"),
        F.count_if(code.between(200, 299)).alias("successful"),
        F.count_if((code >= 400) & (code != 429)).alias("failed"),
        F.count_if(code == 429).alias("limited"),
        F.sum(latency).alias("latency_sum"),
    )


def filled_days(daily: DataFrame, user: str, last_day: Column, days: int) -> DataFrame:
    """The last ``days`` days of every user, absent ones with zeros."""
    users = daily.select(user).distinct()
    grid = users.select(user, F.explode(F.sequence(F.date_sub(last_day, days - 1), last_day)).alias("day"))
    return grid.join(daily, [user, "day"], "left").fillna(0)


def usage_summary(filled: DataFrame, user: str, digits: int = 6) -> DataFrame:
    """Totals and mean latency over the window: sum of latency by requests, null without requests."""
    n = F.sum("requests")
    return filled.groupBy(user).agg(
        n.alias("requests"), F.sum("successful").alias("successful"), F.sum("failed").alias("failed"), F.sum("limited").alias("limited"),
        F.round(F.when(n > 0, F.sum("latency_sum") / n), digits).alias("mean_latency"),
    )


def nearest_rank(df: DataFrame, value: str, shares: tuple[float, ...] = (0.5, 0.9, 0.95), keys: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles with count, least, greatest and mean (A16). Nulls are left out."""
    parts = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(p * 100)}") for p in shares]
    return df.where(F.col(value).isNotNull()).groupBy(*(keys or [])).agg(
        F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.round(F.avg(value), 6).alias("mean"), *parts
    )


def medians(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, n, median): the middle value, or the mean of the two in the middle (A18). Nulls are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.median(value).alias("median"))


def pattern_counts(lines: DataFrame, text: str, pattern: str) -> DataFrame:
    """(found, n): lines by what the first group of a pattern finds; lines without it are left out."""
    return lines.where(F.col(text).rlike(pattern)).groupBy(F.regexp_extract(text, pattern, 1).alias("found")).agg(F.count("*").alias("n"))


def quota_decisions(events: DataFrame, key: str, at: str, order: str, limit: int, window_seconds: int = 60, partitions: int | None = None) -> DataFrame:
    """(key, at, order, hit, allowed): the event's place in its window, which starts at a key's first event after the one before ended.

    An event that comes a window or more after the one before it starts a window whatever went before, so events are cut
    into sessions there, over a range order that spreads a hot key; only a session is gone through in order, as a stream
    that holds one start and one count. A key that never pauses for a window is one session. Repeated rows are events of
    their own. Events without key or time have hit and allowed null.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp")) if dict(events.dtypes)[at] == "timestamp" else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(at))
    x = events.select(key, at, order, micros.alias("_t"), F.monotonically_increasing_id().alias("_tie"))
    usable = F.col(key).isNotNull() & F.col("_t").isNotNull()
    line = [key, "_t", order, "_tie"]
    laid = lay_out(x.where(usable), line, partitions)
    before = F.coalesce(F.lag("_t").over(Window.partitionBy("_part", key).orderBy(*line[1:])), F.when(same_key([key]), F.col("_carried")))
    opens = laid.join(F.broadcast(last_before(laid, [key], line[1:], "_t")), "_part", "left").withColumn("_opens", before.isNull() | (F.col("_t") - before >= window_seconds * 1_000_000))
    # Sessions are numbered by the part they open in and their place there; what opened before the part has its own number.
    opened = F.sum(F.col("_opens").cast("int")).over(Window.partitionBy("_part", key).orderBy(*line[1:]).rowsBetween(Window.unboundedPreceding, 0))
    cut = shared_checkpoint(opens.withColumn("_n", opened).select(key, at, order, "_t", "_tie", "_part", F.when(F.col("_n") > 0, F.struct("_part", "_n")).alias("_own")), "sessions")
    last = last_before(cut, [key], line[1:], "_own", "_own is not null")
    whole = cut.join(F.broadcast(last.withColumnRenamed("_carried", "_open")), "_part", "left").withColumn("_session", F.coalesce("_own", F.col("_open")))
    streams = whole.select(key, at, order, "_t", "_tie", "_session").repartition(partitions or shuffle_width(events.sparkSession), key, "_session").sortWithinPartitions(key, "_session", *line[1:])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, n = None, 0, 0
        for batch in batches:
            hits = []
            for k, part, session, t in zip(batch[key].to_pylist(), batch["_p"].to_pylist(), batch["_s"].to_pylist(), batch["_t"].to_pylist()):
                if (k, part, session) != now or t >= start + window_seconds * 1_000_000:
                    now, start, n = (k, part, session), t, 0
                n += 1
                hits.append(n)
            yield pa.record_batch([batch[key], batch[at], batch[order], pa.array(hits, pa.int32())], names=[key, at, order, "hit"])

    kinds = dict(events.dtypes)
    spec = f"`{key}` {kinds[key]}, `{at}` {kinds[at]}, `{order}` {kinds[order]}, hit int"
    done = streams.select(key, at, order, "_t", F.col("_session._part").alias("_p"), F.col("_session._n").alias("_s")).mapInArrow(walk, spec)
    rest = x.where(~usable).select(key, at, order, F.lit(None).cast("int").alias("hit"))
    return done.unionByName(rest).withColumn("allowed", F.col("hit") <= limit)
