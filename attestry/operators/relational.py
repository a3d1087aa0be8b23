"""Generic relational operators: first rows, numbering, checks, ratios, ordered aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.session import shared_checkpoint, shuffle_width


class ExpectationFailed(ValueError):
    """Rows break a rule that must hold."""


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order (P8, P9, W1, W2, W4, W5). Null keys form a group.

    row_number with a filter on 1: Spark cuts each map task's groups to their first row before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def first_rows_of_few(df: DataFrame, keys: list[str], order: list[Column], most: int = 1_000_000) -> DataFrame:
    """``first_rows`` where few keys are repeated: only rows whose key's hash occurs twice are shuffled, and hashes of the others.

    ``df`` is read three times. Beyond ``most`` such hashes, which are broadcast, all rows are shuffled.
    """
    x = df.withColumn("_h", F.xxhash64(*keys))
    repeated = shared_checkpoint(x.groupBy("_h").agg(F.count("*").alias("n")).where("n > 1").select("_h"), "repeated")
    if repeated.count() > most:
        return first_rows(df, keys, order)
    few = F.broadcast(repeated)
    return x.join(few, "_h", "left_anti").drop("_h").unionByName(first_rows(x.join(few, "_h", "left_semi").drop("_h"), keys, order))


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Rows numbered without gaps in a global order (W6, W7), the column first.

    Range-partitioned and sorted in parallel; a row's number is its place in its partition plus the rows of the
    partitions before, of which there is one count each. Rows equal in all order columns are numbered in
    any order. An empty table gives no rows.
    """
    spark = df.sparkSession
    laid = df.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    laid = shared_checkpoint(laid.withColumn("_part", F.shiftright(place, 33)).withColumn("_place", place.bitwiseAND(F.lit(2**33 - 1))))
    sizes = sorted((r["_part"], r["n"]) for r in laid.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "_part long, _before long")
    # One row per partition of the layout, so it may be broadcast.
    out = laid.join(F.broadcast(offsets), "_part")
    return out.select((F.col("_before") + F.col("_place") + start).alias(name), *df.columns)


def violations(df: DataFrame, rule: Column) -> DataFrame:
    """Rows for which the rule is false or unknown (P10)."""
    return df.where(~F.coalesce(rule, F.lit(False)))


def expect(df: DataFrame, rule: Column, name: str) -> DataFrame:
    """``df`` itself, or ExpectationFailed if a row breaks the rule (P10)."""
    bad = violations(df, rule).limit(1).count()
    if bad:
        raise ExpectationFailed(name)
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with two rows or more: (keys, row_count) (A3)."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).where("row_count > 1")


def conflicting_keys(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with two different values or more: (keys, value_count); nulls are no value (A4)."""
    # Distinct first: one value of a hot key is one row after the map side.
    return df.select(*keys, value).where(F.col(value).isNotNull()).distinct().groupBy(*keys).agg(F.count("*").alias("value_count")).where("value_count > 1")


def ratio(numerator: Column, denominator: Column, empty: float | None = 0.0) -> Column:
    """Quotient, or ``empty`` where the denominator is 0."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(empty).cast("double"))


def ordered_list(value: str, order: str) -> Column:
    """List of values by order (A8), nulls kept."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"])


def ordered_text(value: str, order: str, separator: str = " ") -> Column:
    """Texts joined by order."""
    return F.array_join(ordered_list(value, order), separator)


def set_differences(df: DataFrame, value: str, expected: tuple[str, ...]) -> DataFrame:
    """(value, n) of values that are not expected, null among them, and of expected ones that are absent, with n 0."""
    found = df.groupBy(value).agg(F.count("*").alias("n"))
    wanted = df.sparkSession.createDataFrame([(x,) for x in expected], "_e string")
    both = found.join(wanted, F.col(value) == F.col("_e"), "full").where(F.col("_e").isNull() | F.col("n").isNull())
    return both.select(F.coalesce(value, "_e").alias(value), F.coalesce("n", F.lit(0)).alias("n"))


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys in order of their first place: (key, first_position)."""
    return df.groupBy(key).agg(F.min(position).alias("first_position"))


def of_first_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of the ``n`` smallest keys (J10, O2): keys by an ordered limit, rows by a semi join."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(n)
    return df.join(keys, key, "left_semi")


def not_matched(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Anti join on keys (J6, J8). Rows with a null key match nothing and stay."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")

