"""Order-dependent operators over range partitions, so that a hot key spreads over many tasks.

Rows are laid out in one range order and written once, with the number of their partition. What an operator
needs from the rows before a partition is one small value per partition: it is carried over on the driver and
sent back as a table with one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.session import shared_checkpoint, shuffle_width


def lay_out(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` in range partitions by ``order``, with the partition number ``_part``."""
    laid = df.repartitionByRange(partitions or shuffle_width(df.sparkSession), *order)
    return shared_checkpoint(laid.withColumn("_part", F.spark_partition_id()))


def per_part_table(laid: DataFrame, values: dict[int, tuple], schema: str) -> DataFrame:
    """One row (_part, values) per partition that has something carried into it."""
    return laid.sparkSession.createDataFrame([(p, *v) for p, v in sorted(values.items())], f"_part int, {schema}")


def last_before(laid: DataFrame, keys: list[str], order: list[str], value: str, where: str = "true") -> DataFrame:
    """(_part, c_<key>, _carried): key and value of the last row in the partitions before that meets ``where``."""
    wanted = F.expr(where)
    tail = F.max_by(F.when(wanted, F.struct(*keys, value)), F.when(wanted, F.struct(*keys, *order)))
    rows = laid.groupBy("_part").agg(tail.alias("t")).collect()
    tails = {r["_part"]: r["t"] for r in rows if r["t"] is not None}
    seen: dict[int, tuple] = {}
    current = None
    for part in range(max([-1, *(r["_part"] for r in rows)]) + 1):
        if current is not None:
            seen[part] = tuple(current)
        current = tails.get(part, current)
    fields = laid.schema
    schema = ", ".join([*(f"c_{k} {fields[k].dataType.simpleString()}" for k in keys), f"_carried {fields[value].dataType.simpleString()}"])
    return per_part_table(laid, seen, schema)


def same_key(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(k) == F.col(f"c_{k}"))
    return F.coalesce(out, F.lit(False))


def latest_as_of(facts: DataFrame, observations: DataFrame, keys: list[str], at: str, observed: str, tie: str, partitions: int | None = None) -> DataFrame:
    """Facts with the newest observation not after them, as struct ``observation`` or null.

    Of observations at one time the one with the greatest ``tie`` counts. Facts with a null key or time have none, observations
    with a null key or time are left out. All columns of the facts are kept; those of observations come in the struct.
    """
    inner = [c for c in observations.columns if c not in keys]
    usable = " and ".join(f"`{k}` is not null" for k in keys)
    obs = observations.where(f"{usable} and `{observed}` is not null").select(
        *keys, F.col(observed).alias("_t"), F.lit(0).alias("_kind"), F.col(tie).alias("_tie"), F.struct(*inner).alias("_obs"), F.lit(None).cast(facts.schema).alias("_fact")
    )
    mine = facts.where(f"{usable} and `{at}` is not null").select(
        *keys, F.col(at).cast(observations.schema[observed].dataType).alias("_t"), F.lit(1).alias("_kind"),
        F.lit(None).cast(observations.schema[tie].dataType).alias("_tie"), F.lit(None).cast(obs.schema["_obs"].dataType).alias("_obs"), F.struct(*facts.columns).alias("_fact"),
    )
    order = ["_t", "_kind", "_tie"]
    laid = lay_out(obs.unionByName(mine), [*keys, *order], partitions)
    carry = last_before(laid, keys, order, "_obs", "_kind = 0")
    w = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    matched = laid.withColumn("_own", F.last("_obs", ignorenulls=True).over(w)).where("_kind = 1")
    # One row per partition of the layout.
    matched = matched.join(F.broadcast(carry), "_part", "left")
    found = F.coalesce("_own", F.when(same_key(keys), F.col("_carried")))
    out = matched.select("_fact.*", found.alias("observation"))
    rest = facts.where(f"not ({usable} and `{at}` is not null)").withColumn("observation", F.lit(None).cast(obs.schema["_obs"].dataType))
    return out.unionByName(rest)


def content_versions(captures: DataFrame, key: str, content: str, arrival: list[str], partitions: int | None = None) -> DataFrame:
    """Captures that differ from the one before them in arrival order, numbered from 1 per key.

    A return to an older content is a new version. Null content equals null content. Rows with a null key are
    left out. The arrival columns together must be unique within a key.
    """
    x = captures.where(F.col(key).isNotNull()).withColumn("_value", F.struct(F.col(content).alias("v")))
    laid = lay_out(x, [key, *arrival], partitions)
    carry = last_before(laid, [key], arrival, "_value")
    w = Window.partitionBy("_part", key).orderBy(*arrival)
    y = laid.withColumn("_before", F.lag("_value").over(w)).join(F.broadcast(carry), "_part", "left")
    before = F.coalesce("_before", F.when(same_key([key]), F.col("_carried")))
    y = y.withColumn("_new", F.when(before.isNull(), True).otherwise(~F.col("_value").eqNullSafe(before)))
    counted = y.where("_new").withColumn("_n", F.row_number().over(w)).drop("_before", "_carried", f"c_{key}", "_new")

    # Versions of a partition's last key count for the partitions after it.
    last = laid.groupBy("_part").agg(F.max(key).alias("_last"))
    sums = counted.groupBy("_part", key).agg(F.max("_n").alias("_n")).join(F.broadcast(last), "_part").where(F.col(key) == F.col("_last"))
    n_by_part = {r["_part"]: r["_n"] for r in sums.select("_part", "_n").collect()}
    last_by_part = {r["_part"]: r["_last"] for r in last.collect()}
    seen: dict[int, tuple] = {}
    current, total = None, 0
    for part in range(max([-1, *last_by_part]) + 2):
        if current is not None:
            seen[part] = (current, total)
        if part in last_by_part:
            k, n = last_by_part[part], n_by_part.get(part, 0)
            current, total = k, (total if k == current else 0) + n
    more = per_part_table(laid, seen, f"c_{key} {laid.schema[key].dataType.simpleString()}, _carried long")
    out = counted.join(F.broadcast(more), "_part", "left")
    number = F.col("_n") + F.coalesce(F.when(same_key([key]), F.col("_carried")), F.lit(0))
    return out.select(*captures.columns, number.cast("long").alias("version_number"))
