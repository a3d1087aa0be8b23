"""Duplicates hidden by formatting: dictionary-encoded records, grouped as integer tuples.

The dictionary, and the tuples where they are read twice, are written once. A value or tuple that many rows
share is a hot key of the joins below: those of a thousandth of all rows or more, of which there are at most a
thousand, are spread over salts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.text import bare, digest, is_blank
from attestry.session import shared_checkpoint, shuffle_width

HOT = 1000


def hot_keys(counted: DataFrame, key: str, total: int) -> list:
    """Keys whose count ``n`` is a thousandth of ``total`` or more: at most a thousand of them."""
    return [r[0] for r in counted.where(F.col("n") * HOT >= total).where(f"n > {HOT}").select(key).collect()]


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, hot: list) -> DataFrame:
    """Inner join on ``key``, which is unique in ``lookup``; rows of hot keys are spread evenly over salts."""
    if not hot:
        return rows.join(lookup, key)
    width = shuffle_width(rows.sparkSession)
    is_hot = F.col(key).isin(hot)
    salted = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(width))).otherwise(0))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(width - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(lookup.withColumn("_salt", F.explode(salts)), [key, "_salt"]).drop("_salt")


def value_dictionary(rows: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """(``value``, ``code``, ``n``): the digest of each distinct raw value, the integer code of its canonical form, its count.

    A value is canonicalised once however often it occurs. The code is the smallest
    ``row_id * fields + field`` at which the form occurs: unique to the form, and the same
    when a lost task is run again.
    """
    size = len(fields)
    cells = F.array(*[F.struct(F.col(f).alias("text"), (F.col(row_id) * size + i).alias("place")) for i, f in enumerate(fields)])
    raw = rows.select(F.inline(cells)).groupBy("text").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    raw = shared_checkpoint(raw.select(digest(F.col("text")).alias("value"), "place", "n", digest(bare(F.col("text"))).alias("form")), "values")
    forms = raw.groupBy("form").agg(F.min("place").alias("code"))
    return raw.join(forms, "form").select("value", "code", "n")


def encoded(rows: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """(``row_id``, ``codes``): the record as sorted tuple of value codes, joined by commas; order of fields doesn't count.

    Rows with a null or blank field take no part. Texts of punctuation only share the empty form.
    """
    whole = reduce(lambda a, b: a & b, [~is_blank(F.col(f)) for f in fields])
    rows = rows.select(row_id, *fields).where(whole)
    codes = shared_checkpoint(value_dictionary(rows, row_id, fields), "dictionary")
    hot = hot_keys(codes, "value", codes.agg(F.sum("n")).head()[0] or 0)
    out = rows.select(row_id, *[digest(F.col(f)).alias(f"value_{i}") for i, f in enumerate(fields)])
    for i in range(len(fields)):
        out = salted_join(out, codes.select(F.col("value").alias(f"value_{i}"), F.col("code").alias(f"code_{i}")), f"value_{i}", hot).drop(f"value_{i}")
    return out.select(row_id, F.concat_ws(",", F.transform(F.array_sort(F.array(*[f"code_{i}" for i in range(len(fields))])), lambda c: c.cast("string"))).alias("codes"))


def record_copies(rows: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """One row per distinct record: (``row_id`` of the first, ``copies``). Empty tables give none."""
    return (
        encoded(rows, row_id, fields)
        .groupBy("codes")
        .agg(F.min(row_id).alias(row_id), F.count("*").alias("copies"))
        .drop("codes")
    )


def copy_links(rows: DataFrame, row_id: str, fields: list[str], first: str, other: str) -> DataFrame:
    """(``first``, ``other``): the smallest id of each group of copies with every other one of it.

    The group is reduced to its smallest id by a partial aggregate; members are never gathered.
    """
    tuples = shared_checkpoint(encoded(rows, row_id, fields), "tuples")
    groups = tuples.groupBy("codes").agg(F.min(row_id).alias(first), F.count("*").alias("n"))
    firsts = shared_checkpoint(groups.where("n > 1"), "firsts")
    linked = salted_join(tuples, firsts.drop("n"), "codes", hot_keys(firsts, "codes", tuples.count()))
    return linked.where(F.col(row_id) != F.col(first)).select(first, F.col(row_id).alias(other))
