"""Best representative of each duplicate group, field by field."""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.text import composed, strip
from attestry.session import shared_checkpoint


@dataclass(frozen=True)
class Field:
    """How the surviving value of a field is chosen.

    ``votes``: the value with the greatest sum of votes wins (trust of the source times decay; nulls don't vote),
    then the latest, then the smallest row id. ``complete``: the longest value (white space at the ends not counted,
    null as 0), then the latest, then the smallest row id. ``latest``: the value of the row loaded last, null or not,
    then the smallest row id; fields that belong together, as the two ends of a row's validity, thus come from one row.
    """

    name: str
    by: str = "votes"


WIKI_FIELDS = (
    Field("text", "complete"),
    Field("raw_line", "complete"),
    Field("page_id"),
    Field("source_member"),
    Field("loaded_at", "latest"),
    Field("removed_at", "latest"),
)
FEW_SOURCES = 100_000  # sources whose trust may be broadcast: some 10 MB
UNKNOWN_TRUST = 0.5


def page_form(c: Column) -> Column:
    """One spelling of a page id: NFC, round brackets written out, runs of white space and underscores
    as one space, none at the ends. Case counts."""
    c = F.regexp_replace(F.regexp_replace(composed(c), r"(?i)-LRB-", "("), r"(?i)-RRB-", ")")
    return F.trim(F.regexp_replace(c, r"(?U)[\s_]+", " "))


def recency(at: Column, newest: Column, half_life_days: float) -> Column:
    """Decay of a vote by age; a row without time counts as one half-life old."""
    days = F.coalesce((F.unix_date(newest.cast("date")) - F.unix_date(at.cast("date"))).cast("double"), F.lit(half_life_days))
    return F.pow(F.lit(0.5), days / half_life_days)


def duplicate_groups(rows: DataFrame, row_id: str, key: list[Column]) -> DataFrame:
    """Rows of groups of two or more, with ``group_row_id``, the smallest row id of the group.

    Rows with a null key belong to no group.
    """
    names = [f"_key{i}" for i in range(len(key))]
    keyed = rows.select(*[k.alias(n) for n, k in zip(names, key)], *[F.col(c) for c in rows.columns])
    groups = (
        keyed.where(" and ".join(f"{n} is not null" for n in names))
        .groupBy(*names)
        .agg(F.min(row_id).alias("group_row_id"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    return keyed.join(groups, names).drop(*names)


def field_winners(
    grouped: DataFrame,
    row_id: str,
    at: str,
    fields: tuple[Field, ...],
    trust: Column | None = None,
    half_life_days: float = 90.0,
) -> DataFrame:
    """(``group_row_id``, and per field its value ``f`` and the row it comes from ``f_row_id``).

    Fields are unpivoted to long rows, votes summed per normalised value, the winner taken by
    max_by and the fields pivoted back. All steps are aggregates with a map-side part.
    """
    trust = F.lit(1.0) if trust is None else trust
    newest = grouped.groupBy("group_row_id").agg(F.max(at).alias("_newest"))
    voted = grouped.join(newest, "group_row_id").withColumn("_vote", trust * recency(F.col(at), F.col("_newest"), half_life_days))
    parts = []
    for f in fields:
        value = F.col(f.name).cast("string")
        parts.append(
            F.struct(
                F.lit(f.name).alias("field"),
                value.alias("value"),
                strip(value).alias("form"),
                (F.coalesce(F.char_length(strip(value)), F.lit(0)) if f.by == "complete" else F.lit(0)).alias("size"),
                (F.when(value.isNull() | F.lit(f.by != "votes"), 0.0).otherwise(F.col("_vote"))).alias("vote"),
            )
        )
    long = voted.select("group_row_id", F.col(row_id).alias("_row"), F.col(at).alias("_at"), F.explode(F.array(*parts)).alias("x"))
    order = F.struct(F.col("x.size").alias("size"), F.col("_at").alias("at"), (-F.col("_row")).alias("row"))
    values = long.groupBy("group_row_id", F.col("x.field").alias("field"), F.col("x.form").alias("form")).agg(
        F.sum("x.vote").alias("votes"), F.max(F.struct(order.alias("o"), F.col("x.value").alias("value"))).alias("best")
    )
    # Sums of doubles depend on their order; rounding keeps equal votes equal.
    rank = F.struct(F.col("best.o.size"), F.round("votes", 9), F.col("best.o.at"), F.col("best.o.row"))
    winners = values.groupBy("group_row_id", "field").agg(F.max_by("best", rank).alias("best"))
    picks = []
    for f in fields:
        mine = F.max(F.when(F.col("field") == f.name, F.struct(F.col("best.value"), (-F.col("best.o.row")).alias("row"))))
        picks += [mine.alias(f"_{f.name}")]
    wide = winners.groupBy("group_row_id").agg(*picks)
    kinds = dict(grouped.dtypes)
    out = [F.col("group_row_id")]
    for f in fields:
        out += [F.col(f"_{f.name}.value").cast(kinds[f.name]).alias(f.name), F.col(f"_{f.name}.row").alias(f"{f.name}_row_id")]
    return wide.select(*out)


def wiki_groups(sentences: DataFrame) -> DataFrame:
    return duplicate_groups(sentences, "row_id", [page_form(F.col("page_id")), F.col("sentence_id")])


def source_trust(rows: DataFrame, source: str, good: Column) -> DataFrame:
    """(``source``, ``trust``): the share of a source's rows that are good, over the whole table; null is no source."""
    return rows.where(F.col(source).isNotNull()).groupBy(source).agg(F.avg(F.coalesce(good, F.lit(False)).cast("double")).alias("trust"))


def with_trust(rows: DataFrame, trust: DataFrame, source: str) -> DataFrame:
    """Column ``_trust``; UNKNOWN_TRUST for sources the table ``trust`` lacks. Its size decides how it is joined."""
    trust = shared_checkpoint(trust.select(source, F.col("trust").alias("_trust")), "trust")
    small = trust.count() <= FEW_SOURCES
    return rows.join(F.broadcast(trust) if small else trust, source, "left").withColumn("_trust", F.coalesce("_trust", F.lit(UNKNOWN_TRUST)))


def wiki_survivors(sentences: DataFrame, fields: tuple[Field, ...] = WIKI_FIELDS, trust: DataFrame | None = None) -> DataFrame:
    """Surviving values of each group of two or more rows of one sentence of one page.

    ``trust`` holds (source_member, trust); unless given it is the share of a source's rows that hold a text. Removed
    rows take part; what survives is withdrawn if the row loaded last is.
    """
    if trust is None:
        trust = source_trust(sentences, "source_member", F.col("text").rlike(r"(?U)\S"))
    return field_winners(with_trust(wiki_groups(sentences), trust, "source_member"), "row_id", "loaded_at", fields, F.col("_trust"))
