"""References to records that do not exist, by as-of matching to runs of live parents.

A parent row is an integer interval [start, end) of its composite key (``end`` null: open).
Parents and references are laid out together in one range order of (key, position). One pass over
each partition compresses the sorted intervals into contiguous runs, matches each reference to the run
start before it, and keeps the references whose position lies beyond the end of that run. Range
order splits a hot key over many tasks, so no key is gathered in one of them; what crosses a
task border is one run per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from attestry.session import shared_checkpoint, shuffle_width

OPEN_END = 2**63 - 1
RUN, REFERENCE = 0, 1


def micros(c: Column) -> Column:
    """Integer microseconds of a zone-less timestamp since 1970, whatever the session's zone; null stays null."""
    seconds = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def compress(names: list[str]):
    """A pass over rows (names, at, kind, until, ref) in order: runs of touching parent intervals, and references no run covers.

    Of a run ``at`` and ``until`` are its start and end; of a reference ``until`` is the end of the run that starts
    before it within the partition, or null. Only the last run is held between batches.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if last is not None:
                t = pa.concat_tables([last, t])
            t = t.combine_chunks()
            n = len(t)
            if not n:
                continue
            at, kind = t["at"].to_numpy(), t["kind"].to_numpy()
            changes = np.zeros(n, bool)
            for c in names:
                x = t[c].combine_chunks()
                changes[1:] |= pc.not_equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            key = np.cumsum(changes)
            none = np.iinfo("int64").min
            until = np.where(kind == RUN, pc.fill_null(t["until"], none).to_numpy(), none)
            end = pd.Series(until).groupby(key).cummax().to_numpy()
            before = np.concatenate([[none], np.where(changes[1:], none, end[:-1])])
            starts = np.flatnonzero((kind == RUN) & ((at > before) | (before == none)))
            if len(starts):
                ends = np.maximum.reduceat(until, starts)
                runs = t.take(pa.array(starts)).set_column(t.schema.get_field_index("until"), "until", pa.array(ends))
                last = runs.slice(len(starts) - 1)
                yield from _tagged(runs.slice(0, len(starts) - 1), part)
            lost = np.flatnonzero((kind == REFERENCE) & (end <= at))
            found = t.take(pa.array(lost)).set_column(t.schema.get_field_index("until"), "until", pa.array(end[lost], mask=end[lost] == none))
            yield from _tagged(found, part)
        if last is not None:
            yield from _tagged(last, part)

    return rows


def _tagged(t: pa.Table, part: int) -> list[pa.RecordBatch]:
    return t.append_column("part", pa.array(np.full(len(t), part, "int32"))).combine_chunks().to_batches() if len(t) else []


def laid_runs(rows: DataFrame, names: list[str], partitions: int | None = None) -> DataFrame:
    """``compress`` over one range order of rows (names, at, kind, until, ref); written once, with the partition's number.

    Equal rows are told apart by the place they were read from, so that a repeated one is spread like any other.
    """
    order = [*names, "at", "kind", "tie"]
    laid = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions or shuffle_width(rows.sparkSession), *order)
    laid = laid.sortWithinPartitions(*order).drop("tie")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema.fields)
    return shared_checkpoint(laid.mapInArrow(compress(names), f"{schema}, part int"), "runs")


def carried_runs(laid: DataFrame, names: list[str]) -> DataFrame:
    """(part, c_<name>, c_start, c_end): the run that stands open before each partition, put together over the borders.

    One row per task of the layout comes to the driver.
    """
    spark, kinds = laid.sparkSession, dict(laid.dtypes)
    run, place = F.struct(*names, "at", "until"), F.struct(*names, "at")
    edges = laid.groupBy("part").agg(F.max_by(F.when(F.col("kind") == RUN, run), F.when(F.col("kind") == RUN, place)).alias("last")).collect()
    by_part = {r["part"]: tuple(r["last"]) for r in edges if r["last"] is not None}
    out, current = [], None
    for part in range(max([-1, *(r["part"] for r in edges)]) + 1):
        if current is not None:
            out.append((part, *current))
        if part in by_part:
            last = by_part[part]
            if current is not None and last[:-2] == current[:-2] and last[-2] <= current[-1]:
                current = (*current[:-1], max(current[-1], last[-1]))
            else:
                current = last
    schema = ", ".join(["part int", *(f"c_{n} {kinds[n]}" for n in names), "c_start long", "c_end long"])
    return spark.createDataFrame(out, schema)


def with_carried(rows: DataFrame, laid: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the start and end of the run carried into their partition, null where it is of another key."""
    x = rows.join(F.broadcast(carried_runs(laid, names)), "part", "left")  # one row per task
    same = F.lit(True)
    for n in names:
        same = same & F.coalesce(F.col(n) == F.col(f"c_{n}"), F.lit(False))
    return x.withColumn("carried_start", F.when(same, F.col("c_start"))).withColumn("carried_end", F.when(same, F.col("c_end")))


def _intervals(df: DataFrame, columns: list[str], names: list[str], at: Column, kind: int, until: Column, ref: Column, ref_type: str) -> DataFrame:
    x = df.select(
        *[F.col(c).alias(n) for n, c in zip(names, columns)], at.cast("long").alias("at"), F.lit(kind).alias("kind"),
        until.cast("long").alias("until"), ref.cast(ref_type).alias("ref"),
    )
    return x.where(" and ".join(f"{c} is not null" for c in [*names, "at"]))


def orphan_references(
    references: DataFrame,
    parents: DataFrame,
    keys: dict[str, str],
    ref_id: str,
    position: Column,
    start: Column,
    end: Column,
    partitions: int | None = None,
) -> DataFrame:
    """References that no live parent covers: (``ref_id``, ``position``, ``reason``, and the keys).

    ``keys`` maps reference columns to parent columns, compared exactly and as written. References
    with a null key or null position are left out, as are parents with a null key or start and
    those whose interval is empty. Repeated parents and references, ties (a parent that starts at
    the reference's position covers it, one that ends there does not) and empty tables are allowed;
    extra columns are dropped before the union, so clashing names do no harm.
    reason: ``not_loaded`` (a parent of this key starts only later), ``withdrawn`` (every
    parent run before has ended), ``missing`` (no parent of this key at all).
    """
    names = [f"k{i}" for i in range(len(keys))]
    ref_type = dict(references.dtypes)[ref_id]
    none = F.lit(None)
    refs = _intervals(references, list(keys), names, position, REFERENCE, none, F.col(ref_id), ref_type)
    live = _intervals(parents, list(keys.values()), names, start, RUN, F.coalesce(end.cast("long"), F.lit(OPEN_END)), none, ref_type)
    laid = laid_runs(refs.unionByName(live.where("until > at")), names, partitions)
    lost = with_carried(laid.where(f"kind = {REFERENCE}"), laid, names)
    # A run carried over the border is the one before the reference only where its own partition has none.
    orphans = lost.withColumn("run_end", F.greatest("until", "carried_end")).where("run_end is null or run_end <= at")
    known = laid.where(f"kind = {RUN}").select(*[F.col(n).alias(f"p{n}") for n in names]).distinct().withColumn("known", F.lit(True))
    on = [F.col(n) == F.col(f"p{n}") for n in names]
    return orphans.join(known, on, "left").select(
        F.col("ref").alias(ref_id),
        *[F.col(n).alias(c) for n, c in zip(names, keys)],
        F.col("at").alias("position"),
        F.when(F.col("run_end").isNotNull(), "withdrawn").when(F.col("known"), "not_loaded").otherwise("missing").alias("reason"),
    )


def key_runs(parents: DataFrame, group: list[str], key: str, partitions: int | None = None) -> DataFrame:
    """Sorted integer keys compressed into contiguous runs: (group, run_start, run_end, n_keys).

    Null keys and groups are left out, repeated keys count once. A key is the interval [key, key + 1).
    """
    names = [f"k{i}" for i in range(len(group))]
    k = F.col(key).cast("long")
    laid = laid_runs(_intervals(parents, group, names, k, RUN, k + 1, F.lit(None), "long"), names, partitions)
    runs = with_carried(laid, laid, names)
    start = F.when(F.col("at") <= F.col("carried_end"), F.col("carried_start")).otherwise(F.col("at"))
    whole = runs.groupBy(*names, start.alias("run_start")).agg((F.max("until") - 1).alias("run_end"))
    return whole.select(*[F.col(n).alias(c) for n, c in zip(names, group)], "run_start", "run_end", (F.col("run_end") - F.col("run_start") + 1).alias("n_keys"))


def wiki_orphans(evidence: DataFrame, sentences: DataFrame, partitions: int | None = None) -> DataFrame:
    """Evidence rows whose page and sentence are not live at ``recorded_at``."""
    return orphan_references(
        evidence,
        sentences,
        {"wiki_page": "page_id", "sentence_id": "sentence_id"},
        "evidence_row_id",
        micros(F.col("recorded_at")),
        micros(F.col("loaded_at")),
        micros(F.col("removed_at")),
        partitions,
    )


def orphan_report(orphans: DataFrame, table_name: str) -> DataFrame:
    """Orphans per table, month of the reference and reason. No orphans: no rows."""
    day = F.date_from_unix_date(F.floor(F.col("position") / 86_400_000_000).cast("int"))
    month = F.date_format(day, "yyyy-MM")
    return (
        orphans.groupBy(F.lit(table_name).alias("table_name"), month.alias("month"), "reason")
        .agg(F.count("*").alias("orphans"))
    )
