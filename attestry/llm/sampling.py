"""Samples whose category shares match targets, with a minimum per category, by swap repair on counts.

Records are grouped by category signature. Counts per signature are all the repair needs: from a random
sample that meets the floors, counts are exchanged between signatures while that lowers the deviation
from the targets. Rows are then drawn at random, as many of each signature as its count.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


@dataclass(frozen=True)
class Target:
    target_set: str
    category: str
    wanted: int
    floor: int


def wanted_rows(n: int, sample_pct: int, target_pct: int) -> int:
    return n * sample_pct * target_pct // 10_000


def swap_repair(available: dict[str, int], targets: list[Target], seed: int = 0) -> dict[str, int]:
    """Rows to take per category.

    The start is random: each category its floor as far as it has rows, the remaining rows dealt at random in
    proportion to what is left. Then counts move from the category furthest above its target to the one furthest
    below that still has rows, as many at once as lower the sum of squared deviations, until no exchange does.
    The size of the sample is the sum of wanted rows, or all rows of the target's categories if there are fewer. What a
    category lacks is thus dealt to those that have rows, which come out above their own targets.
    """
    want = {t.category: max(t.floor, t.wanted) for t in targets}
    have = {c: available.get(c, 0) for c in want}
    size = min(sum(want.values()), sum(have.values()))
    take = {t.category: min(t.floor, have[t.category]) for t in targets}
    rng = random.Random(seed)
    cats = sorted(want)
    while (missing := size - sum(take.values())) > 0:
        room = {c: have[c] - take[c] for c in cats if have[c] > take[c]}
        whole = sum(room.values())
        dealt = {c: min(room[c], int(missing * r / whole * rng.uniform(0.5, 1.5))) for c, r in room.items()}
        if not sum(dealt.values()):
            dealt = {rng.choice(sorted(room)): 1}
        for c, k in dealt.items():
            take[c] += min(k, size - sum(take.values()))
    while True:
        over = max(cats, key=lambda c: (take[c] - want[c], c))
        open_ = [c for c in cats if take[c] < have[c] and c != over]
        if not open_:
            return take
        under = min(open_, key=lambda c: (take[c] - want[c], c))
        gap = (take[over] - want[over]) - (take[under] - want[under])
        step = min(gap // 2, have[under] - take[under], take[over] - min(take[over], next(t.floor for t in targets if t.category == over)))
        if step <= 0:
            return take
        take[over] -= step
        take[under] += step


def category_counts(rows: DataFrame, category: str, split: str | None = "split") -> DataFrame:
    """(split, category, n) as written, nulls included."""
    return rows.groupBy(F.col(split).alias("split"), F.col(category).alias("category")).agg(F.count("*").alias("n"))


def sampling_plan(counts: dict[str, list], targets: list, seed: int = 0) -> list[dict]:
    """One row per target: available, wanted, taken, and whether the category has too few rows.

    ``counts``: per table the rows (split, category, n), one per signature; targets as in sample_targets.
    A category without rows has 0 available. Null splits and categories count towards the rows of 'all'.
    """
    by_set: dict[str, list] = {}
    for t in targets:
        by_set.setdefault(t["target_set"], []).append(t)
    out = []
    for name, group in sorted(by_set.items()):
        table, split = group[0]["table_name"], group[0]["split"]
        rows = [r for r in counts.get(table, []) if split == "all" or r["split"] == split]
        n = sum(r["n"] for r in rows)
        available: dict[str, int] = {}
        for r in rows:
            available[r["category"]] = available.get(r["category"], 0) + r["n"]
        goals = [Target(name, t["category"], wanted_rows(n, t["sample_pct"], t["target_pct"]), t["min_rows"]) for t in group]
        take = swap_repair(available, goals, seed)
        for g in goals:
            need, has = max(g.floor, g.wanted), available.get(g.category, 0)
            out.append(
                {"target_set": name, "table_name": table, "split": split, "category": g.category, "available": has, "wanted": need,
                 "min_rows": g.floor, "taken": take[g.category], "unmet": has < need}
            )
    return out


PLAN_SCHEMA = "target_set string, table_name string, split string, category string, available long, wanted long, min_rows long, taken long, unmet boolean"


def plan_table(tables: dict[str, tuple[DataFrame, str]], targets: DataFrame, seed: int = 0) -> DataFrame:
    """The plan as a table. ``tables``: name to (rows, category column). What reaches the driver is one
    row per signature and per target, however many rows the tables have."""
    spark = targets.sparkSession
    wanted = [r.asDict() for r in targets.collect()]
    used = {t["table_name"] for t in wanted}
    counts = {name: category_counts(df, column).collect() for name, (df, column) in tables.items() if name in used}
    return spark.createDataFrame([tuple(r.values()) for r in sampling_plan(counts, wanted, seed)], PLAN_SCHEMA)


def draw(rows: DataFrame, row_id: str, category: str, plan: DataFrame, seed: int = 0) -> DataFrame:
    """(target_set, ``row_id``, category): exactly ``taken`` random rows of each category of each target set.

    Rows are ordered by a hash of id and seed (and the id in ties). A histogram of hash buckets finds the
    bucket in which the count is reached; only the rows of that bucket are ranked, so no category is sorted in
    one task. Ids must be unique. ``plan`` is a small table with one row per target.
    """
    small = plan.select("target_set", F.col("split").alias("_split"), F.col("category").alias("_category"), "taken")
    h = F.xxhash64(F.lit(seed), F.col(row_id))
    keyed = rows.select(row_id, "split", F.col(category).alias("category"), h.alias("_h"), F.pmod(F.shiftright(h, 20), F.lit(BUCKETS)).alias("_b"))
    same = (F.col("category") == F.col("_category")) & ((F.col("_split") == "all") | (F.col("split") == F.col("_split")))
    # The plan has as many rows as the targets: a bound that does not grow with the data.
    matched = keyed.join(F.broadcast(small), same)
    histogram = matched.groupBy("target_set", "category", "_b").agg(F.count("*").alias("_n"), F.max("taken").alias("taken"))
    before = Window.partitionBy("target_set", "category").orderBy("_b")
    cut = histogram.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).where(F.col("_before") < F.col("taken"))
    cut = cut.select("target_set", "category", "_b", (F.col("taken") - F.col("_before")).alias("_left"), "_n")
    inside = matched.drop("taken").join(cut, ["target_set", "category", "_b"])
    sure = inside.where("_left >= _n")
    rank = F.row_number().over(Window.partitionBy("target_set", "category", "_b").orderBy("_h", row_id))
    edge = inside.where("_left < _n").withColumn("_rank", rank).where("_rank <= _left").drop("_rank")
    return sure.unionByName(edge).select("target_set", row_id, "category")
