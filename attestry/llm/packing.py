"""Filling containers of fixed capacity with items by a grouping genetic algorithm on islands.

Items are dealt by hash into blocks of bounded size. Each block is worked on by several islands: small
populations of packings, bred by injecting whole well-filled containers of one parent into another,
dropping the containers that hold an injected item twice, and placing the displaced items: a displaced item
first takes the place of a smaller one that leaves its container fuller, which then is displaced in its stead,
and what can take no place so goes by best fit. Between epochs each island's elite moves on to the next island.
What the best packing of a block leaves in poorly filled containers is pooled with that of other blocks and
packed once more in the same way. A block ends as soon as it meets the bound no packing can beat.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.session import shared_checkpoint


@dataclass(frozen=True)
class PackingPlan:
    """block_items: items of a block on average. islands and epochs of each block, population and
    children of an island per epoch. pool_blocks: blocks whose leftovers are pooled. well_filled: share
    of the capacity from which a container is kept as it is. blur: spread of sizes in the orders of the first packings."""

    block_items: int = 2000
    islands: int = 3
    epochs: int = 3
    population: int = 8
    children: int = 40
    pool_blocks: int = 32
    well_filled: float = 0.98
    blur: float = 0.2


PLAN = PackingPlan()
UNPLACED = -1
HUGE = 1 << 60


def best_fit(order: Iterable[int], sizes: list[int], capacity: int, bins: np.ndarray, free: list[int]) -> np.ndarray:
    """Places items in the given order, each into the fullest container that still holds it. ``bins`` gives the container of each item."""
    rooms = sorted((r, k) for k, r in enumerate(free))
    opened = len(free)
    for i in order:
        z = sizes[i]
        at = bisect_left(rooms, (z, -1))
        if at == len(rooms):
            room, k, opened = capacity, opened, opened + 1
        else:
            room, k = rooms.pop(at)
        bins[i] = k
        if room > z:
            insort(rooms, (room - z, k))
    return bins


def falling_order(sizes: np.ndarray) -> list[int]:
    return np.argsort(-sizes, kind="stable").tolist()


def best_fit_falling(sizes: np.ndarray, capacity: int) -> np.ndarray:
    return best_fit(falling_order(sizes), sizes.tolist(), capacity, np.zeros(len(sizes), "int64"), [])


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer containers: by volume, and for each least size k by the items that leave no room for k, the
    other ones above half the capacity, and the volume from k up that does not go beside these."""
    z = np.sort(np.asarray(sizes, "int64"))
    volume = np.concatenate([[0], np.cumsum(z)])
    n, best = len(z), -(-int(volume[-1]) // capacity)
    half = int(np.searchsorted(z, capacity // 2, "right"))
    k = np.unique(np.concatenate([[0], z[:half]]))
    alone, low = np.searchsorted(z, capacity - k, "right"), np.searchsorted(z, k)
    beside = (alone - half) * capacity - (volume[alone] - volume[half])
    more = -((beside - (volume[half] - volume[low])) // capacity)
    return max(best, n - half + int(np.maximum(more, 0).max()))


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer containers first, then fuller ones (sum of squared fill)."""
    fill = np.bincount(bins, sizes)
    return -len(fill), float(((fill / capacity) ** 2).sum())


def settle(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Places the items without a container: by swaps that fill a container up as far as can be, then by best fit."""
    placed = bins >= 0
    kept, number = np.unique(bins[placed], return_inverse=True)
    bins[placed] = number
    free = capacity - np.bincount(number, sizes[placed], len(kept)).astype("int64")
    waiting = sorted((int(sizes[i]), int(i)) for i in np.flatnonzero(~placed))
    size, owner, left = np.where(placed, sizes, HUGE), np.where(placed, bins, 0), []
    while waiting:
        z, j = waiting.pop()
        gain = z - size
        i = int(np.where((gain > 0) & (gain <= free[owner]), gain, 0).argmax()) if len(kept) else j
        if not len(kept) or not 0 < gain[i] <= free[owner[i]]:
            left.append(j)
            continue
        owner[j], size[j], bins[j] = owner[i], z, owner[i]
        free[owner[i]] -= gain[i]
        size[i], bins[i] = HUGE, UNPLACED
        insort(waiting, (int(sizes[i]), i))
    return best_fit(left, sizes.tolist(), capacity, bins, free.tolist())


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """Injects well-filled containers of ``b`` into ``a``."""
    order = np.argsort(-np.bincount(b, sizes), kind="stable")
    full = order[: max(1, len(order) // 2)]
    count = rng.randint(1, max(1, len(order) // 12))
    start = rng.randint(0, max(0, len(full) - count))
    chosen = full[start : start + count]
    injected = np.isin(b, chosen)
    n = int(a.max()) + 1
    broken = np.zeros(n, bool)
    broken[a[injected]] = True
    bins = np.where(broken[a], UNPLACED, a)
    place = np.zeros(len(order), "int64")
    place[chosen] = n + np.arange(len(chosen))
    bins[injected] = place[b[injected]]
    return settle(bins, sizes, capacity)


def mutate(bins: np.ndarray, sizes: np.ndarray, capacity: int, rng: random.Random) -> np.ndarray:
    """Empties a few of the worst-filled containers and as many others, and places their items again."""
    order = np.argsort(np.bincount(bins, sizes), kind="stable")
    n = len(order)
    few = min(n, max(2, min(6, n // 20)))
    emptied = np.zeros(n, bool)
    emptied[order[:few]] = True
    emptied[[rng.randrange(n) for _ in range(few)]] = True
    return settle(np.where(emptied[bins], UNPLACED, bins), sizes, capacity)


def evolve(sizes: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray], plan: PackingPlan, bound: int) -> np.ndarray:
    """The best packing of one island after one epoch. Ends at once where the bound on containers is met."""
    if not len(sizes):
        return np.zeros(0, "int64")
    rng = random.Random(seed)
    crowd = [np.asarray(e, "int64") for e in elites]
    best = max(crowd, key=lambda p: fitness(p, sizes, capacity))
    if best.max() < bound:
        return best
    listed = sizes.tolist()
    while len(crowd) < plan.population:
        # Sizes blurred a little give other orders of placing.
        order = sorted(range(len(listed)), key=lambda i: -listed[i] * (1 + plan.blur * (rng.random() - 0.5)))
        crowd.append(best_fit(order, listed, capacity, np.zeros(len(listed), "int64"), []))
    scored = [(fitness(p, sizes, capacity), k, p) for k, p in enumerate(crowd)]
    for k in range(plan.children):
        a, b = rng.sample(scored, 2) if len(scored) > 1 else (scored[0], scored[0])
        if a[0] < b[0]:
            a, b = b, a
        kind = k % 3
        child = crossover(b[2], a[2], sizes, capacity, rng) if kind == 0 else mutate((a if kind == 1 else max(scored, key=lambda x: x[:2]))[2], sizes, capacity, rng)
        scored.append((fitness(child, sizes, capacity), len(crowd) + k, child))
        scored.remove(min(scored, key=lambda x: x[:2]))
        if child.max() < bound:
            break
    return max(scored, key=lambda x: x[:2])[2]


GENES = "budget string, capacity long, block long, island int, ids array<long>, parts array<int>, sizes array<long>, bins array<int>, n_bins int, squares double, first_bins int, least int"


def _gather(plan: PackingPlan):
    """A block's items as arrays, in an order that does not depend on how they arrived, with their packing by best fit and the bound."""

    def rows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pdf = table.to_pandas().sort_values(["size", "id", "part"], ascending=[False, True, True])
        sizes, capacity = pdf["size"].to_numpy("int64"), int(pdf["capacity"].iloc[0])
        first = best_fit_falling(sizes, capacity)
        return pa.table(
            {
                "budget": [pdf["budget"].iloc[0]], "capacity": [capacity], "block": [int(pdf["block"].iloc[0])],
                "ids": pa.array([pdf["id"].tolist()], pa.list_(pa.int64())), "parts": pa.array([pdf["part"].tolist()], pa.list_(pa.int32())),
                "sizes": pa.array([pdf["size"].tolist()], pa.list_(pa.int64())),
                "first": pa.array([first.tolist()], pa.list_(pa.int32())), "least": pa.array([least_bins(sizes, capacity)], pa.int32()),
            }
        )

    return rows


def _epoch(plan: PackingPlan, number: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                sizes, capacity = np.asarray(r.sizes, "int64"), int(r.capacity)
                seed = hash((int(r.block), capacity, int(r.island), number))
                bins = evolve(sizes, capacity, seed, [np.asarray(e) for e in r.elites], plan, r.least)
                n, squares = fitness(bins, sizes, capacity)
                out.append((r.budget, capacity, r.block, r.island, r.ids, r.parts, r.sizes, bins.astype("int32"), -n, squares, r.first_bins, r.least))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in GENES.split(", ")])

    return rows


def _pack_blocks(items: DataFrame, plan: PackingPlan) -> DataFrame:
    """Rows (budget, block, capacity, ids, parts, sizes, bins, n_bins, first_bins, least) with the best packing of each block.

    first_bins is what best fit in falling order alone needs, least what no packing can beat.
    """
    width = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = items.groupBy("budget", "block").applyInArrow(
        _gather(plan), "budget string, capacity long, block long, ids array<long>, parts array<int>, sizes array<long>, first array<int>, least int"
    )
    blocks = blocks.withColumn("first_bins", F.array_max("first") + 1)
    state = blocks.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(plan.islands - 1)))).withColumn("elites", F.array("first"))
    for number in range(plan.epochs):
        done = state.repartition(width, "budget", "block", "island").mapInPandas(_epoch(plan, number), GENES)
        rank = F.struct(-F.col("n_bins"), F.col("squares"), -F.col("island"))
        if number == plan.epochs - 1:
            return done.groupBy("budget", "block").agg(F.max_by(F.struct("capacity", "ids", "parts", "sizes", "bins", "n_bins", "first_bins", "least"), rank).alias("b")).select("budget", "block", "b.*")
        # The elite of each island goes to the next one, which keeps its own beside it.
        one = done.groupBy("budget", "block").agg(
            F.first(F.struct("capacity", "ids", "parts", "sizes", "first_bins", "least")).alias("b"),
            F.array_sort(F.collect_list(F.struct("island", "bins"))).alias("e"),
        )
        n = plan.islands
        state = one.select("budget", "block", "b.*", "e", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("island")).select(
            "budget", "capacity", "block", "island", "ids", "parts", "sizes", "first_bins", "least",
            F.array(F.element_at("e", F.col("island") + 1)["bins"], F.element_at("e", (F.col("island") + n - 1) % n + 1)["bins"]).alias("elites"),
        )
    raise ValueError("epochs must be 1 or more")


def _dealt(items: DataFrame, budgets: DataFrame, id_column: str, size_column: str, plan: PackingPlan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of every item and budget: its full parts, what is left of it with its block, and items without content."""
    budgets = budgets.where("capacity_tokens > 0").select(F.col("budget_name").alias("budget"), F.col("capacity_tokens").cast("long").alias("capacity"))
    items = shared_checkpoint(items.select(F.col(id_column).alias("id"), F.coalesce(F.col(size_column), F.lit(0)).cast("long").alias("size")))
    n_blocks = max(1, round(items.count() / plan.block_items))
    # Budgets are a small fixed table: every item meets each of them once.
    all_budgets = [(r.budget, r.capacity) for r in budgets.collect()]
    if not all_budgets:
        all_budgets_column = F.array().cast("array<struct<budget:string,capacity:long>>")
    else:
        all_budgets_column = F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(c).alias("capacity")) for b, c in all_budgets])
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks))
    each = items.select("id", "size", block.alias("block"), F.explode(all_budgets_column).alias("b")).select("id", "size", "block", "b.*")
    full = each.where("size > capacity").select(
        "budget", "block", "id", F.col("capacity").alias("size"), F.explode(F.sequence(F.lit(0), F.floor(F.col("size") / F.col("capacity")).cast("int") - 1)).alias("part")
    )
    rest = each.select(
        "budget", "capacity", "block", "id",
        F.when(F.col("size") > F.col("capacity"), F.floor(F.col("size") / F.col("capacity"))).otherwise(0).cast("int").alias("part"),
        F.when(F.col("size") > F.col("capacity"), F.col("size") % F.col("capacity")).otherwise(F.col("size")).alias("size"),
    )
    empty = rest.where("size = 0 and part = 0").select("budget", F.concat(F.lit("e"), "block").alias("container"), "id", "part", "size")
    return full, rest.where("size > 0"), empty


def pack(items: DataFrame, budgets: DataFrame, id_column: str = "doc_id", size_column: str = "n_tokens", plan: PackingPlan = PLAN) -> DataFrame:
    """(budget_name, container_id, ``id_column``, part, n_tokens): every item in one container of each budget.

    An item above the capacity is cut: its full parts have a container each, the rest is an item with
    the next part number; other items are never split. Items of size 0 (null or empty texts) go to one
    container of their own per block, where they take no space; null sizes count as 0. Ids must be unique. Budgets with
    a null or non-positive capacity are left out. Empty tables give no rows.
    """
    full, rest, empty = _dealt(items, budgets, id_column, size_column, plan)
    best = shared_checkpoint(_pack_blocks(rest, plan))

    cells = best.select("budget", "capacity", "block", F.explode(F.arrays_zip("bins", "ids", "parts", "sizes")).alias("c")).select(
        "budget", "capacity", "block", F.col("c.bins").alias("bin"), F.col("c.ids").alias("id"), F.col("c.parts").alias("part"), F.col("c.sizes").alias("size")
    )
    fills = cells.groupBy("budget", "block", "bin").agg(F.sum("size").alias("fill"))
    cells = cells.join(fills, ["budget", "block", "bin"])
    kept = cells.where(F.col("fill") >= F.col("capacity") * plan.well_filled)
    kept = kept.select("budget", F.concat_ws("-", F.lit("b"), "block", "bin").alias("container"), "id", "part", "size")
    left = cells.where(F.col("fill") < F.col("capacity") * plan.well_filled).withColumn("block", F.floor(F.col("block") / plan.pool_blocks).cast("long"))
    pooled = _pack_blocks(left.select("budget", "capacity", "block", "id", "part", "size"), plan)
    again = pooled.select("budget", "block", F.explode(F.arrays_zip("bins", "ids", "parts", "sizes")).alias("c")).select(
        "budget", F.concat_ws("-", F.lit("p"), "block", "c.bins").alias("container"), F.col("c.ids").alias("id"), F.col("c.parts").alias("part"), F.col("c.sizes").alias("size")
    )
    whole = full.select("budget", F.concat_ws("-", F.lit("f"), "id", "part").alias("container"), "id", "part", "size")
    out = kept.unionByName(again).unionByName(whole).unionByName(empty)
    return out.select(
        F.col("budget").alias("budget_name"), F.col("container").alias("container_id"), F.col("id").alias(id_column), "part", F.col("size").alias("n_tokens")
    )


def packing_gain(items: DataFrame, budgets: DataFrame, id_column: str = "doc_id", size_column: str = "n_tokens", plan: PackingPlan = PLAN) -> DataFrame:
    """Per budget, over the blocks before leftovers are pooled: containers by best fit in falling order alone, after
    evolution, and the least any packing needs."""
    best = _pack_blocks(_dealt(items, budgets, id_column, size_column, plan)[1], plan)
    sums = [F.sum(c).alias(n) for c, n in (("first_bins", "best_fit"), ("n_bins", "evolved"), ("least", "least"))]
    return best.groupBy("budget", "capacity").agg(F.count("*").alias("blocks"), *sums).withColumnRenamed("budget", "budget_name")


def packing_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget: containers with content, tokens, share of space used, and the least containers the volume needs."""
    bins = packed.groupBy("budget_name", "container_id").agg(F.sum("n_tokens").alias("fill"), F.count("*").alias("n")).where("fill > 0")
    return (
        bins.groupBy("budget_name")
        .agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"))
        .join(budgets.select("budget_name", "capacity_tokens"), "budget_name")
        .withColumn("used_share", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
        .withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")))
    )
