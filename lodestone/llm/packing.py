"""Texts of varying length in containers of fixed capacity, by a grouping genetic algorithm on islands.

A text longer than the capacity is cut into full containers and one rest; nothing else is split. The items are spread
over shards of about ``SHARD_ITEMS`` items and at least ``SHARD_BINS`` containers (by a hash of a unique row number, so no key
can make a shard hot), so that a shard's last, badly filled container is a small part whatever the capacity. Several
islands search each shard's packing in parallel, each with its own population. Crossover injects whole well-filled
containers of one parent into another, drops the containers that hold duplicates, and best-fits what they displaced.
Between epochs each island sends its elite to the next one (a shuffle by shard and island). The best island's packing
stands; the containers of all shards that are still badly filled are dissolved, dealt to new shards and packed again.

All arrays are bounded by the items of one shard; every row is placed exactly once for each capacity.

Defined results: texts without tokens are placed at size 0; repeated rows are items of their own; capacities that are
null or not positive are left out; empty tables give empty results.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import scratch_dir, spread, written

SHARD_ITEMS, SHARD_BINS, ISLANDS, POPULATION, GENERATIONS, EPOCHS, ELITE = 512, 64, 3, 6, 20, 2, 2
WELL_FILLED, ROUNDS = 0.97, 2
_STATE = "capacity int, shard bigint, island int, uids array<bigint>, pieces array<int>, sizes array<int>, packings array<array<int>>"

Packing = list[list[int]]


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: Packing) -> Packing:
    """Place the items, largest first, each in the fullest container that has room."""
    free = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: -sizes[i]):
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        insort(free, (room - sizes[i], k))
    return bins


def fitness(bins: Packing, sizes: list[int], capacity: int) -> float:
    """Mean squared filling: rewards few containers and, among equals, full ones beside one that is nearly empty."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / len(bins) if bins else 1.0


def crossover(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Well-filled containers of ``a`` go whole into ``b``; containers with duplicates are dissolved."""
    good = [x for x in a if sum(sizes[i] for i in x) >= WELL_FILLED * capacity] or a
    chosen = rng.sample(good, max(1, len(good) // 2))
    taken = {i for x in chosen for i in x}
    kept, displaced = [list(x) for x in chosen], []
    for x in b:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced.extend(i for i in x if i not in taken)
    worst = sorted(range(len(chosen), len(kept)), key=lambda k: sum(sizes[i] for i in kept[k]))[: rng.randint(0, 3)]
    displaced.extend(i for k in worst for i in kept[k])
    return best_fit(displaced, sizes, capacity, [x for k, x in enumerate(kept) if k not in set(worst)])


def _start(sizes: list[int], capacity: int, rng: random.Random, greedy: bool) -> Packing:
    order = list(range(len(sizes)))
    if greedy:
        return best_fit(order, sizes, capacity, [])
    rng.shuffle(order)
    head = best_fit(order[: len(order) // 2], sizes, capacity, [])
    return best_fit(order[len(order) // 2 :], sizes, capacity, head)


def evolve(sizes: list[int], capacity: int, packings: list[Packing], seed: int) -> list[Packing]:
    """One epoch of an island; the best packings, best first."""
    rng = random.Random(seed)
    bound = -(-sum(sizes) // capacity)
    pool = [(fitness(p, sizes, capacity), k, p) for k, p in enumerate(packings)]
    while len(pool) < POPULATION:
        p = _start(sizes, capacity, rng, not pool)
        pool.append((fitness(p, sizes, capacity), len(pool), p))
    n = len(pool)
    for _ in range(GENERATIONS):
        pool.sort(key=lambda x: -x[0])
        if len(pool[0][2]) <= bound:
            break
        a, b = (min(rng.sample(range(len(pool)), 2)) for _ in range(2))
        child = crossover(pool[a][2], pool[b][2], sizes, capacity, rng)
        n += 1
        pool[-1] = (fitness(child, sizes, capacity), n, child)
    pool.sort(key=lambda x: -x[0])
    return [p for _, _, p in pool[:ELITE]]


def _to_labels(bins: Packing, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _to_bins(labels) -> Packing:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(labels):
        bins.setdefault(int(k), []).append(i)
    return list(bins.values())


def _epoch(number: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            packed = []
            for r in rows.itertuples(index=False):
                sizes = [int(x) for x in r.sizes]
                start = [_to_bins(x) for x in r.packings] if r.packings is not None else []
                best = evolve(sizes, int(r.capacity), start, hash((int(r.shard), int(r.island), number)))
                packed.append([_to_labels(p, len(sizes)) for p in best])
            yield rows.assign(packings=packed)

    return run


def items(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity, uid, piece, size): whole texts, and the pieces of those that exceed the capacity."""
    rows = sizes.select("uid", F.col("tokens").cast("int").alias("tokens")).crossJoin(capacities)
    last = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")).cast("int") - 1, F.lit(0))
    piece = F.explode(F.sequence(F.lit(0), last)).alias("piece")
    cut = rows.select("capacity", "uid", "tokens", piece)
    return cut.select("capacity", "uid", "piece", F.least("capacity", F.col("tokens") - F.col("piece") * F.col("capacity")).alias("size"))


def _packed(todo: DataFrame, name: str) -> DataFrame:
    """One round: (capacity, uid, piece, size, container, filled) of all items of ``todo``."""
    spark = todo.sparkSession
    by_tokens = F.floor(F.sum("size") / (F.lit(SHARD_BINS) * F.col("capacity")))
    shards = todo.groupBy("capacity").agg(F.greatest(F.lit(1), F.least(F.ceil(F.count("*") / SHARD_ITEMS), by_tokens)).cast("bigint").alias("shards"))
    todo = todo.join(shards, "capacity")
    shard = F.pmod(F.xxhash64("uid", "piece", F.lit(name)), F.col("shards"))
    grouped = todo.withColumn("shard", shard).groupBy("capacity", "shard").agg(
        F.sort_array(F.collect_list(F.struct("uid", "piece", "size"))).alias("x")
    )
    state = grouped.select(
        "capacity", "shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("x.uid").alias("uids"),
        F.col("x.piece").alias("pieces"), F.col("x.size").alias("sizes"), F.lit(None).cast("array<array<int>>").alias("packings"),
    )
    folder = scratch_dir(spark, name)
    for epoch in range(EPOCHS):
        state = written(spread(state, "capacity", "shard", "island").mapInPandas(_epoch(epoch), _STATE), f"{folder}/{epoch}")
        if epoch + 1 < EPOCHS:
            sent = state.select(
                "capacity", "shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("packings", 1, 1).alias("guest")
            )
            state = state.join(sent, ["capacity", "shard", "island"]).select(
                *[c.split()[0] for c in _STATE.split(", ")[:-1]], F.concat("packings", "guest").alias("packings")
            )
    first = F.col("packings")[0]
    n_bins = F.array_max(first) + 1
    best = state.groupBy("capacity", "shard").agg(F.min_by(F.struct("uids", "pieces", "sizes", first.alias("bins")), F.struct(n_bins, "island")).alias("b"))
    flat = best.select("capacity", "shard", F.inline(F.arrays_zip("b.uids", "b.pieces", "b.sizes", "b.bins")))
    flat = flat.toDF("capacity", "shard", "uid", "piece", "size", "bin")
    filled = flat.groupBy("capacity", "shard", "bin").agg(F.sum("size").alias("filled"))
    label = F.concat_ws("-", "capacity", F.lit(name), "shard", "bin")
    return flat.join(filled, ["capacity", "shard", "bin"]).select("capacity", "uid", "piece", "size", label.alias("container"), "filled")


def pack(sizes: DataFrame, capacities: DataFrame | list[int]) -> DataFrame:
    """(capacity, container, uid, piece, size) for every item and capacity; capacities are a table with that column, or a list."""
    spark = sizes.sparkSession
    if not isinstance(capacities, DataFrame):
        capacities = spark.createDataFrame([(c,) for c in capacities], "capacity int")
    wanted = capacities.select(F.col("capacity").cast("int").alias("capacity")).where("capacity > 0").distinct()
    folder = scratch_dir(spark, "packed")
    every = items(sizes, wanted)
    whole = F.col("size") == F.col("capacity")
    full = every.where(whole).select("capacity", "uid", "piece", "size", F.concat_ws("-", "capacity", F.lit("full"), "uid", "piece").alias("container"))
    todo, done = every.where(~whole), full
    for k in range(ROUNDS):
        packed = written(_packed(todo, f"r{k}"), f"{folder}/{k}")
        good = F.lit(True) if k + 1 == ROUNDS else F.col("filled") >= WELL_FILLED * F.col("capacity")
        done = done.unionByName(packed.where(good).select(done.columns))
        todo = packed.where(~good).select("capacity", "uid", "piece", "size")
    return done


def filling(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, the least number of containers any packing needs, and the share of room used."""
    bins = packed.groupBy("capacity", "container").agg(F.sum("size").alias("filled"), F.count("*").alias("n_items"))
    return bins.groupBy("capacity").agg(
        F.count("*").alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("filled").alias("n_tokens"),
        F.ceil(F.sum("filled") / F.first("capacity")).alias("least_containers"),
        F.round(F.sum("filled") / (F.count("*") * F.first("capacity")), 4).alias("used"), F.max("filled").alias("fullest"),
    )
