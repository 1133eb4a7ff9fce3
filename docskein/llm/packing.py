"""Filling fixed-capacity sequences with records (problem 2).

Records are dealt by hash into shards of about shard_records, so no group grows with the data. Inside a shard a record longer
than the capacity is cut into consecutive pieces, of which all but the last are full sequences of their own. The rest is
divided by Karmarkar-Karp multiway differencing: each record starts as a partial partition of k windows; the two partial
partitions with the greatest imbalance are merged, the fullest window of one with the emptiest of the other, until one is
left. A window that exceeds the capacity is first divided anew together with emptier ones (levelled); k starts at the least
number that the total length allows and rises by one whenever a window still exceeds the capacity. Only ids and lengths are
shuffled, never texts, and the shards are spread over tasks by their number, however few bytes they have.

Null or empty texts, and records of a group without a capacity of at least one, aren't placed. Repeated rows of one id in one
group are one record (the longest). Ties are broken by id, so the result is the same in each run.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docskein.session import stage


#: Tasks over which the shards are spread; more shards share a task.
MOST_TASKS = 20_000


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The places of sizes in k windows, by multiway differencing."""
    heap: list[tuple] = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, dtype=np.int64)
        sums[0] = size
        heap.append((-size, i, sums, [(i,)] + [()] * (k - 1)))
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heap[0]
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        merged = [in_a[j] + in_b[k - 1 - j] for j in order]
        heapq.heapreplace(heap, (int(sums[-1] - sums[0]), count, sums, merged))
        count += 1
    return [list(w) for w in heap[0][3]] if heap else []


def _subset_sums(sizes: list[int], pool: list[int]) -> np.ndarray:
    """The sum of every subset of pool; bit t of the place says whether pool[t] is in it."""
    out = np.zeros(1, dtype=np.int64)
    for i in pool:
        out = np.concatenate([out, out + sizes[i]])
    return out


def _parted(pool: list[int], bits: int) -> tuple[list[int], list[int]]:
    return [x for t, x in enumerate(pool) if bits >> t & 1], [x for t, x in enumerate(pool) if not bits >> t & 1]


def _in_two(sizes: list[int], pool: list[int], capacity: int) -> tuple | None:
    """pool as two windows within the capacity, the first as full as possible."""
    sums = _subset_sums(sizes, pool)
    fits = np.where((sums <= capacity) & (sums[-1] - sums <= capacity), sums, -1)
    best = int(fits.argmax())
    return _parted(pool, best) if fits[best] >= 0 else None


def _in_three(sizes: list[int], pool: list[int], capacity: int, tries: int = 4) -> tuple | None:
    """pool as three windows within the capacity, from the fullest first windows."""
    sums = _subset_sums(sizes, pool)
    fits = np.where(sums <= capacity, sums, -1)
    for bits in np.argsort(-fits, kind="stable")[:tries]:
        if fits[bits] < 0:
            return None
        first, rest = _parted(pool, int(bits))
        found = _in_two(sizes, rest, capacity)
        if found:
            return first, *found
    return None


def _divided(sizes: list[int], pool: list[int], k: int, capacity: int, most: int = 14) -> tuple | None:
    """pool as k windows within the capacity, or null: exactly for two or three windows of at most most records, else by differencing."""
    if k <= 3 and len(pool) <= most:
        return _in_two(sizes, pool, capacity) if k == 2 else _in_three(sizes, pool, capacity)
    new = [[pool[x] for x in w] for w in differencing([sizes[x] for x in pool], k)]
    return tuple(new) if max(sum(sizes[x] for x in w) for w in new) <= capacity else None


def levelled(sizes: list[int], found: list[list[int]], capacity: int) -> list[list[int]] | None:
    """Windows within the capacity, from windows of which some exceed it; null if one of them can't be helped.

    An overfull window is divided anew with each other window that has room for it, then with each two neighbours in the order of
    emptiness, then with the 4, 8, ... emptiest ones, up to all, until the windows of such a group fit.
    """
    found, sums = [list(w) for w in found], [sum(sizes[i] for i in w) for w in found]
    for i in sorted(range(len(found)), key=lambda i: -sums[i]):
        order = [j for j in sorted(range(len(found)), key=lambda j: sums[j]) if j != i]
        group = 1
        while sums[i] > capacity and group <= len(order):
            for at in range(len(order) - group + 1 if group <= 2 else 1):
                chosen = [i, *order[at : at + group]]
                if sum(sums[j] for j in chosen) > capacity * len(chosen):
                    break
                new = _divided(sizes, [x for j in chosen for x in found[j]], len(chosen), capacity)
                if new:
                    for j, w in zip(chosen, new):
                        found[j], sums[j] = w, sum(sizes[x] for x in w)
                    break
            group *= 2
        if sums[i] > capacity:
            return None
    return found


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most capacity; every size must fit."""
    k = -(-sum(sizes) // capacity)
    while True:
        found = levelled(sizes, differencing(sizes, k), capacity)
        if found is not None:
            return [w for w in found if w]
        k += 1


def pack(df: DataFrame, id_col: str, text_col: str, group_col: str, capacities: DataFrame, capacity_group: str, capacity_col: str, shard_records: int = 1000) -> DataFrame:
    """group, sequence, place, id, start, length: each piece of each record, its sequence (from 0 in each group) and place in it.

    start is the piece's first character in the record's text, counted from 0.
    """
    limits = capacities.where(F.col(capacity_col) >= 1).groupBy(F.col(capacity_group).alias("group")).agg(F.min(capacity_col).cast("long").alias("capacity"))
    rows = (
        df.where(F.length(text_col) > 0)
        .select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), F.length(text_col).cast("long").alias("length"))
        .groupBy("group", "id")
        .agg(F.max("length").alias("length"))
    )
    rows = stage(rows.join(limits, "group"), "lengths")  # read twice below
    shards = rows.groupBy("group").agg(F.ceil(F.count("*") / shard_records).alias("shards"))
    tasks = max(1, min(2 * int(shards.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]), MOST_TASKS))
    dealt = rows.join(shards, "group").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards"))).repartition(tasks, "group", "shard")
    kind, group_kind = rows.schema["id"].dataType.simpleString(), rows.schema["group"].dataType.simpleString()

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        capacity = int(pdf["capacity"].iloc[0])
        length = pdf["length"].to_numpy(np.int64)
        out: list[tuple] = []  # window, place, row, start, length
        count = 0
        for i in np.flatnonzero(length > capacity):
            for start in range(0, int(length[i]) - capacity + 1, capacity):
                out.append((count, 0, i, start, capacity))
                count += 1
        rest = np.where(length > capacity, length % capacity, length)
        at = np.flatnonzero(rest)
        for w in windows([int(x) for x in rest[at]], capacity):
            out += [(count, place, at[i], length[at[i]] - rest[at[i]], rest[at[i]]) for place, i in enumerate(sorted(w))]
            count += 1
        window, place, row, start, size = (np.array(x) for x in zip(*out))
        return pd.DataFrame({"group": pdf["group"].iloc[0], "shard": pdf["shard"].iloc[0], "window": window, "place": place, "id": pdf["id"].to_numpy()[row], "start": start, "length": size})

    filled = dealt.groupBy("group", "shard").applyInPandas(fill, f"group {group_kind}, shard long, window long, place int, id {kind}, start long, length long")
    filled = stage(filled, "packed")  # read twice below
    # Sequences are numbered through the shards of a group: a running sum over one row for each shard.
    used = filled.groupBy("group", "shard").agg((F.max("window") + 1).alias("used"))
    before = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = used.select("group", "shard", F.coalesce(F.sum("used").over(before), F.lit(0)).alias("first"))
    return filled.join(first, ["group", "shard"]).select("group", (F.col("first") + F.col("window")).alias("sequence"), "place", "id", "start", "length")


def fill_report(packed: DataFrame, capacities: DataFrame, capacity_group: str, capacity_col: str) -> DataFrame:
    """For each group: records, sequences, the least number possible, characters, the fullest sequence and the share used."""
    limits = capacities.groupBy(F.col(capacity_group).alias("group")).agg(F.min(capacity_col).cast("long").alias("capacity"))
    each = packed.groupBy("group", "sequence").agg(F.sum("length").alias("chars"), F.sum((F.col("start") == 0).cast("long")).alias("records"))
    return (
        each.groupBy("group")
        .agg(F.sum("records").alias("records"), F.count("*").alias("sequences"), F.sum("chars").alias("chars"), F.max("chars").alias("fullest"))
        .join(limits, "group")
        .select("group", "records", "sequences", F.ceil(F.col("chars") / F.col("capacity")).alias("least"), "chars", "fullest", (F.col("chars") / (F.col("sequences") * F.col("capacity"))).alias("used"))
    )
