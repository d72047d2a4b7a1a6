"""Filling containers of fixed capacity with items of varying length.

The plan is made over the histogram of lengths and not over the items: best-fit decreasing places counts of equal
items into groups of equal containers, which gives a list of slots (length, range of ranks, containers). Items
then take the planned slots by their rank within their length.

Scale: the histogram has at most one row per length up to the capacity, whatever the number of items; ranks within
a length are assigned in buckets whose offsets come from their counts, so that a length that a third of all items
share is ranked by many tasks; items are shuffled once, without their contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.runtime import staged

#: Items of one length that one task ranks.
RANKED_TOGETHER = 200_000

Slot = tuple[int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Slot], int]:
    """Best-fit decreasing over counts: (length, first rank, last rank + 1, first container, items per container), and the number of containers.

    Items of length 0 take no room and are spread over all containers.
    """
    slots: list[Slot] = []
    n_bins = 0
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> groups of (first container, number)
    rooms: list[int] = []

    def put(room: int, first: int, number: int) -> None:
        if room > 0 and number > 0:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((first, number))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        rank, n = 0, histogram[length]
        while rank < n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(at)
            else:
                room, first = capacity, n_bins
                number = -(-(n - rank) // (capacity // length))
                n_bins += number
            each = room // length
            full = min(number, (n - rank) // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each))
                put(room - each * length, first, full)
                rank += full * each
            rest = n - rank if full < number else 0
            if rest:
                slots.append((length, rank, rank + rest, first + full, rest))
                put(room - rest * length, first + full, 1)
                rank += rest
                put(room, first + full + 1, number - full - 1)
            elif full < number:
                put(room, first + full, number - full)
    zeros = histogram.get(0, 0)
    if zeros:
        n_bins = max(1, n_bins)
        slots.append((0, 0, zeros, 0, -(-zeros // n_bins)))
    return slots, n_bins


#: Capacities are below this, so that a length and a rank below 2^44 fit one number.
MOST_CAPACITY = 1 << 19


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """id_col, part, n_tokens, container_id: every item in one container, or a longer one in as many parts as it needs.

    An item longer than the capacity is cut into full parts, each with a container to itself, and a last part that
    is packed like an item; no other item is split. Items of size 0 or null take no room and get a container too.
    Repeated rows are items of their own. The sum of n_tokens in a container never exceeds the capacity. An empty
    table gives no row.
    """
    if not 0 < capacity < MOST_CAPACITY:
        raise ValueError(f"a capacity is 1 to {MOST_CAPACITY - 1}")
    spark = items.sparkSession
    size = F.greatest(F.coalesce(F.col(size_col), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    whole = F.floor(size / capacity).cast("int")
    last = (size % capacity).cast("long")
    n_parts = F.greatest(whole + F.when(last > 0, 1).otherwise(0), F.lit(1))
    parts = staged(
        items.select(F.col(id_col), size.alias("_size"), F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"))
        .select(id_col, "part", F.least(F.col("_size") - F.col("part").cast("long") * capacity, F.lit(capacity)).cast("long").alias("n_tokens")),
        "pack-items",
    )
    histogram = {r["n_tokens"]: r["n"] for r in parts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity + 1 rows
    slots, _ = plan(histogram, capacity)
    buckets = spark.createDataFrame([(k, max(1, -(-n // RANKED_TOGETHER))) for k, n in sorted(histogram.items())], "n_tokens long, n_buckets int")
    spread = parts.join(F.broadcast(buckets), "n_tokens").withColumn("_bucket", F.pmod(F.xxhash64(id_col, "part"), F.col("n_buckets")).cast("int"))
    counts = spread.groupBy("n_tokens", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("n_tokens", "_bucket", (F.sum("n").over(Window.partitionBy("n_tokens").orderBy("_bucket")) - F.col("n")).alias("_before"))
    within = Window.partitionBy("n_tokens", "_bucket").orderBy(id_col, "part")
    ranked = spread.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["n_tokens", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    # Slots sorted by (length, first rank); a length's ranks are below 2^44.
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)
    starts = (table[:, 0] << 44) | table[:, 1]
    first_rank, first_bin, each = table[:, 1], table[:, 3], table[:, 4]

    @F.pandas_udf("long")
    def container(length: pd.Series, rank: pd.Series) -> pd.Series:
        at = np.searchsorted(starts, (length.to_numpy(np.int64) << 44) | rank.to_numpy(np.int64), side="right") - 1
        return pd.Series(first_bin[at] + (rank.to_numpy(np.int64) - first_rank[at]) // each[at])

    return ranked.select(id_col, "part", "n_tokens", container("n_tokens", F.col("_rank").cast("long")).alias("container_id"))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: n_containers, n_tokens, the least number of containers that any packing needs, and the filled share."""
    totals = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    out = totals.agg(F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"), F.coalesce(F.max("n"), F.lit(0)).alias("fullest"))
    return out.select("n_containers", "n_tokens", "fullest", F.ceil(F.col("n_tokens") / capacity).alias("least_containers"), F.round(F.col("n_tokens") / F.greatest(F.col("n_containers") * capacity, F.lit(1)), 6).alias("filled_share"))
