"""Problem 6: filling containers of fixed capacity with documents of varying length.

The plan is made on the histogram of lengths, not on the documents: containers are filled best-fit, longest
length first, and equal containers are planned once with a count.  The histogram has at most ``capacity``
entries, however many documents there are, so the driver holds a bounded plan.  The documents then take the
planned slots by joining on their rank within their length.  Ranks are counted in hashed parts of a length
and offset by the parts before, so a length that holds a third of all documents never meets in one task.

A document longer than the capacity is divided into full containers and a rest, and only such a document.

Defined results: null and empty texts and unknown lengths count as length 0 and take no room, they get a piece of length 0 in the
container ``-1``; documents of equal length are interchangeable, their order is by a hash of their id; an empty
table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents per part in which ranks are counted.
PART_ROWS = 100_000
#: Bits of a rank in the key (length, rank) of a slot.
RANK_BITS = 44


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (size, first rank, last rank, first container, documents per container) and the number of containers.

    Each step opens one kind of container with the longest length left and fills it with the longest length
    that still fits, again and again; the kind is repeated as often as all its lengths allow.
    """
    left = {size: n for size, n in histogram.items() if size > 0 and n > 0}
    sizes = sorted(left, reverse=True)
    used: Counter[int] = Counter()
    slots, containers = [], 0
    heap = [-s for s in sizes]
    heapq.heapify(heap)
    ascending = sorted(left)
    while left:
        while heap and -heap[0] not in left:
            heapq.heappop(heap)
        largest = -heap[0]
        kind, room = Counter({largest: 1}), capacity - largest
        while room > 0:
            at = _below(ascending, room)
            while at >= 0:
                size = ascending[at]
                free = left.get(size, 0) - kind[size]
                if free > 0:
                    break
                at -= 1
            if at < 0:
                break
            take = min(free, room // size)
            kind[size] += take
            room -= take * size
        times = min(left[size] // n for size, n in kind.items())
        for size, n in kind.items():
            slots.append((size, used[size], used[size] + n * times - 1, containers, n))
            used[size] += n * times
            left[size] -= n * times
            if not left[size]:
                del left[size]
                ascending.remove(size)
        containers += times
    return slots, containers


def _below(ascending: list[int], room: int) -> int:
    """Place of the largest size that is at most ``room``, or -1."""
    import bisect

    return bisect.bisect_right(ascending, room) - 1


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, size): one piece per document, more only where n_tokens exceeds the capacity."""
    full = F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / capacity).cast("int")
    sized = sized.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    return sized.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), full)).alias("piece")).select(
        "doc_id", "piece", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("size")
    )


def ranked(part: DataFrame, parts: int) -> DataFrame:
    """Adds ``rank`` from 0 within ``size``, counted in hashed parts."""
    split = part.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    counts = split.groupBy("size", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("size", "_part").orderBy(F.xxhash64("doc_id"), "doc_id", "piece"))
    return split.withColumn("_within", within).join(offsets, ["size", "_part"]).select("doc_id", "piece", "size", (F.col("_before") + F.col("_within") - 1).alias("rank"))


def pack(spark: SparkSession, sized: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, size, container) for documents with their n_tokens.

    The plan has at most a few slots per length, so it is bounded by the capacity and is broadcast, ordered by length and
    first rank: a piece finds its slot by bisection, however many slots its length has.
    """
    part = pieces(sized, capacity)
    counted = {r["size"]: r["n"] for r in part.groupBy("size").agg(F.count("*").alias("n")).collect()}
    total = sum(counted.values())
    slots = np.array(sorted(plan(counted, capacity)[0]) or np.empty((0, 5)), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast((slots[:, 0] << RANK_BITS | slots[:, 1], slots[:, 1], slots[:, 3], slots[:, 4]))

    @F.pandas_udf("bigint")
    def container(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        keys, first, opened, each = shared.value
        rank = ranks.to_numpy(np.int64)
        slot = np.searchsorted(keys, sizes.to_numpy(np.int64) << RANK_BITS | rank, "right") - 1
        return pd.Series(opened[slot] + (rank - first[slot]) // each[slot])

    placed = ranked(part.where(F.col("size") > 0), max(1, total // PART_ROWS + 1))
    full = placed.select("doc_id", "piece", "size", container("size", "rank").alias("container"))
    return full.unionByName(part.where(F.col("size") <= 0).select("doc_id", "piece", "size", F.lit(-1).cast("long").alias("container")))
