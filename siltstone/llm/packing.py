"""Filling containers of fixed capacity by minimum bin slack.

Items of one size can stand for each other, so the problem is one of counts: how many items
of each size there are. There are at most as many sizes as the capacity, whatever the number
of items, so the counts fit in the driver and the fillings found there hold for all items at
once. A filling starts with the largest size left; a dynamic program over bitsets finds the
multiset of other sizes left whose sum comes closest to the room left, and the counts are
found backwards from it. It is used as often as the counts allow, so the number of fillings
is bounded by the capacity, too, not by the number of items.

Items then get their rank among those of their size, and the rank gives the container. The
rank is counted in buckets of bounded size, so a size that a third of all items have is
spread over many tasks.

Defined results: an item larger than the capacity is split into parts of the capacity and
one rest, part counting from 0; no other item is split. Null and empty texts, of size 0,
take no room: their container_id is null. Equal keys are told apart by nothing and may share
a rank order; every row still gets exactly one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import bpe
from siltstone.llm.common import map_batches
from siltstone.session import written

CAPACITY = 2000
BUCKET_ROWS = 200_000

Filling = tuple[list[tuple[int, int]], int]


def fillings(counts: dict[int, int], capacity: int) -> list[Filling]:
    """[([(size, items of it)], times)]: containers that hold all items."""
    left = {s: n for s, n in counts.items() if n > 0 and s > 0}
    if any(s > capacity for s in left):
        raise ValueError("an item is larger than the capacity")
    out: list[Filling] = []
    order = sorted(left, reverse=True)
    first = 0
    while True:
        while first < len(order) and not left[order[first]]:
            first += 1
        if first == len(order):
            return out
        seed = order[first]
        room = capacity - seed
        picked = {seed: 1}
        if room:
            mask = (1 << room + 1) - 1
            stages: list[tuple[int, int]] = []
            reach = 1
            for s in order[first:]:
                n = min(left[s] - (s == seed), room // s)
                if n <= 0:
                    continue
                stages.append((s, reach))
                step = 1
                while n:
                    k = min(step, n)
                    reach |= reach << k * s & mask
                    n -= k
                    step *= 2
                if reach >> room & 1:
                    break
            total = reach.bit_length() - 1
            for s, before in reversed(stages):
                while not before >> total & 1:
                    total -= s
                    picked[s] = picked.get(s, 0) + 1
        times = min(left[s] // k for s, k in picked.items())
        for s, k in picked.items():
            left[s] -= k * times
        out.append((sorted(picked.items(), reverse=True), times))


class Slots:
    """Places of items: for each size runs of ranks, and where the containers of a run begin."""

    def __init__(self, slots: list[tuple[int, int, int, int, int]]) -> None:
        """slots: (size, first rank, rank behind the last, items of a container, first container)."""
        s = np.array(sorted(slots), np.int64).reshape(-1, 5)
        self.size, self.first, _, self.items, self.base = s.T

    def containers(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The container of each item by its size and rank, found by halving."""
        kinds, begin = np.unique(self.size, return_index=True)
        end = np.append(begin[1:], len(self.size))
        which = np.searchsorted(kinds, size)
        low, high = begin[which].copy(), end[which].copy()  # the last run that doesn't begin behind the rank is in [low, high)
        while (open_ := high - low > 1).any():
            middle = (low + high) // 2
            right = open_ & (self.first[np.minimum(middle, len(self.first) - 1)] <= rank)
            low = np.where(right, middle, low)
            high = np.where(open_ & ~right, middle, high)
        return self.base[low] + (rank - self.first[low]) // self.items[low]


def parts(items: DataFrame, capacity: int, key: str, size: str) -> DataFrame:
    """(key, part, start, n): items larger than the capacity in parts."""
    n = F.coalesce(F.col(size).cast("long"), F.lit(0))
    last = F.greatest(F.ceil(n / capacity) - 1, F.lit(0)).cast("long")
    split = items.select(key, n.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    start = F.col("part") * capacity
    return split.select(key, "part", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("_n") - start).alias("n"))


def packed(items: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(container_id, key, part, start, n): every item, or its parts, in one container each.

    items is read twice: it should be a table, or cheap.
    """
    spark = items.sparkSession
    every = parts(items, capacity, key, size)
    counts = {r["n"]: r["c"] for r in every.where("n > 0").groupBy("n").agg(F.count("*").alias("c")).collect()}
    slots, base, used = [], 0, dict.fromkeys(counts, 0)
    for filling, times in fillings(counts, capacity):
        for s, k in filling:
            slots.append((s, used[s], used[s] + k * times, k, base))
            used[s] += k * times
        base += times
    buckets = max(1, -(-max(counts.values(), default=0) // bucket_rows))
    bucket = F.pmod(F.xxhash64(key, "part"), F.lit(buckets)) if buckets > 1 else F.lit(0).cast("long")
    e = every.withColumn("_b", bucket)
    some = e.where("n > 0")
    before = Window.partitionBy("n").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = some.groupBy("n", "_b").agg(F.count("*").alias("_c")).select("n", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    rank = F.row_number().over(Window.partitionBy("n", "_b").orderBy(key, "part")).cast("long") - 1
    ranked = some.withColumn("_r", rank).join(offsets, ["n", "_b"]).withColumn("_r", F.col("_r") + F.col("_o"))
    ranked = ranked.select(key, "part", "start", "n", "_r")
    t = {f.name: f.dataType.simpleString() for f in ranked.schema}
    # Bounded by the capacity: see fillings.
    shared = spark.sparkContext.broadcast(Slots(slots))

    def make():  # noqa: ANN202
        own = shared.value

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            at = own.containers(b.column(3).to_numpy(), b.column(4).to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(at), *b.columns[:4]], names=["container_id", key, "part", "start", "n"])

        return batch

    placed = map_batches(ranked, make, f"container_id long, {key} {t[key]}, part {t['part']}, start {t['start']}, n {t['n']}")
    nothing = e.where("n <= 0").select(F.lit(None).cast("long").alias("container_id"), key, "part", "start", "n")
    return placed.unionByName(nothing)


def packed_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, name: str = "byte_bpe_50k", folder: str = bpe.TOKENIZERS) -> DataFrame:
    """packed() of texts by their size in tokens; the sizes are written once to the shared folder."""
    return packed(written(bpe.sizes(documents, key, text, name, folder), "sizes"), key, "n_tokens", capacity)


def invariants(places: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(documents, placed, broken, overfull), one row: items, items in containers, items whose parts don't follow on each other
    from 0 or that are split without need, containers over the capacity."""
    parts_ = places.groupBy(key).agg(
        F.count("container_id").alias("in"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum(F.col("start") - F.col("part") * capacity).alias("off"), F.sum("part").alias("numbers"), F.max("n").alias("largest")
    )
    broken = (F.col("off") != 0) | (F.col("numbers") * 2 != F.col("parts") * (F.col("parts") - 1)) | (F.col("parts") != F.greatest(F.ceil(F.col("n") / capacity), F.lit(1))) | (F.col("largest") > capacity)
    items = parts_.agg(F.count("*").alias("documents"), F.count_if(F.col("in") == F.col("parts")).alias("placed"), F.count_if(broken).alias("broken"))
    full = places.where("container_id is not null").groupBy("container_id").agg(F.sum("n").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("overfull"))
    return items.crossJoin(full)  # one row each
