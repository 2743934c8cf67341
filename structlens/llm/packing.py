"""Filling containers of fixed capacity with items, never splitting one that fits.

Sizes are at most the capacity, so the histogram of sizes has at most `capacity`
entries whatever the number of items, and the plan is made on it: which sizes go
together, and how often. For each size from the largest down, the exact
complement of its gap is looked up in an index of single sizes, sums of pairs and
sums of triples, and a combination is used as often as all its sizes are still available.
What has no exact complement is filled best-fit: the largest available size that
fits the gap, again and again.

Items learn their container from the plan by their rank among items of equal
size. Ranks come from counts per size and hash bucket and a row number inside a
bucket, so that a size that a third of the items have is still ranked by many
tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structlens.session import shuffle_width
from structlens.storage import materialize


@dataclass(frozen=True)
class Plan:
    """For each size: intervals of ranks and the container of each interval's first item."""

    sizes: np.ndarray  # of each interval, ascending
    starts: np.ndarray  # first rank, ascending within a size
    containers: np.ndarray  # container of the first rank; the next rank goes into the next container
    count: int


class SumIndex:
    """Which sums single, pair and triple sizes make, and sizes that make them.

    Sets of sums are bit sets of `capacity` bits: whether a gap is the sum of
    two or three sizes is one look-up, and the sizes are read off the overlap of
    one set with the mirror image of another. Sizes are used up as the plan
    grows, so an index lists sums that are no longer there; it is made anew when
    such sums have cost too many tries.
    """

    #: Tries in vain before the sets of sums are made anew.
    TRIES = 64

    def __init__(self, available: list[int]) -> None:
        self.available, self.capacity = available, len(available) - 1
        self.single = sum(1 << s for s, n in enumerate(available) if s and n)
        self.mirror = sum(1 << (self.capacity - s) for s, n in enumerate(available) if s and n)
        self._sums()

    def _sums(self) -> None:
        inside = (1 << (self.capacity + 1)) - 1
        self.pair = self.pair_mirror = self.triple = 0
        sizes = [s for s, n in enumerate(self.available) if s and n]
        for s in sizes:
            self.pair |= self.single << s & inside
            self.pair_mirror |= self.mirror >> s
        for s in sizes:
            self.triple |= self.pair << s & inside
        self.vain, self.gone = 0, False

    def drop(self, size: int) -> None:
        self.single &= ~(1 << size)
        self.mirror &= ~(1 << (self.capacity - size))
        self.gone = True

    def _left(self, size: int, taken: tuple[int, ...]) -> int:
        return self.available[size] - taken.count(size)

    def _two(self, gap: int, taken: tuple[int, ...]) -> tuple[int, int] | None:
        both = self.single & self.mirror >> (self.capacity - gap)
        while both:
            a = (both & -both).bit_length() - 1
            if 2 * a > gap:
                return None
            if self._left(a, taken) and self._left(gap - a, (*taken, a)):
                return gap - a, a
            both &= both - 1
        return None

    def find(self, gap: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        """Up to three sizes that sum to gap, each used within what is left of it beside those taken."""
        if self.single >> gap & 1 and self._left(gap, taken):
            return (gap,)
        if self.pair >> gap & 1 and (two := self._two(gap, taken)):
            return two
        if not self.triple >> gap & 1:
            return None
        largest = self.single & self.pair_mirror >> (self.capacity - gap)
        while largest:
            c = largest.bit_length() - 1
            if self._left(c, taken) and (two := self._two(gap - c, (*taken, c))):
                return c, *two
            largest ^= 1 << c
            self.vain += 1
            if self.vain > self.TRIES and self.gone:
                self._sums()
                largest &= self.pair_mirror >> (self.capacity - gap)
        return None


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Plan for sizes 1..capacity with their counts; sizes 0 take no room and no part."""
    available = [0] * (capacity + 1)
    for size, n in histogram.items():
        if size > 0:
            available[size] = int(n)
    index = SumIndex(available)
    used = [0] * (capacity + 1)
    intervals: list[tuple[int, int, int]] = []
    count = 0

    def consume(parts: tuple[int, ...]) -> None:
        nonlocal count
        distinct = set(parts)
        times = min(available[s] // parts.count(s) for s in distinct)
        for s in parts:
            intervals.append((s, used[s], count))
            used[s] += times
            available[s] -= times
        for s in distinct:
            if not available[s]:
                index.drop(s)
        count += times

    for size in range(capacity, 0, -1):
        while available[size]:
            gap = capacity - size
            if not gap:
                consume((size,))
                continue
            rest = index.find(gap, (size,))
            if rest is None:
                break
            consume((size, *rest))
    largest = np.flatnonzero(np.array(available))
    while len(largest):
        parts = [int(largest[-1])]
        taken = {parts[0]: 1}
        gap = capacity - parts[0]
        candidates = largest
        while gap:
            candidates = candidates[: np.searchsorted(candidates, gap, side="right")]
            while len(candidates) and taken.get(int(candidates[-1]), 0) >= available[candidates[-1]]:
                candidates = candidates[:-1]
            if not len(candidates):
                break
            best = int(candidates[-1])
            parts.append(best)
            taken[best] = taken.get(best, 0) + 1
            gap -= best
        consume(tuple(parts))
        largest = largest[np.array([available[s] > 0 for s in largest], bool)] if any(not available[s] for s in parts) else largest
    intervals.sort()
    table = np.array(intervals, np.int64).reshape(-1, 3)
    return Plan(table[:, 0], table[:, 1], table[:, 2], count)


def pack(items: DataFrame, key: Column, size: Column, capacity: int, buckets: int | None = None) -> DataFrame:
    """(item, piece, start, size, container): every item, or every piece of an item beyond the capacity, in one container.

    An item of more than `capacity` is cut into full pieces and a rest; no other
    is cut. Containers are numbered from 0.

    Defined cases: items of size 0 or null take no room and get a null container
    and size 0; repeated keys are separate items; an empty table gives no row;
    other columns are not read.
    """
    spark = items.sparkSession
    width = buckets or 4 * shuffle_width(spark)
    whole = items.select(key.alias("item"), F.coalesce(size, F.lit(0)).cast("bigint").alias("_size"))
    pieces = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("_size") / F.lit(float(capacity))))
    cut = whole.select("item", "_size", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)).alias("piece"))
    start = F.col("piece") * capacity
    cut = cut.select("item", "piece", start.alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("_size") - start).alias("size"), F.pmod(F.xxhash64("item", "piece"), F.lit(width)).alias("bucket"))
    cells = cut.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    cells = materialize(cells, "size-cells")
    histogram = {r["size"]: r["n"] for r in cells.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    plan = make_plan(histogram, capacity)
    upto = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("size", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("size", "bucket").orderBy("item", "piece")
    ranked = cut.withColumn("_row", F.row_number().over(inside).cast("bigint") - 1).join(offsets, ["size", "bucket"])
    ranked = ranked.select("item", "piece", "start", "size", (F.col("_row") + F.col("offset")).alias("rank"))
    sent = spark.sparkContext.broadcast((plan.sizes, plan.starts, plan.containers))  # the plan is bounded by the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, starts, containers = sent.value
        first = np.searchsorted(sizes, np.arange(capacity + 2))
        for batch in batches:
            size_of, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            out = np.full(len(size_of), -1, np.int64)
            order = np.argsort(size_of, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(size_of[order]) > 0, True]) if len(order) else np.zeros(1, int)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows = order[a:b]
                s = int(size_of[rows[0]])
                if s:
                    lo, hi = first[s], first[s + 1]
                    at = lo + np.searchsorted(starts[lo:hi], rank[rows], side="right") - 1
                    out[rows] = containers[at] + rank[rows] - starts[at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(out, mask=out < 0)], names=["item", "piece", "start", "size", "container"])

    kind = ranked.schema["item"].dataType.simpleString()
    return ranked.mapInArrow(place, f"item {kind}, piece bigint, start bigint, size bigint, container bigint")


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, pieces, room used and wasted, share used, and the fewest containers conceivable."""
    fills = packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("size").alias("filled"), F.count("*").alias("pieces"))
    total = F.coalesce(F.sum("filled"), F.lit(0))
    return fills.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"),
        total.alias("room_used"),
        (F.count("*") * capacity - total).alias("room_wasted"),
        F.count_if(F.col("filled") == capacity).alias("full_containers"),
        F.count_if(F.col("filled") > capacity).alias("overfull_containers"),
        F.ceil(total / F.lit(float(capacity))).alias("fewest_conceivable"),
    )
