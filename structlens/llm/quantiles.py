"""Percentiles of very large numeric columns by deterministic buffer collapsing.

A sketch holds sorted buffers of `size` values, all values of a buffer standing
for the same number of originals, and a tail of single values. When `fan`
buffers of one weight w are there, they are merged and every fan-th value of the
merged order kept, at alternating middle offsets, as one buffer of weight fan*w.
One collapse moves any rank by at most fan*w/2, so the total error of a sketch
is known: it is the sum over its collapses and is carried along. Up to
size*fan - 1 values nothing is collapsed and percentiles are exact; beyond,
error/n stays under levels/(2*size) with levels = log_fan(n/size).

Sketches merge by pooling buffers of equal weight, in any order or grouping, so
what is kept per date serves every union of dates. Tasks sketch their own rows
first; the sketches of a group are then merged in two steps, by group and a
share of the tasks and by group, so that no task reads more than about the root
of a group's partial sketches, however large the group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, FAN = 1024, 8
#: Values a task holds in sketches before it hands them on and starts anew.
HELD_VALUES = 4_000_000
#: Least shares of the tasks in the first merge step; with more tasks than its square, their root.
SHARES = 16

FIELDS = "column_name string, part int, n bigint, missing bigint, lowest double, highest double, rank_error bigint, collapses bigint, levels array<int>, data array<double>"
_TYPES = [
    ("column_name", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("missing", pa.int64()), ("lowest", pa.float64()), ("highest", pa.float64()),
    ("rank_error", pa.int64()), ("collapses", pa.int64()), ("levels", pa.list_(pa.int32())), ("data", pa.list_(pa.float64())),
]


class Sketch:
    """Buffers by level (weight fan**level), a tail of single values, and the exact error of all collapses so far."""

    __slots__ = ("size", "fan", "n", "missing", "lowest", "highest", "rank_error", "collapses", "buffers", "tail", "waiting")

    def __init__(self, size: int = SIZE, fan: int = FAN) -> None:
        self.size, self.fan = size, fan
        self.n = self.missing = self.rank_error = self.collapses = self.waiting = 0
        self.lowest, self.highest = np.inf, -np.inf
        self.buffers: list[list[np.ndarray]] = []
        self.tail: list[np.ndarray] = []

    def update(self, values: np.ndarray) -> None:
        """Add values; NaN counts as missing."""
        bad = np.isnan(values)
        gone = int(bad.sum())
        self.missing += gone
        if gone:
            values = values[~bad]
        if not len(values):
            return
        self.n += len(values)
        self.lowest, self.highest = min(self.lowest, float(values.min())), max(self.highest, float(values.max()))
        self._append(values)

    def _append(self, values: np.ndarray) -> None:
        self.tail.append(values)
        self.waiting += len(values)
        if self.waiting >= self.size:
            pool = np.concatenate(self.tail)
            whole = len(pool) // self.size * self.size
            for buffer in np.sort(pool[:whole].reshape(-1, self.size), axis=1):
                self._push(0, buffer)
            self.tail, self.waiting = [pool[whole:]], len(pool) - whole

    def _push(self, level: int, buffer: np.ndarray) -> None:
        while len(self.buffers) <= level:
            self.buffers.append([])
        self.buffers[level].append(buffer)
        if len(self.buffers[level]) == self.fan:
            merged = np.sort(np.concatenate(self.buffers[level]), kind="stable")
            offset = (self.fan - 1 + self.collapses % 2) // 2
            self.buffers[level] = []
            self.collapses += 1
            self.rank_error += self.fan**level * max(offset, self.fan - 1 - offset)
            self._push(level + 1, merged[offset :: self.fan])

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.missing += other.missing
        self.rank_error += other.rank_error
        self.collapses += other.collapses
        self.lowest, self.highest = min(self.lowest, other.lowest), max(self.highest, other.highest)
        for level, buffers in enumerate(other.buffers):
            for buffer in buffers:
                self._push(level, buffer)
        for values in other.tail:
            if len(values):
                self._append(values)

    def held(self) -> int:
        return self.waiting + self.size * sum(map(len, self.buffers))

    def percentiles(self, percents: Sequence[int]) -> list[float | None]:
        """The value of rank ceil(p n / 100), to within rank_error ranks; null for an empty sketch."""
        if not self.n:
            return [None] * len(percents)
        values = [*self.tail, *(b for level in self.buffers for b in level)]
        weights = [np.ones(self.waiting, np.int64), *(np.full(self.size, self.fan**k, np.int64) for k, level in enumerate(self.buffers) for _ in level)]
        pool, weight = np.concatenate(values), np.concatenate(weights)
        order = np.argsort(pool, kind="stable")
        upto = np.cumsum(weight[order])
        ranks = [max(1, -(-p * self.n // 100)) for p in percents]
        return [float(pool[order[int(np.searchsorted(upto, r))]]) for r in ranks]

    def to_row(self, column: str, part: int) -> tuple:
        arrays = [b for level in self.buffers for b in level] + self.tail
        levels = [k for k, level in enumerate(self.buffers) for _ in level]
        data = np.concatenate(arrays) if arrays else np.zeros(0)
        low, high = (float(self.lowest), float(self.highest)) if self.n else (None, None)
        return column, part, self.n, self.missing, low, high, self.rank_error, self.collapses, levels, data

    @classmethod
    def from_row(cls, n: int, missing: int, low: float | None, high: float | None, rank_error: int, collapses: int, levels: list[int], data: np.ndarray, size: int, fan: int) -> Sketch:
        s = cls(size, fan)
        s.n, s.missing, s.rank_error, s.collapses = n, missing, rank_error, collapses
        if n:
            s.lowest, s.highest = low, high
        at = 0
        for level in levels:
            while len(s.buffers) <= level:
                s.buffers.append([])
            s.buffers[level].append(data[at : at + size])
            at += size
        if len(data) > at:
            s.tail, s.waiting = [data[at:]], len(data) - at
        return s


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def build(df: DataFrame, keys: Sequence[str], columns: Sequence[str], size: int = SIZE, fan: int = FAN) -> DataFrame:
    """Partial sketches of the columns per combination of keys, one or more per task."""
    slim = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    key_count = len(keys)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        groups: dict[tuple, list[Sketch]] = {}
        seen, schema = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(*key, *s.to_row(c, part)) for key, sketches in groups.items() for c, s in zip(columns, sketches, strict=True)]
            groups.clear()
            for i in range(0, len(rows), 2000):
                yield _batch(rows[i : i + 2000], schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            schema = schema or pa.schema([*[batch.schema.field(i) for i in range(key_count)], *_TYPES])
            codes = np.zeros(batch.num_rows, np.int64)
            for i in range(key_count):
                own = batch.column(i).dictionary_encode(null_encoding="encode")
                codes = codes * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False)
                _, codes = np.unique(codes, return_inverse=True)
            order = np.argsort(codes, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
            named = batch.select(list(range(key_count))).take(pa.array(order[first])).to_pylist()
            values = [batch.column(key_count + i).to_numpy(zero_copy_only=False).astype(float)[order] for i in range(len(columns))]
            for key, a, b in zip(named, first, np.r_[first[1:], batch.num_rows], strict=True):
                sketches = groups.get(tuple(key.values()))
                if sketches is None:
                    sketches = groups[tuple(key.values())] = [Sketch(size, fan) for _ in columns]
                for s, v in zip(sketches, values, strict=True):
                    s.update(v[a:b])
            seen += batch.num_rows * len(columns)
            if seen > HELD_VALUES and sum(s.held() for g in groups.values() for s in g) > HELD_VALUES:
                yield from flush()
                seen = 0
        if groups:
            yield from flush()

    types = {f.name: f.dataType.simpleString() for f in slim.schema}
    return slim.mapInArrow(sketch, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + FIELDS)


def _merge_sorted(df: DataFrame, keys: Sequence[str], size: int, fan: int, by_share: bool = False) -> DataFrame:
    """Merge sketches that stream by in order of keys and column, and of the share if by_share."""
    width = len(keys) + 1

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        total: Sketch | None = None
        rows: list[tuple] = []
        schema = None
        for batch in batches:
            schema = schema or pa.schema([*[batch.schema.field(i) for i in range(width - 1)], *_TYPES])
            names = batch.select(list(range(width))).to_pylist()
            scalars = [batch.column(width + i).to_pylist() for i in range(8)]
            data = batch.column(width + 8)
            for i, name in enumerate(names):
                key = (*name.values(), scalars[0][i] if by_share else 0)
                if key != current:
                    if total is not None:
                        rows.append((*current[:-2], *total.to_row(*current[-2:])))
                        if len(rows) >= 500:
                            yield _batch(rows, schema)
                            rows = []
                    current, total = key, Sketch(size, fan)
                total.merge(Sketch.from_row(*[s[i] for s in scalars[1:]], data[i].values.to_numpy(), size, fan))
        if total is not None:
            rows.append((*current[:-2], *total.to_row(*current[-2:])))
        if rows:
            yield _batch(rows, schema)

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInArrow(merge, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + FIELDS)


def merge(sketches: DataFrame, keys: Sequence[str], size: int = SIZE, fan: int = FAN) -> DataFrame:
    """One sketch per combination of keys and column, merged along a two-level tree."""
    columns = [*keys, *[f.split()[0] for f in FIELDS.split(", ")]]
    shares = max(SHARES, math.isqrt(sketches.rdd.getNumPartitions()))
    shared = sketches.select(*columns).withColumn("part", F.pmod("part", F.lit(shares)).cast("int"))
    group = [*keys, "column_name"]
    steady = ["n", "rank_error", "lowest", "highest"]
    first = shared.repartition(*group, "part").sortWithinPartitions(*group, "part", *steady)
    second = _merge_sorted(first, keys, size, fan, by_share=True).repartition(*group).sortWithinPartitions(*group, "part")
    return _merge_sorted(second, keys, size, fan)


def percentiles(sketches: DataFrame, keys: Sequence[str], percents: Sequence[int], size: int = SIZE, fan: int = FAN) -> DataFrame:
    """(keys, column_name, percent, value, n, missing, rank_error): a row per percent of each merged sketch.

    value is one whose rank lies within rank_error of ceil(percent n / 100).

    Defined cases: null and NaN are missing; infinite values are values; a group
    with missing values only has null values; null keys form a group; an empty
    table gives no row; columns other than those named are not read.
    """
    count = len(keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scalars = [batch.column(count + 2 + i).to_pylist() for i in range(7)]
            data = batch.column(count + 9)
            found = [Sketch.from_row(*[s[i] for s in scalars], data[i].values.to_numpy(), size, fan).percentiles(percents) for i in range(batch.num_rows)]
            kept = [*range(count + 1), count + 2, count + 3, count + 6]
            names = [*[batch.schema.field(i).name for i in range(count)], "column_name", "n", "missing", "rank_error", "found"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(found, pa.list_(pa.float64()))], names=names)

    types = {f.name: f.dataType.simpleString() for f in sketches.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", column_name string, n bigint, missing bigint, rank_error bigint, found array<double>"
    wide = sketches.select(*keys, *[f.split()[0] for f in FIELDS.split(", ")]).mapInArrow(read, schema)
    each = F.arrays_zip(F.array(*[F.lit(p) for p in percents]).alias("percent"), F.col("found").alias("value"))
    long = wide.select(*keys, "column_name", F.explode(each).alias("_e"), "n", "missing", "rank_error")
    return long.select(*keys, "column_name", F.col("_e").getField("percent").alias("percent"), F.col("_e").getField("value").alias("value"), "n", "missing", "rank_error")
