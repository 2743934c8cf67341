"""Items that appear together: stripes with log-likelihood-ratio significance.

For every item an associative array of the neighbours met in the same record is
built inside each task (all pairs of a block of records are counted before
anything is emitted) and shuffled as one row: the item, its neighbours and their
counts. Stripes of an item are merged by key as they stream by in key order.
The stripe of an item on very many records is split by neighbour, so that no
task merges all of it.

Two prunings are exact for the result asked for: an item on fewer than
min_joint records is in no pair of min_joint, and where a least lift is given,
joint <= min(count_a, count_b) rules out items on more than 1/lift of all records.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structlens.llm.encoding import dictionary, encode
from structlens.storage import materialize

#: Pairs counted at a time in one task.
BLOCK_PAIRS = 2_000_000
#: An item on more records than this has its stripe split into SPLITS parts by neighbour.
SPLIT_RECORDS = 100_000
SPLITS = 32

_STRIPE = pa.schema([("item", pa.int64()), ("part", pa.int32()), ("neighbours", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
_PAIR = pa.schema([("item", pa.int64()), ("neighbour", pa.int64()), ("joint", pa.int64())])


def _counted(items: np.ndarray, neighbours: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (item, neighbour) in order, with summed weights."""
    order = np.lexsort((neighbours, items))
    a, b = items[order], neighbours[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    if weights is None:
        n = np.diff(np.r_[first, len(a)])
    else:
        n = np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, np.int64)
    return a[first], b[first], n


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        lengths = np.diff(lists.offsets.to_numpy())
        after = np.concatenate([np.arange(n - 1, -1, -1) for n in lengths]) if len(lengths) else np.zeros(0, np.int64)
        edges = np.cumsum(after)
        start = 0
        while start < len(flat):
            stop = max(start + 1, int(np.searchsorted(edges, (edges[start - 1] if start else 0) + BLOCK_PAIRS, side="right")))
            here = after[start:stop]
            at = np.repeat(np.arange(start, stop), here)
            offset = np.arange(len(at)) - np.repeat(np.cumsum(here) - here, here) + 1
            items, neighbours, n = _counted(flat[at], flat[at + offset], None)
            part = np.where(items & 1, (neighbours >> 1) % SPLITS, 0).astype(np.int32)
            order = np.lexsort((neighbours, part, items))
            items, neighbours, n, part = items[order], neighbours[order], n[order], part[order]
            if len(items):
                first = np.flatnonzero(np.r_[True, (items[1:] != items[:-1]) | (part[1:] != part[:-1])])
                offsets = pa.array(np.r_[first, len(items)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(items[first]), pa.array(part[first]), pa.ListArray.from_arrays(offsets, pa.array(neighbours)), pa.ListArray.from_arrays(offsets, pa.array(n))], schema=_STRIPE)
            start = stop


def _merge(least: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        held_key: tuple[int, int] | None = None

        def emit(items: np.ndarray, neighbours: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            a, b, joint = _counted(items, neighbours, n)
            keep = joint >= least
            return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(joint[keep])], schema=_PAIR)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            items = np.repeat(keys, lengths)
            neighbours = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            n = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            if held is not None:
                if held_key != (int(keys[0]), int(parts[0])):
                    yield emit(*held)
                else:
                    items, neighbours, n = (np.concatenate(pair) for pair in zip(held, (items, neighbours, n), strict=True))
            ended = np.flatnonzero((keys != keys[-1]) | (parts != parts[-1]))
            tail = int(lengths[(ended[-1] + 1 if len(ended) else 0) :].sum())
            if len(ended):
                cut = len(items) - tail
                yield emit(items[:cut], neighbours[:cut], n[:cut])
                items, neighbours, n = items[cut:], neighbours[cut:], n[cut:]
            held, held_key = _counted(items, neighbours, n), (int(keys[-1]), int(parts[-1]))
        if held is not None:
            yield emit(*held)

    return merge


def _xlogx(k: Column) -> Column:
    return F.when(k > 0, k * F.ln(k)).otherwise(0.0)


def log_likelihood_ratio(joint: Column, a: Column, b: Column, n: Column) -> Column:
    """Dunning's G of the two-by-two table of two items, 0 or more."""
    d = lambda c: c.cast("double")
    cells = _xlogx(d(joint)) + _xlogx(d(a - joint)) + _xlogx(d(b - joint)) + _xlogx(d(n - a - b + joint))
    margins = _xlogx(d(a)) + _xlogx(d(n - a)) + _xlogx(d(b)) + _xlogx(d(n - b))
    return F.greatest(F.lit(0.0), 2 * (cells - margins + _xlogx(d(n))))


def cooccurrence(records: DataFrame, key: str, items: str, min_joint: int = 5, min_lift: Fraction | int | None = None, min_llr: float | None = None) -> DataFrame:
    """(item_a, item_b, joint, count_a, count_b, records, lift, llr) with item_a < item_b, for pairs on at least min_joint records.

    With min_lift, only pairs with joint * records >= min_lift * count_a * count_b;
    with min_llr, only pairs whose log-likelihood ratio is that high.

    Defined cases: an item counts once per record; null items and null or empty
    lists count for nothing, but their records count in `records`; repeated rows
    of a key are separate records; an empty table gives no pair; other columns
    are not read.
    """
    clean = records.select(F.monotonically_increasing_id().alias("_record"), F.array_distinct(F.array_compact(F.coalesce(F.col(items), F.array()))).alias("_items"))
    baskets = materialize(clean, "baskets")
    total = baskets.count()
    lift = Fraction(min_lift) if min_lift is not None else None
    keep = F.col("records") >= min_joint
    if lift is not None:
        keep = keep & (F.col("records") * lift.numerator <= total * lift.denominator)
    numbers = dictionary(baskets, "_items", keep)
    coded = numbers.withColumn("number", F.col("number") * 2 + (F.col("records") > SPLIT_RECORDS).cast("int"))
    encoded = encode(baskets, "_record", "_items", coded).where(F.size("tokens") > 1).select("tokens")
    stripes = encoded.mapInArrow(_stripes, "item bigint, part int, neighbours array<bigint>, counts array<bigint>")
    pairs = stripes.repartition("item", "part").sortWithinPartitions("item", "part").mapInArrow(_merge(min_joint), "item bigint, neighbour bigint, joint bigint")
    one = coded.select(F.col("number").alias("item"), F.col("item").alias("name_x"), F.col("records").alias("count_x"))
    two = coded.select(F.col("number").alias("neighbour"), F.col("item").alias("name_y"), F.col("records").alias("count_y"))
    named = pairs.join(one, "item").join(two, "neighbour")
    if lift is not None:
        wide = lambda c: F.col(c).cast("decimal(18,0)")
        named = named.where(wide("joint") * F.lit(total * lift.denominator).cast("decimal(18,0)") >= wide("count_x") * wide("count_y") * lift.numerator)
    swap = F.col("name_x") > F.col("name_y")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    n = F.lit(total).cast("bigint")
    if min_llr is not None:
        named = named.where(log_likelihood_ratio(F.col("joint"), F.col("count_x"), F.col("count_y"), n) >= min_llr)
    return named.select(
        pick("name_x", "name_y").alias("item_a"),
        pick("name_y", "name_x").alias("item_b"),
        "joint",
        pick("count_x", "count_y").alias("count_a"),
        pick("count_y", "count_x").alias("count_b"),
        n.alias("records"),
        (F.col("joint").cast("double") * total / (F.col("count_x").cast("double") * F.col("count_y"))).alias("lift"),
        log_likelihood_ratio(F.col("joint"), F.col("count_x"), F.col("count_y"), n).alias("llr"),
    )
