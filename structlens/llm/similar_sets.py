"""All pairs of set-valued records whose sets overlap above a Jaccard threshold.

Records with equal sets form one class, so copies never meet each other in the
join. The sets' items are ordered rare first. Two sets that reach the threshold
share at least l items among the first n - ceil(t n) + l of each (the l-prefix,
n the set's size). The join starts with l = 1: every set goes, once per item of
its 1-prefix, to the group of that item, and its items go with it. In a group of
ordinary size all pairs are compared where they meet: by size, by the bits set
in only one of two 64-bit signatures (a lower bound of the items in only one of
the sets), and, what is left, by overlap. The sets of a group that has grown hot
are not compared. Where that makes fewer rows than pairs, they go on to l = 2,
under the combinations of their item with another one of their longer prefix,
hot combinations to l = 3, and so on. A pair whose shared combinations at one
level are all hot shares, at the next, one that extends a hot one, so nothing is
lost. Prefixes are thus as long as the data need, set by set. Any other hot
group is compared in blocks, two at a time, by as many tasks.

The order by rarity needs no dictionary: items are counted in a table of cells
of fixed size, chosen by the item's hash, and ordered by their cell's count and
their hash. Any order serves; an item alone in its cell is in no other set and
opens no group.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structlens.storage import materialize

#: Cells of the table of item counts, which the driver holds and sends out: 4 MB whatever the data.
CELLS = 1 << 20
#: Pairs compared at a time.
BLOCK_PAIRS = 2_000_000

_PREFIX = "key bigint, side int, facing int, set_id binary, combo array<bigint>, tokens array<bigint>"
_MET = "hot int, key bigint, set_id binary, combo array<bigint>, tokens array<bigint>, set_b binary, overlap int, n_a int, n_b int"
_PREFIX_TYPE = pa.schema([("key", pa.int64()), ("side", pa.int32()), ("facing", pa.int32()), ("set_id", pa.binary()), ("combo", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])
_MET_TYPE = pa.schema([("hot", pa.int32()), ("key", pa.int64()), ("set_id", pa.binary()), ("combo", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("set_b", pa.binary()), ("overlap", pa.int32()), ("n_a", pa.int32()), ("n_b", pa.int32())])


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))


def _parts(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and edges of a list column without nulls."""
    edges = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False), edges - edges[0]


def _least_overlap(n: np.ndarray, t: Fraction) -> np.ndarray:
    return (n * t.numerator + t.denominator - 1) // t.denominator


def set_classes(records: DataFrame, key: str, items: str, min_items: int) -> tuple[DataFrame, DataFrame]:
    """members (record_key, set_id) and classes (set_id, rows, items) of the records with at least min_items items, of one at least.

    set_id is a 128-bit digest of the sorted items, items their 64-bit hashes.
    """
    clean = records.where(F.col(key).isNotNull()).select(F.col(key).alias("record_key"), F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(items), F.array())))).alias("_items"))
    clean = clean.where(F.size("_items") >= max(1, min_items))
    members = clean.select("record_key", F.unhex(F.md5(F.to_json("_items"))).alias("set_id"), F.transform("_items", lambda x: F.xxhash64(x)).alias("items"))
    members = materialize(members, "members")
    classes = members.groupBy("set_id").agg(F.count("*").alias("rows"), F.first("items").alias("items"))
    return members.select("record_key", "set_id"), materialize(classes, "classes")


def _cell_counts(classes: DataFrame) -> np.ndarray:
    """How many classes have an item of each cell."""
    cells = classes.select(F.explode(F.transform("items", lambda x: F.pmod(x, F.lit(CELLS)).cast("int"))).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    counts = np.zeros(CELLS, np.int32)
    found = cells.toArrow()  # at most CELLS rows
    counts[found["cell"].to_numpy()] = np.minimum(found["n"].to_numpy(), np.iinfo(np.int32).max)  # any order serves
    return counts


def _first_prefixes(t: Fraction, counts):
    """Sets with their items rare first, once per item of the 1-prefix that another set may have."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, edges = _parts(batch.column(1))
            n = np.diff(edges)
            row = np.repeat(np.arange(len(n)), n)
            count = counts.value[flat % CELLS]  # numpy's remainder, like pmod, is never negative
            order = np.lexsort((flat, count, row))
            tokens, count = flat[order], count[order]
            place = np.arange(len(flat)) - np.repeat(edges[:-1], n)
            chosen = np.flatnonzero((place < np.repeat(n - _least_overlap(n, t) + 1, n)) & (count > 1))
            of = pa.array(row[chosen])
            zero = pa.array(np.zeros(len(chosen), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(tokens[chosen]), zero, zero, batch.column(0).take(of), pa.nulls(len(chosen), pa.list_(pa.int64())), _lists(tokens, edges).take(of)], schema=_PREFIX_TYPE)

    return cut


def _combination_key(combo: list[int]) -> int:
    """A 64-bit number of a combination; two that collide only make candidates that fail verification."""
    mixed = np.uint64(len(combo))
    with np.errstate(over="ignore"):
        for x in sorted(combo):
            mixed = (mixed ^ np.uint64(x & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return int(mixed.astype(np.int64))


def _longer_prefixes(t: Fraction, level: int):
    """Hot combinations with one more item of the longer prefix; a combination of one item is its key."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, combos, of = [], [], []
            for i, (key, combo, tokens) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True)):
                n, combo = len(tokens), combo or [key]
                for x in tokens[: n - int(_least_overlap(np.int64(n), t)) + level]:
                    if x not in combo:
                        combos.append([*combo, x])
                        keys.append(_combination_key(combos[-1]))
                        of.append(i)
            at = pa.array(of, pa.int64())
            zero = pa.array(np.zeros(len(of), np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), zero, zero, batch.column(1).take(at), pa.array(combos, pa.list_(pa.int64())), batch.column(3).take(at)], schema=_PREFIX_TYPE)

    return cut


def _overlaps(a: np.ndarray, b: np.ndarray, flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many items the sets at a and at b share."""
    n = np.diff(edges)
    pair = np.arange(len(a))
    which = np.r_[np.repeat(pair, n[a]), np.repeat(pair, n[b])]
    rows = np.r_[a, b]
    lengths = n[rows]
    starts = np.repeat(edges[rows] - np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    items = flat[starts + np.arange(int(lengths.sum()))]
    order = np.lexsort((items, which))
    which, items = which[order], items[order]
    twice = np.flatnonzero((which[1:] == which[:-1]) & (items[1:] == items[:-1]))
    return np.bincount(which[twice], minlength=len(a))


#: What becomes of the rows of a group: compared where they are, lengthened, compared in blocks.
COMPARED, LENGTHENED, IN_BLOCKS = 0, 1, 2


class _Group:
    """Rows of groups in key order: compares whole groups, hands on hot ones."""

    def __init__(self, t: Fraction, hot: int | None, last: bool) -> None:
        self.t, self.hot, self.last = t, hot, last
        self.held: pa.RecordBatch | None = None
        self.hot_key: int | None = None
        self.way = COMPARED

    def hot_way(self, rows: pa.RecordBatch) -> int:
        """Whether lengthening the prefixes of a hot group makes fewer rows than comparing makes pairs, by its first rows."""
        if self.last:
            return IN_BLOCKS
        n = pa.compute.list_value_length(rows.column(5).slice(0, self.hot + 1)).to_numpy()
        return LENGTHENED if self.hot >= 2 * float((n - _least_overlap(n, self.t) + 1).mean()) else IN_BLOCKS

    def pairs(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, ids = rows.column(0).to_numpy(), rows.column(3)
        side, facing = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        flat, edges = _parts(rows.column(5))
        n = np.diff(edges)
        marks = np.bitwise_or.reduceat(np.uint64(1) << ((flat >> 20) & 63).astype(np.uint64), edges[:-1]) if len(n) else np.zeros(0, np.uint64)
        after = np.searchsorted(keys, keys, side="right") - np.arange(len(keys)) - 1
        upto = np.cumsum(after)
        num, den = self.t.numerator, self.t.denominator
        start = 0
        while start < len(keys):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + BLOCK_PAIRS, side="right")))
            here = after[start:stop]
            a = np.repeat(np.arange(start, stop), here)
            b = a + np.arange(len(a)) - np.repeat(np.cumsum(here) - here, here) + 1
            start = stop
            na, nb = n[a], n[b]
            ok = (na * den >= nb * num) & (nb * den >= na * num) & ((facing[a] == side[a]) | (side[a] != side[b]))
            # overlap o needs o (den + num) >= num (na + nb), so at most na + nb - 2 o items are in one of the two only
            ok &= np.bitwise_count(marks[a] ^ marks[b]) * (den + num) <= (na + nb) * (den - num)
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            shared = _overlaps(a, b, flat, edges)
            ok = shared * den >= (n[a] + n[b] - shared) * num
            a, b, shared = a[ok], b[ok], shared[ok]
            if len(a):
                yield self._met(ids.take(pa.array(a)), ids.take(pa.array(b)), shared, n[a], n[b])

    @staticmethod
    def _met(a: pa.Array, b: pa.Array, shared: np.ndarray, na: np.ndarray, nb: np.ndarray) -> pa.RecordBatch:
        size = len(a)
        none = pa.nulls(size, pa.list_(pa.int64()))
        counts = [pa.array(x.astype(np.int32)) for x in (shared, na, nb)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, COMPARED, np.int32)), pa.nulls(size, pa.int64()), a, none, none, b, *counts], schema=_MET_TYPE)

    @staticmethod
    def _handed_on(rows: pa.RecordBatch, way: int) -> pa.RecordBatch:
        size = rows.num_rows
        none = pa.nulls(size, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, way, np.int32)), rows.column(0), rows.column(3), rows.column(4), rows.column(5), pa.nulls(size, pa.binary()), none, none, none], schema=_MET_TYPE)

    def ended(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Whole groups, except that the first may be the rest of a hot one."""
        keys = rows.column(0).to_numpy()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[first, len(keys)])
        ways = np.full(len(first), COMPARED)
        if self.hot is not None:
            for g in np.flatnonzero((size > self.hot) | (keys[first] == self.hot_key)):
                ways[g] = self.way if keys[first[g]] == self.hot_key else self.hot_way(rows.slice(int(first[g]), int(size[g])))
        each = np.repeat(ways, size)
        for way in (LENGTHENED, IN_BLOCKS):
            if (each == way).any():
                yield self._handed_on(rows.filter(pa.array(each == way)), way)
        if (each == COMPARED).any():
            yield from self.pairs(rows.filter(pa.array(each == COMPARED)))

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if self.held is not None:
                batch = pa.Table.from_batches([self.held, batch]).combine_chunks().to_batches()[0]
            keys = batch.column(0).to_numpy()
            last = int(keys[-1])
            edge = int(np.searchsorted(keys == last, True))
            tail = batch.slice(edge)
            if edge:
                yield from self.ended(batch.slice(0, edge))
            if self.hot is not None and (last == self.hot_key or tail.num_rows > self.hot):
                if last != self.hot_key:
                    self.hot_key, self.way = last, self.hot_way(tail)
                self.held = None
                yield self._handed_on(tail, self.way)
            else:
                self.held = tail
        if self.held is not None:
            yield from self.ended(self.held)


def _meet(rows: DataFrame, t: Fraction, hot: int | None, last: bool) -> DataFrame:
    """Rows of one key brought together: pairs of ordinary groups, and the rows of hot ones."""
    together = rows.repartition("key").sortWithinPartitions("key", "set_id")
    return together.mapInArrow(lambda batches: _Group(t, hot, last).run(batches), _MET)


def _in_blocks(handed: DataFrame, t: Fraction, hot: int) -> DataFrame:
    """The pairs of hot groups, every two blocks of about `hot` sets (and every block with itself) being a group of its own."""
    sizes = handed.groupBy(F.col("key").alias("_key")).agg(F.ceil(F.count("*") / F.lit(float(hot))).cast("int").alias("_blocks"))
    placed = handed.join(sizes, F.col("key") == F.col("_key")).withColumn("side", F.pmod(F.xxhash64("set_id"), F.col("_blocks")).cast("int"))
    faced = placed.withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    two = F.xxhash64("key", F.least("side", "facing"), F.greatest("side", "facing"))
    return _meet(faced.select(two.alias("key"), "side", "facing", "set_id", "combo", "tokens"), t, None, True)


def class_pairs(classes: DataFrame, threshold: Fraction, min_items: int, hot: int = 2048, max_level: int = 4) -> DataFrame:
    """(set_a, set_b, overlap, n_a, n_b) of different sets at or above the threshold, each pair once.

    A group is hot if more than `hot` sets are in it; this and max_level shape the work, never the result.
    """
    t = Fraction(threshold)
    counts = classes.sparkSession.sparkContext.broadcast(_cell_counts(classes))  # CELLS numbers
    last = max(1, min(max_level, -(-min_items * t.numerator // t.denominator)))
    rows = classes.select("set_id", "items").mapInArrow(_first_prefixes(t, counts), _PREFIX)
    found = []
    for level in range(1, last + 1):
        met = materialize(_meet(rows, t, hot, level == last), f"met-{level}")
        ways = {r["hot"] for r in met.select("hot").distinct().collect()}  # three at most
        found.append(met.where(F.col("hot") == COMPARED))
        if IN_BLOCKS in ways:
            found.append(_in_blocks(met.where(F.col("hot") == IN_BLOCKS), t, hot))
        if LENGTHENED not in ways:
            break
        handed = met.where(F.col("hot") == LENGTHENED).select("key", "set_id", "combo", "tokens")
        rows = handed.mapInArrow(_longer_prefixes(t, level + 1), _PREFIX).dropDuplicates(["key", "set_id"])
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.select(F.least("set_id", "set_b").alias("set_a"), F.greatest("set_id", "set_b").alias("set_b"), "overlap", F.when(F.col("set_id") < F.col("set_b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(F.col("set_id") < F.col("set_b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b")).distinct()


def similar_pairs(records: DataFrame, key: str, items: str, threshold: Fraction = Fraction(4, 5), min_items: int = 5, hot: int = 2048, max_level: int = 4) -> DataFrame:
    """(id_a, id_b, overlap, united): every pair of records at or above the threshold, id_a < id_b.

    Defined cases: an item counts once per record, null items and lists for
    nothing; records with fewer than min_items items or a null key take no part;
    records with equal sets pair with overlap = united = size; rows repeating a
    key and set give no pair with themselves; an empty table gives no pair.
    """
    members, classes = set_classes(records, key, items, min_items)
    pairs = materialize(class_pairs(classes, threshold, min_items, hot, max_level), "class-pairs")
    copied = classes.where("rows > 1").select("set_id", F.size("items").alias("n"))
    wanted = pairs.select(F.explode(F.array("set_a", "set_b")).alias("set_id")).unionByName(copied.select("set_id")).distinct()
    taking_part = members.join(wanted, "set_id", "left_semi").distinct()
    one = taking_part.select(F.col("record_key").alias("x"), F.col("set_id").alias("set_a"))
    two = taking_part.select(F.col("record_key").alias("y"), F.col("set_id").alias("set_b"))
    united = (F.col("n_a") + F.col("n_b") - F.col("overlap")).alias("united")
    across = pairs.join(one, "set_a").join(two, "set_b").select("x", "y", "overlap", united).where(F.col("x") != F.col("y"))
    twin = taking_part.select(F.col("record_key").alias("y"), "set_id")
    inside = copied.join(taking_part.select(F.col("record_key").alias("x"), "set_id"), "set_id").join(twin, "set_id").where(F.col("x") < F.col("y")).select("x", "y", F.col("n").alias("overlap"), F.col("n").alias("united"))
    both = across.unionByName(inside)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "overlap", "united")


def similarity_classes(records: DataFrame, key: str, items: str, threshold: Fraction = Fraction(4, 5), min_items: int = 5, hot: int = 2048, max_level: int = 4) -> DataFrame:
    """(record_key, class_key, class_size, links): each record's class of equal sets and its number of similar other records.

    Unlike similar_pairs this stays as large as the input whatever the copies.
    """
    members, classes = set_classes(records, key, items, min_items)
    members = members.distinct()
    sized = members.groupBy("set_id").agg(F.count("*").alias("class_size"), F.min("record_key").alias("class_key"))
    pairs = class_pairs(classes, threshold, min_items, hot, max_level).select("set_a", "set_b")
    ends = pairs.union(pairs.select("set_b", "set_a")).toDF("set_id", "other")
    other = sized.select(F.col("set_id").alias("other"), F.col("class_size").alias("_n"))
    links = ends.join(other, "other").groupBy("set_id").agg(F.sum("_n").alias("_links"))
    known = sized.join(links, "set_id", "left").select("set_id", "class_key", "class_size", (F.coalesce("_links", F.lit(0)) + F.col("class_size") - 1).alias("links"))
    return members.join(known, "set_id").select("record_key", "class_key", "class_size", "links")
