"""Vectors: scaling, projection, blockwise nearest neighbours, novelty, deterministic clustering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from structlens.storage import materialize

#: Vectors per block of the all-against-all search.
BLOCK_ROWS = 2048
#: Vector components measured exactly at a time.
EXACT_CELLS = 1 << 21


def _packed(df: DataFrame, key: str, vector: str, blocks: int, prefix: str) -> DataFrame:
    """Blocks of about BLOCK_ROWS vectors as one row each."""
    slot = F.pmod(F.xxhash64(key), F.lit(blocks))
    return df.select(slot.alias(f"{prefix}block"), F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v")).groupBy(f"{prefix}block").agg(F.collect_list(F.struct("_k", "_v")).alias(f"{prefix}rows"))


def _k_best(k: int, metric: str):
    """For rows of (q_rows, r_rows): the k nearest of each block of references to each query of a block.

    The product rounds, so it only rules out: whatever is within its rounding
    bound of the k-th smallest is measured exactly, however many copies tie.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_rows, r_rows in zip(batch["q_rows"], batch["r_rows"], strict=True):
                q_keys, r_keys = np.array([r["_k"] for r in q_rows]), np.array([r["_k"] for r in r_rows])
                q, r = np.array([r_["_v"] for r_ in q_rows], float), np.array([r_["_v"] for r_ in r_rows], float)
                order = np.argsort(r_keys, kind="stable")
                r_keys, r = r_keys[order], r[order]
                if metric == "cosine":
                    q, r = q / np.linalg.norm(q, axis=1, keepdims=True), r / np.linalg.norm(r, axis=1, keepdims=True)
                squares = (q * q).sum(1)[:, None] + (r * r).sum(1)[None, :]
                guess = squares - 2 * q @ r.T if metric == "l2" else 1 - q @ r.T
                same = q_keys[:, None] == r_keys[None, :]
                guess[same] = np.inf
                dim = q.shape[1]
                slack = 4 * (dim + 4) * (np.finfo(float).eps * squares + np.finfo(float).tiny)  # above the rounding of guess and exact distance together
                last = min(k, len(r_keys)) - 1
                limit = np.partition(guess + slack, last, axis=1)[:, last : last + 1]  # k references at least are as near as this
                rows, cols = np.nonzero(~(guess - slack > limit) & ~same)  # what overflowed is no number and stays
                exact, step = np.empty(len(rows)), max(1, EXACT_CELLS // max(1, dim))
                for at in range(0, len(rows), step):
                    x, y = q[rows[at : at + step]], r[cols[at : at + step]]
                    exact[at : at + step] = np.sqrt(((x - y) ** 2).sum(1)) if metric == "l2" else 1 - (x * y).sum(1)
                ok = np.isfinite(exact)
                rows, cols, exact = rows[ok], cols[ok], exact[ok]
                by = np.lexsort((cols, exact, rows))  # references stand in key order
                rows, cols, exact = rows[by], cols[by], exact[by]
                first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                yield pd.DataFrame({"key": q_keys[rows[first]], "other": r_keys[cols[first]], "distance": exact[first]})

    return search


def _merged(kept: DataFrame, key: str, k: int) -> DataFrame:
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "other"))), 1, k)  # k rows per block met
    merged = kept.groupBy("key").agg(best.alias("_b")).select("key", F.posexplode("_b").alias("rank", "_n"))
    return merged.select(F.col("key").alias(key), F.col("_n.other").alias("other"), F.col("_n.distance").alias("distance"), (F.col("rank") + 1).alias("rank"))


def nearest(queries: DataFrame, reference: DataFrame, key: str, vector: str, k: int, metric: str = "l2") -> DataFrame:
    """(key, other, distance, rank): the k nearest of the reference by (distance, key), a key never being its own neighbour.

    All queries meet all references, block against block: every pair of blocks
    is one matrix product that keeps k rows per query, and the kept rows are
    reduced to k per query afterwards. Block size bounds a task's memory. The
    work grows with queries times references; where that is too much and most
    of the neighbours are enough, see CellIndex.
    """
    blocks_q = max(1, -(-queries.count() // BLOCK_ROWS))
    blocks_r = max(1, -(-reference.count() // BLOCK_ROWS))
    left, right = _packed(queries, key, vector, blocks_q, "q_"), _packed(reference, key, vector, blocks_r, "r_")
    tiles = left.select("q_block", "q_rows", F.explode(F.expr(f"sequence(0L, {blocks_r - 1}L)")).alias("r_block"))
    kind = queries.schema[key].dataType.simpleString()
    kept = tiles.join(right, "r_block").select("q_rows", "r_rows").mapInPandas(_k_best(k, metric), f"key {kind}, other {kind}, distance double")
    return _merged(kept, key, k)


def _near_centers(z: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    squares = (z * z).sum(1)[:, None] - 2 * z @ centers.T + (centers * centers).sum(1)[None, :]
    return np.argsort(squares, axis=1, kind="stable")[:, :n]


class CellIndex:
    """Vectors in the cells of a coarse quantiser, for neighbours that need not all be the true ones.

    Centres are fitted on a bounded sample (the SAMPLE rows of smallest key
    hash); every vector is put into the cell of its nearest centre. A query
    looks into its `probes` nearest cells; probes_for tells how many the data ask
    for: few where vectors come in clusters, most where they are strewn evenly. Cells are searched in blocks, so a
    cell that holds a third of all vectors is searched by many tasks. Recall
    against the exact search depends on the data and on probes: measure it
    (recall).
    """

    #: Rows the centres are fitted on, and the most cells there are.
    SAMPLE, MOST_CELLS = 20_000, 1024

    def __init__(self, df: DataFrame, key: str, vector: str, cells: int | None = None, rounds: int = 10) -> None:
        self.key, self.vector = key, vector
        rows = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias(vector))
        sample = np.array([r[0] for r in rows.orderBy(F.xxhash64(key), key).limit(self.SAMPLE).select(vector).collect()], float)
        n = cells or max(1, min(self.MOST_CELLS, int(len(sample) ** 0.5) // 2))
        self.centers = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)] if len(sample) else np.zeros((0, 0))
        for _ in range(rounds if len(sample) else 0):
            at = _near_centers(sample, self.centers, 1)[:, 0]
            for c in range(len(self.centers)):
                if (at == c).any():
                    self.centers[c] = sample[at == c].mean(0)
        self.rows = materialize(self._placed(rows, 1), "cell-index")
        sizes = self.rows.groupBy("cell").agg(F.count("*").alias("n"))  # a row per cell
        self.sizes = {r["cell"]: r["n"] for r in sizes.collect()}

    def _placed(self, rows: DataFrame, probes: int) -> DataFrame:
        """(key, vector, cell): each vector once per cell among its nearest."""
        kind = rows.schema[self.key].dataType.simpleString()
        centers = self.centers

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    z = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    cells = _near_centers(z, centers, probes)
                    of = pa.array(np.repeat(np.arange(len(z)), cells.shape[1]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(cells.ravel().astype(np.int32))], names=["k", "v", "cell"])

        return rows.mapInArrow(place, f"k {kind}, v array<double>, cell int").select(F.col("k").alias(self.key), F.col("v").alias(self.vector), "cell")

    def probes_for(self, k: int, least: float = 0.9, queries: int = 64, margin: float = 0.04) -> int:
        """The fewest cells to probe so that a bounded sample of queries finds `least` (and a margin) of its true k nearest.

        The sample's true neighbours come from the exact search; a neighbour is
        found if its cell is among the query's nearest so many.
        """
        sample = materialize(self.rows.orderBy(F.xxhash64(self.key, F.lit("probe")), self.key).limit(queries), "probe-queries")
        true = nearest(sample, self.rows, self.key, self.vector, k).join(self.rows.select(F.col(self.key).alias("other"), F.col("cell").alias("_c")), "other")
        asked = {r[0]: r[1] for r in sample.select(self.key, self.vector).collect()}
        pairs = true.select(self.key, "_c").collect()  # k rows per query of the sample
        if not pairs:
            return 1
        order = {x: np.argsort(_near_centers(np.array([v], float), self.centers, len(self.centers))[0]) for x, v in asked.items()}
        places = np.sort([int(order[r[0]][r[1]]) for r in pairs])
        return int(places[min(len(places) - 1, int(np.ceil(min(1.0, least + margin) * len(places))) - 1)]) + 1

    def search(self, queries: DataFrame, k: int, probes: int, metric: str = "l2") -> DataFrame:
        """(key, other, distance, rank) of the k nearest found in the probed cells; queries need not be in the index."""
        blocks = F.lit(1)
        for cell, n in self.sizes.items():
            if n > BLOCK_ROWS:
                blocks = F.when(F.col("cell") == cell, F.lit(-(-n // BLOCK_ROWS))).otherwise(blocks)
        packed = lambda df, name, slots: df.withColumn("slot", F.pmod(F.xxhash64(self.key), slots).cast("int")).groupBy("cell", "slot").agg(F.collect_list(F.struct(F.col(self.key).alias("_k"), F.col(self.vector).alias("_v"))).alias(name))
        refs = packed(self.rows, "r_rows", blocks)
        asked = self._placed(queries.select(self.key, F.col(self.vector).cast("array<double>").alias(self.vector)), probes)
        spread = max(1, -(-queries.count() // BLOCK_ROWS))
        tiles = packed(asked, "q_rows", F.lit(spread)).drop("slot").join(refs.drop("slot"), "cell")
        kind = queries.schema[self.key].dataType.simpleString()
        kept = tiles.select("q_rows", "r_rows").mapInPandas(_k_best(k, metric), f"key {kind}, other {kind}, distance double")
        return _merged(kept, self.key, k)


def recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """(queries, recall): share of the exact neighbours that were found, per query and over all."""
    both = exact.select(key, "other").join(found.select(key, "other").withColumn("_hit", F.lit(1)), [key, "other"], "left")
    return both.agg(F.count_distinct(key).alias("queries"), F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


def _tiles(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(_g, q_slot, q_rows, r_slot, r_rows): every two blocks of a group's vectors, and each block with itself; a hot group has many."""
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / F.lit(float(BLOCK_ROWS))).cast("int").alias("_blocks"))
    slot = F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")
    placed = df.join(sizes, F.col(group) == F.col("_g")).select("_g", "_blocks", slot.alias("_slot"), F.struct(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v")).alias("_row"))
    packed = placed.groupBy("_g", "_blocks", "_slot").agg(F.collect_list("_row").alias("rows"))
    left = packed.select("_g", F.col("_slot").alias("q_slot"), F.col("rows").alias("q_rows"), F.explode(F.sequence(F.col("_slot"), F.col("_blocks") - 1)).alias("r_slot"))
    return left.join(packed.select("_g", F.col("_slot").alias("r_slot"), F.col("rows").alias("r_rows")), ["_g", "r_slot"]).select("_g", "q_slot", "q_rows", "r_slot", "r_rows")


def group_distances(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(group, key_a, key_b, l2, cosine) of every two vectors of a group, key_a < key_b; cosine is null beside a zero vector."""
    g_kind, k_kind = df.schema[group].dataType.simpleString(), df.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, q_slot, q_rows, r_slot, r_rows in batch.itertuples(index=False):
                keys, z = np.array([r["_k"] for r in r_rows]), np.array([r["_v"] for r in r_rows], float)
                norms = np.sqrt((z * z).sum(1))
                for row in q_rows:
                    x = np.array(row["_v"], float)
                    take = keys > row["_k"] if q_slot == r_slot else np.ones(len(keys), bool)
                    theirs, swap = keys[take], keys[take] < row["_k"]
                    scale = norms[take] * np.sqrt((x * x).sum())
                    with np.errstate(divide="ignore", invalid="ignore"):
                        cosine = np.where(scale > 0, 1 - z[take] @ x / scale, np.nan)
                    yield pd.DataFrame({"g": g, "a": np.where(swap, theirs, row["_k"]), "b": np.where(swap, row["_k"], theirs), "l2": np.sqrt(((z[take] - x) ** 2).sum(1)), "cosine": cosine})

    out = _tiles(df, group, key, vector).mapInPandas(measure, f"g {g_kind}, a {k_kind}, b {k_kind}, l2 double, cosine double")
    return out.select(F.col("g").alias(group), F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"), "l2", F.nanvl("cosine", F.lit(None).cast("double")).alias("cosine"))


def widest(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(group, widest): the largest distance between two vectors of each group, 0 for one, in blocks of a group's vectors."""
    kind = df.schema[group].dataType.simpleString()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g, q_rows, r_rows in zip(batch["_g"], batch["q_rows"], batch["r_rows"], strict=True):
                q, r = (np.array([x["_v"] for x in rows], float) for rows in (q_rows, r_rows))
                squares = (q * q).sum(1)[:, None] + (r * r).sum(1)[None, :]
                guess = squares - 2 * q @ r.T
                slack = 8 * (q.shape[1] + 4) * np.finfo(float).eps * squares.max()
                rows, cols = np.nonzero(guess >= guess.max() - slack)
                step = max(1, EXACT_CELLS // max(1, q.shape[1]))
                most = max(float(((q[rows[i : i + step]] - r[cols[i : i + step]]) ** 2).sum(1).max()) for i in range(0, len(rows), step))
                yield pd.DataFrame({"g": [g], "widest": [most**0.5]})

    tops = _tiles(df, group, key, vector).select("_g", "q_rows", "r_rows").mapInPandas(measure, f"g {kind}, widest double")
    return tops.groupBy(F.col("g").alias(group)).agg(F.max("widest").alias("widest"))


def novelty(entities: DataFrame, train: DataFrame, key: str, vector: str, ks: Sequence[int], metric: str = "l2") -> DataFrame:
    """(key, k, novelty): mean distance to the k nearest train entities, self excluded; a k not below the train size is left out."""
    size = train.count()
    usable = [k for k in ks if k < size]
    if size < 2:
        raise ValueError("novelty needs two train entities or more")
    near = nearest(entities, train, key, vector, max(usable), metric)
    each = near.select(key, "distance", "rank", F.explode(F.array(*[F.lit(k) for k in usable])).alias("k")).where(F.col("rank") <= F.col("k"))
    return each.groupBy(key, "k").agg(F.avg("distance").alias("novelty"))


def moments(df: DataFrame, vector: str) -> DataFrame:
    """(idx, n, mean, variance, std): population moments per component; std is 1 where the variance is 0."""
    long = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("idx", "x"))
    stats = long.groupBy("idx").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))
    return stats.withColumn("std", F.when(F.col("variance") > 0, F.sqrt("variance")).otherwise(1.0))


def standardize(df: DataFrame, vector: str, fitted: DataFrame) -> DataFrame:
    """df with the vector scaled by fitted moments; the moments are one row of 2·dim numbers."""
    one = fitted.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "mean", "std"))), lambda s: F.struct(s["mean"].alias("m"), s["std"].alias("s"))).alias("_fit"))
    scaled = F.zip_with(F.col(vector).cast("array<double>"), "_fit", lambda x, f: (x - f["m"]) / f["s"])
    return df.crossJoin(F.broadcast(one)).withColumn(vector, scaled).drop("_fit")  # one row


def leading_components(fitted: DataFrame, n: int) -> DataFrame:
    """The n components of largest variance, ties to the lower index."""
    return fitted.orderBy(F.desc("variance"), "idx").limit(n)


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, members, centroid): components are summed inside tasks, one row per task and group is shuffled."""
    kind = df.schema[group].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).dictionary_encode(null_encoding="encode")
            codes, names = own.indices.to_numpy(), own.dictionary.to_pylist()
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            z = flat.reshape(batch.num_rows, -1)
            order = np.argsort(codes, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
            totals, counts = np.add.reduceat(z[order], first, axis=0), np.diff(np.r_[first, len(order)])
            for code, total, n in zip(codes[order][first], totals, counts, strict=True):
                row = held.setdefault(names[code], [0, 0.0])
                row[0] += int(n)
                row[1] = row[1] + total
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), group_type), pa.array([r[0] for r in held.values()], pa.int64()), pa.array([list(r[1]) for r in held.values()], pa.list_(pa.float64()))], names=["group", "n", "total"])

    from pyspark.sql.pandas.types import to_arrow_type

    group_type = to_arrow_type(df.schema[group].dataType)
    parts = df.where(F.col(vector).isNotNull()).select(group, F.col(vector).cast("array<double>")).mapInArrow(sums, f"group {kind}, n bigint, total array<double>")
    every = F.array_sort(F.collect_list(F.struct("n", "total")))  # a row per task; in order, so that the sum does not depend on who came first
    g = parts.groupBy("group").agg(every.alias("_p"), F.sum("n").alias("members"))
    size = F.size(F.get("_p", F.lit(0))["total"])
    total = F.aggregate("_p", F.array_repeat(F.lit(0.0), size), lambda a, p: F.zip_with(a, p["total"], lambda x, y: x + y))
    return g.select(F.col("group").alias(group), "members", F.transform(total, lambda x: x / F.col("members")).alias("centroid"))


def assign(df: DataFrame, key: str, vector: str, centers: list[list[float]]) -> DataFrame:
    """(key, cluster, distance): the nearest centre, ties to the lower number. Centres are few: k of them."""
    each = [F.struct(F.sqrt(F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(x)) for x in c]), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centers)]
    return df.select(key, vector, F.array_min(F.array(*each)).alias("_a")).select(key, vector, F.col("_a.cluster").alias("cluster"), F.col("_a.distance").alias("distance"))


def vectors_at(df: DataFrame, key: str, vector: str, places: Sequence[int]) -> list[list[float]]:
    """The vectors at given places of the key order, in the order of the places.

    Keys are ranked in two levels: places before a range of keys are sums of
    counts, places inside come from a row number, so no task sees all keys.
    """
    split = df.select(key).repartitionByRange(key).withColumn("_part", F.spark_partition_id())
    split = materialize(split, "ranged-keys")
    sizes = sorted((r["_part"], r["n"]) for r in split.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row per range
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    if not starts:
        return []
    offset = F.coalesce(*[F.when(F.col("_part") == part, F.lit(n)) for part, n in starts])
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1 + offset
    wanted = split.select(key, place.alias("_place")).where(F.col("_place").isin(list(set(places))))
    found = {r["_place"]: list(r["_v"]) for r in df.join(F.broadcast(wanted), key).select("_place", F.col(vector).cast("array<double>").alias("_v")).collect()}  # k rows
    return [found[p] for p in places]


def starting_centers(df: DataFrame, key: str, vector: str, k: int) -> list[list[float]]:
    """The vectors at places 0, s, 2s, ... in key order, s = max(1, n // k)."""
    n = df.count()
    step = max(1, n // k)
    return vectors_at(df, key, vector, [i * step for i in range(k) if i * step < n])


def update_centers(assigned: DataFrame, vector: str, centers: list[list[float]]) -> list[list[float]]:
    """Means of the members; a cluster without members keeps its centre."""
    found = {r["cluster"]: list(r["centroid"]) for r in centroids(assigned, "cluster", vector).collect()}  # k rows
    return [found.get(i, c) for i, c in enumerate(centers)]


def kmeans_centers(df: DataFrame, vector: str, centers: list[list[float]], most: int = 50, tolerance: float = 0.0) -> list[list[float]]:
    """Centres after Lloyd's steps until none moves by more than the tolerance; by default until they stand still.

    A step is one pass over the vectors: tasks find the nearest centres and sum
    their members; a row per centre and task is shuffled, k rows reach the driver.
    """
    for _ in range(most):
        moved = update_centers(nearest_centers(df, vector, centers), vector, centers)
        still = max(abs(a - b) for x, y in zip(centers, moved, strict=True) for a, b in zip(x, y, strict=True)) <= tolerance
        centers = moved
        if still:
            break
    return centers


def nearest_centers(df: DataFrame, vector: str, centers: list[list[float]]) -> DataFrame:
    """(cluster, vector): every vector with its nearest centre, ties to the lower number."""
    c = np.array(centers, float)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                found = np.stack([((z - x) ** 2).sum(1) for x in c]).argmin(0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(found), batch.column(0)], names=["cluster", vector])

    return df.select(F.col(vector).cast("array<double>").alias(vector)).mapInArrow(find, f"cluster int, {vector} array<double>")


def kmeans(df: DataFrame, key: str, vector: str, k: int, most: int = 50, tolerance: float = 0.0) -> DataFrame:
    """(key, vector, cluster, distance) after Lloyd's steps from the fixed start; the vectors are written once for all steps."""
    df = materialize(df.select(key, vector), "kmeans-vectors")
    return assign(df, key, vector, kmeans_centers(df, vector, starting_centers(df, key, vector, k), most, tolerance))


def all_distances(df: DataFrame, key: str, vector: str, metric: str = "l2") -> DataFrame:
    """(key_a, key_b, distance) for key_a < key_b, block against block; as many rows as pairs, whoever asks for them."""
    blocks = max(1, -(-df.count() // BLOCK_ROWS))
    left, right = _packed(df, key, vector, blocks, "q_"), _packed(df, key, vector, blocks, "r_")
    tiles = left.select("q_block", "q_rows", F.explode(F.expr(f"sequence(q_block, {blocks - 1}L)")).alias("r_block")).join(right, "r_block")
    kind = df.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mine, q_rows, other, r_rows in zip(batch["q_block"], batch["q_rows"], batch["r_block"], batch["r_rows"], strict=True):
                keys, values = np.array([r["_k"] for r in r_rows]), np.array([r["_v"] for r in r_rows], float)
                norms = np.sqrt((values * values).sum(1))
                for i, row in enumerate(q_rows):
                    x = np.array(row["_v"], float)
                    take = keys > row["_k"] if mine == other else np.ones(len(keys), bool)
                    if metric == "l2":
                        d = np.sqrt(((values[take] - x) ** 2).sum(1))
                    else:
                        d = 1 - values[take] @ x / (norms[take] * np.sqrt((x * x).sum()))
                    theirs = keys[take]
                    swap = theirs < row["_k"]
                    yield pd.DataFrame({"a": np.where(swap, theirs, row["_k"]), "b": np.where(swap, row["_k"], theirs), "distance": d})

    out = tiles.select("q_block", "q_rows", "r_block", "r_rows").mapInPandas(measure, f"a {kind}, b {kind}, distance double")
    return out.select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"), "distance")
