"""The feature space of games and situations as geometry: scaled and projected views, distances, neighbours, novelty, clusters.

Everything is fitted on training games and applied to all games and situations.
The space has 42 columns (see design_space); fitted figures are one row.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structlens.operators import design_space as ds
from structlens.operators import geometry
from structlens.operators import situations as sit
from structlens.storage import materialize, together

VIEWS = ("canonical", "normalized", "projected")


@dataclass(frozen=True)
class Space:
    """(id, z) per view of games and situations, and what was fitted."""

    games: dict[str, DataFrame]
    situations: dict[str, DataFrame]
    train: DataFrame
    kept: tuple[int, ...]

    def view(self, level: str, name: str = "normalized") -> DataFrame:
        found = {"game": self.games, "situation": self.situations}[level].get(name)
        if found is None:
            raise ValueError(f"the space has no {name} view")
        return found


def keep_components(df: DataFrame, kept: Sequence[int], vector: str = "z") -> DataFrame:
    """The vector's components at the places kept, in that order."""
    return df.withColumn(vector, F.array(*[F.get(F.col(vector), F.lit(i)) for i in kept]))


def build_space(s: sit.Situations, train: DataFrame, n_components: int | None = None) -> Space:
    """train: (game_id). A train game without situations stops the job; projection keeps the train games' components of largest variance."""
    ds.require_no_metadata(ds.COLUMNS)
    situations = materialize(ds.situation_features(s), "situation-features")
    games = materialize(ds.game_features(situations), "game-features")
    lost = train.select("game_id").distinct().join(games.select("game_id"), "game_id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no situations of train game {lost[0][0]!r}")
    fitted = materialize(ds.fit_scaler(games.join(train.select("game_id").distinct(), "game_id", "left_semi")), "scaler")
    packed = lambda df, key: df.select(F.col(key).alias("id"), F.array(*ds.COLUMNS).alias("z"))
    levels = {}
    kept: tuple[int, ...] = ()
    of_level = lambda raw, key, name: lambda: materialize(packed(ds.scale(raw, fitted, key), key), name)
    scaled = dict(zip(("game", "situation"), together(situations.sparkSession, of_level(games, "game_id", "scaled-games"), of_level(situations, "situation_id", "scaled-situations")), strict=True))
    if n_components is not None:
        known = scaled["game"].join(train.select(F.col("game_id").alias("id")).distinct(), "id", "left_semi")
        # scaled columns all vary by 1: what differs by rounding alone is a tie, else the choice would change with the order of summing
        told = geometry.moments(known, "z").withColumn("variance", F.round("variance", 9))
        kept = tuple(r["idx"] for r in geometry.leading_components(told, n_components).collect())
    for level, raw, key in (("game", games, "game_id"), ("situation", situations, "situation_id")):
        levels[level] = {"canonical": packed(raw, key), "normalized": scaled[level]} | ({"projected": keep_components(scaled[level], kept)} if n_components is not None else {})
    return Space(levels["game"], levels["situation"], train.select(F.col("game_id").alias("id")).distinct(), kept)


def novelty_table(space: Space, level: str, ks: Sequence[int], view: str = "normalized", train_ids: DataFrame | None = None, metric: str = "l2") -> DataFrame:
    """(id, k, novelty) of every entity of a level against its training entities."""
    z = space.view(level, view)
    known = materialize(z.join(space.train if train_ids is None else train_ids, "id", "left_semi"), "novelty-train")  # counted, and read in blocks
    return geometry.novelty(z, known, "id", "z", ks, metric)


def novelty_means(novelty: DataFrame) -> DataFrame:
    """(k, mean_novelty, rows)."""
    return novelty.groupBy("k").agg(F.avg("novelty").alias("mean_novelty"), F.count("*").alias("rows"))


def seeded_centers(df: DataFrame, key: str, vector: str, k: int, seed: int) -> list[list[float]]:
    """Starting centres: by stride in key order for seed 0, else the first k keys of the seeded shuffle; what repeats is topped up in key order.

    The shuffle is that of the seeded generator over the number of rows, so only places and the k vectors are on the driver.
    """
    if seed == 0:
        found = geometry.starting_centers(df, key, vector, k)
        return found
    n = df.count()
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return geometry.vectors_at(df, key, vector, order[:k])


def cluster(space: Space, k: int, seed: int = 0, level: str = "game", view: str = "normalized") -> DataFrame:
    """(id, cluster): fitted on the training entities, told for all."""
    z = space.view(level, view)
    known = materialize(z.join(space.train, "id", "left_semi"), "cluster-train") if level == "game" else z
    centers = geometry.kmeans_centers(known, "z", seeded_centers(known, "id", "z", k, seed))
    return geometry.assign(z, "id", "z", centers).select("id", "cluster")


def distances(space: Space, level: str = "game", view: str = "normalized", metric: str = "l2") -> DataFrame:
    """(id_a, id_b, distance) of all pairs, in blocks."""
    z = space.view(level, view)
    return geometry.all_distances(z, "id", "z", metric)


def experiment(s: sit.Situations, train: DataFrame, k: int, ks: Sequence[int], seed: int = 0, n_components: int | None = 5) -> dict[str, DataFrame]:
    """Space, novelty and clusters in one go; clusters are made twice and must agree."""
    space = build_space(s, train, n_components)
    first, again = cluster(space, k, seed), cluster(space, k, seed).withColumnRenamed("cluster", "_again")
    if not first.join(again, "id").where(F.col("cluster") != F.col("_again")).isEmpty():
        raise RuntimeError("clustering is not repeatable")
    novelty = novelty_table(space, "game", ks)
    return {"games": space.view("game"), "situations": space.view("situation"), "novelty": novelty, "novelty_means": novelty_means(novelty), "clusters": first}
