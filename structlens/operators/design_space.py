"""The 42-column feature space of situations and games: seven families, each a present flag and its columns.

No catalog column may enter it: what is known about a game from outside is
joined afterwards, never measured with.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structlens.functions import columns as c
from structlens.operators import catalog, geometry, sequence
from structlens.operators import situations as sit
from structlens.storage import materialize, together

#: Families and their columns, in order (fixed values).
FAMILIES: dict[str, tuple[str, ...]] = {
    "state": ("n_states", "n_phases", "n_active_players", "centroid_norm", "dispersion"),
    "perspective": ("n_observations", "n_observers", "mean_volume", "mean_visibility", "mean_hidden", "n_asymmetry_pairs", "mean_asymmetry", "dispersion"),
    "action": ("n_actions", "n_action_types", "n_transitions", "n_actors", "n_decision_spaces", "n_decision_options", "dispersion"),
    "sequence": ("n_trajectories", "mean_steps", "max_steps"),
    "intervention": ("n_items", "mean_hide_visibility_delta", "mean_reveal_visibility_delta"),
    "higher_order": ("n_pairs", "mean_distance", "mean_only_focal", "mean_only_target", "mean_shared", "n_asymmetric"),
    "region": ("n_units", "dispersion", "range"),
}
COLUMNS = tuple(f"{family}__{name}" for family, names in FAMILIES.items() for name in ("present", *names))
VALUES = tuple(x for x in COLUMNS if not x.endswith("__present"))


def require_no_metadata(columns: Sequence[str]) -> None:
    """Raise if a catalog column is among the features."""
    bad = sorted({x for x in columns if x in catalog.FIELDS or x.split("__")[-1] in catalog.FIELDS})
    if bad:
        raise ValueError(f"catalog columns among the features: {', '.join(bad)}")


def _spread(vectors: DataFrame, z: str = "z", n: str | None = None, dim: int = sit.DIM) -> DataFrame:
    """(situation_id, norm, dispersion): centroid norm and mean distance to it, 0 for fewer than two vectors; n rows to each, 1 if not told.

    vectors are read twice: for the sums, and for the distances.
    """
    rows = vectors.where(F.col(z).isNotNull()).select("situation_id", F.col(z).alias("_z"), (F.lit(1) if n is None else F.col(n)).alias("_n"))
    sums = rows.groupBy("situation_id").agg(F.sum("_n").alias("_m"), *[F.expr(f"sum(get(_z, {i}) * _n)").alias(f"_s{i}") for i in range(dim)])
    centers = sums.select("situation_id", "_m", F.expr(f"array({', '.join(f'_s{i} / _m' for i in range(dim))})").alias("center"))
    squares = " + ".join(f"(get(_z, {i}) - get(center, {i})) * (get(_z, {i}) - get(center, {i}))" for i in range(dim))
    gaps = rows.join(centers.select("situation_id", "center"), "situation_id").groupBy("situation_id").agg(F.expr(f"sum(sqrt({squares}) * _n)").alias("_gaps"))
    return centers.join(gaps, "situation_id").select("situation_id", F.sqrt(c.dot(F.col("center"), F.col("center"))).alias("norm"), F.when(F.col("_m") > 1, F.col("_gaps") / F.col("_m")).otherwise(0.0).alias("dispersion"))


def _block(df: DataFrame, family: str, values: dict[str, Column]) -> DataFrame:
    return df.select("situation_id", F.lit(1.0).alias(f"{family}__present"), *[values[n].cast("double").alias(f"{family}__{n}") for n in FAMILIES[family]])


def _options_of_spaces(s: sit.Situations) -> DataFrame:
    """(situation_id, nd, no): decision spaces and their options, a space listed twice counting twice; one shuffle of both, counted before it."""
    col = F.col
    either = s.decision_spaces.select("situation_id", "space_id", F.lit(1).alias("d"), F.lit(0).alias("o")).unionAll(s.decision_options.select("situation_id", "space_id", F.lit(0), F.lit(1)))
    met = either.groupBy("situation_id", "space_id").agg(F.sum("d").alias("d"), F.sum("o").alias("o")).where(col("d") > 0)
    return met.groupBy("situation_id").agg(F.sum("d").alias("nd"), F.sum(F.when(col("space_id").isNotNull(), col("d") * col("o")).otherwise(0)).alias("no"))


def _state_block(s: sit.Situations) -> DataFrame:
    col = F.col
    some = lambda x: F.nullif(col(x), F.lit(""))
    vectors = materialize(sit.state_vectors(s), "state-vectors")
    states = s.states.groupBy("situation_id").agg(F.count("*").alias("n"), F.count_distinct(some("phase")).alias("p"), F.count_distinct(some("active_player_id")).alias("a")).join(_spread(vectors), "situation_id")
    return _block(states, "state", {"n_states": col("n"), "n_phases": col("p"), "n_active_players": col("a"), "centroid_norm": col("norm"), "dispersion": col("dispersion")})


def _gaps(states: DataFrame, centers: DataFrame, dim: int = sit.DIM) -> DataFrame:
    """(situation_id, gaps): summed distances of the views of sit.state_sums to their situation's center."""
    kind = states.schema["situation_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.diff(batch.column("times").offsets.to_numpy())
            z, center = (batch.column(x).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for x in ("z", "center"))
            gaps = np.sqrt(((z - np.repeat(center, n, axis=0)) ** 2).sum(1)) * batch.column("times").flatten().to_numpy()  # NaN beside a null
            of, told = np.repeat(np.arange(len(n)), n), ~np.isnan(gaps)
            sums, none = np.bincount(of[told], gaps[told], len(n)), np.bincount(of[told], minlength=len(n)) == 0
            yield pa.RecordBatch.from_arrays([batch.column("situation_id"), pa.array(sums, mask=none)], names=["situation_id", "gaps"])

    placed = states.join(centers, "situation_id").select("situation_id", "center", "times", "z")
    return placed.mapInArrow(measure, f"situation_id {kind}, gaps double").groupBy("situation_id").agg(F.sum("gaps").alias("gaps"))


def _view_blocks(states: DataFrame) -> list[DataFrame]:
    """Of perspectives, of interventions and of views about each other, from the rows of sit.state_sums. They are read several times: write them first (materialize)."""
    col = F.col
    names = [x for x in states.columns if x not in ("situation_id", "total", "observers", "times", "z")]
    sums = states.groupBy("situation_id").agg(*[F.sum(x).alias(x) for x in names], *[F.expr(f"sum(get(total, {i}))").alias(f"_t{i}") for i in range(sit.DIM)])
    center = F.array(*[col(f"_t{i}") / col("copies") for i in range(sit.DIM)])
    sums = materialize(sums.select("situation_id", *names, center.alias("center")), "view-sums")
    observers = states.select("situation_id", F.explode("observers").alias("o")).distinct().groupBy("situation_id").agg(F.count("o").alias("o"))
    v = sums.join(observers, "situation_id").join(_gaps(states, sums.select("situation_id", "center")), "situation_id", "left")
    v = materialize(v, "perspectives")
    mean = lambda x, total="copies": col(x) / col(total)
    only = mean("only", "pairs")
    return [
        _block(v, "perspective", {"n_observations": col("copies"), "n_observers": col("o"), "mean_volume": mean("volume"), "mean_visibility": mean("visible"), "mean_hidden": mean("hidden"), "n_asymmetry_pairs": col("set_pairs"), "mean_asymmetry": F.try_divide("set_distance", "set_pairs"), "dispersion": F.when(col("copies") > 1, mean("gaps")).otherwise(0.0)}),
        _block(v.where("changed > 0"), "intervention", {"n_items": col("changed"), "mean_hide_visibility_delta": mean("hide", "changed"), "mean_reveal_visibility_delta": mean("reveal", "changed")}),
        _block(v.where("pairs > 0"), "higher_order", {"n_pairs": col("pairs"), "mean_distance": mean("distance", "pairs"), "mean_only_focal": only, "mean_only_target": only, "mean_shared": mean("shared", "pairs"), "n_asymmetric": col("uneven")}),
    ]


def _action_block(s: sit.Situations) -> DataFrame:
    col = F.col
    acts = s.actions.groupBy("situation_id").agg(F.count("*").alias("na"), F.count_distinct("action_type").alias("nt"), F.count_distinct(F.nullif(col("player_id"), F.lit(""))).alias("nw"))
    moves = s.transitions.groupBy("situation_id").agg(F.count("*").alias("nm"))
    spread = _spread(materialize(sit.action_sets(s), "action-sets")).select("situation_id", "dispersion")
    action = acts.join(moves, "situation_id", "full").join(_options_of_spaces(s), "situation_id", "full").join(spread, "situation_id", "left").fillna(0)  # each is worked out once
    return _block(action, "action", {"n_actions": col("na"), "n_action_types": col("nt"), "n_transitions": col("nm"), "n_actors": col("nw"), "n_decision_spaces": col("nd"), "n_decision_options": col("no"), "dispersion": col("dispersion")})


def _sequence_block(s: sit.Situations) -> DataFrame:
    col = F.col
    actionable = s.transitions.where(F.size("action_ids") > 0)
    chains = sequence.chains(actionable, "situation_id", "transition_id", "from_state_id", "to_state_id", "ord").where(col("chain").isNotNull())
    lengths = chains.groupBy("situation_id", "chain").agg(F.count("*").alias("steps")).groupBy("situation_id").agg(F.count("*").alias("n"), F.avg("steps").alias("m"), F.max("steps").alias("x"))
    return _block(lengths, "sequence", {"n_trajectories": col("n"), "mean_steps": col("m"), "max_steps": col("x")})


def situation_features(s: sit.Situations) -> DataFrame:
    """(situation_id, game_id, 42 columns), absent families flagged 0 and padded with 0.

    Families are worked out side by side and written, a row per situation; the
    views are summed up once for all that is told of them.
    """
    spark = s.situations.sparkSession
    kept = lambda block: materialize(block, "family")

    def of_views() -> list[DataFrame]:
        return _view_blocks(materialize(sit.state_sums(s), "state-sums"))

    parts = together(spark, of_views, lambda: kept(_action_block(s)), lambda: kept(_state_block(s)), lambda: kept(_sequence_block(s)))
    out = s.situations.select("situation_id", "game_id")
    for block in [*parts[0], *parts[1:], _block(out, "region", {"n_units": F.lit(1), "dispersion": F.lit(0), "range": F.lit(0)})]:
        out = out.join(block, "situation_id", "left")
    return out.select("situation_id", "game_id", *[F.expr(f"coalesce({x}, 0D) AS {x}") for x in COLUMNS])


def game_features(situations: DataFrame) -> DataFrame:
    """(game_id, 42 columns): means over the situations in which a family is present, and the region of their whole vectors.

    The situations are read several times: write them first (materialize).
    """
    means = []
    for family, names in FAMILIES.items():
        if family != "region":
            means += [F.expr(f"max({family}__present)").alias(f"{family}__present"), *[F.expr(f"coalesce(avg(CASE WHEN {family}__present = 1 THEN {family}__{n} END), 0D)").alias(f"{family}__{n}") for n in names]]
    whole = situations.select("game_id", "situation_id", F.array(*COLUMNS).alias("z"))
    centers = geometry.centroids(whole, "game_id", "z")
    spread = whole.join(centers, "game_id").groupBy("game_id").agg(F.when(F.count("*") > 1, F.avg(c.l2(F.col("z"), F.col("centroid")))).otherwise(0.0).alias("region__dispersion"))
    far = geometry.widest(whole, "game_id", "situation_id", "z").withColumnRenamed("widest", "region__range")
    units = situations.groupBy("game_id").agg(*means, F.lit(1.0).alias("region__present"), F.count("*").cast("double").alias("region__n_units"))
    return units.join(spread, "game_id").join(far, "game_id", "left").selectExpr("game_id", *[f"coalesce({x}, 0D) AS {x}" for x in COLUMNS])


def fit_scaler(train: DataFrame) -> DataFrame:
    """One row (fit): population means m and deviations s of the value columns in their order, padded zeros included; deviation 1 without variance."""
    long = train.select(F.posexplode(F.array(*VALUES)).alias("idx", "x")).groupBy("idx").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return long.groupBy().agg(F.array_sort(F.collect_list(F.expr("struct(idx, m, CASE WHEN s > 0 THEN s ELSE 1D END AS s)"))).alias("fit"))


def scale(df: DataFrame, fitted: DataFrame, key: str) -> DataFrame:
    """Value columns scaled, those of absent families back to 0; flags as they are."""
    def scaled(x: str) -> str:
        if x.endswith("__present"):
            return x
        of = f"get(fit, {VALUES.index(x)})"
        return f"CASE WHEN {x.split('__')[0]}__present = 1 THEN ({x} - {of}.m) / {of}.s ELSE 0D END AS {x}"

    return df.crossJoin(F.broadcast(fitted)).selectExpr(key, *[scaled(x) for x in COLUMNS])  # fitted is one row
