"""Pairs, trajectories and prefixes of situations, their vectors, models and evaluations.

A pair is a transition with actions: the state before, the set of actions, the
state after, and who observed either. Trajectories are chains of pairs; a prefix
is a trajectory up to one step, with the step's end as target, which is never
part of it. Everything is keyed by situation_id and the ids of the situation's
own tables (see situations.Situations); vectors come from the bag encoders.

Models are ridge maps whose normal equations are summed in one pass over the
training rows; weights are literals of the prediction. A missing state, action
set or target stops the job, nothing is imputed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structlens.functions import columns as c
from structlens.operators import linear, relational, sequence
from structlens.operators import situations as sit
from structlens.storage import materialize

#: Scalars observed per pair and per prefix (fixed names).
PAIR_SCALARS = ("information_gain", "information_loss", "information_volume_delta", "available_decision_count_delta")
PREFIX_SCALARS = ("information_volume", "hidden_information", "available_decision_count")
LABELS = ("information_volume", "information_visibility", "hidden_information", "self_knowledge_asymmetry", "available_decision_count")


def pair_id(situation: str = "situation_id", transition: str = "transition_id") -> Column:
    return F.concat_ws("/", situation, F.lit("pair"), transition)


def _distinct_in_order(entries: Column) -> Column:
    """Of (ord, value) entries: the values, each where it comes first."""
    return F.array_distinct(F.transform(F.array_sort(entries), lambda e: e["value"]))


def observers_at(s: sit.Situations, steps: DataFrame, keys: Sequence[str], states: str) -> DataFrame:
    """(keys, observer_ids): distinct observers, in authored order, of any of the states an array column lists."""
    wanted = steps.select(*keys, F.explode(states).alias("state_id"))
    seen = wanted.join(s.observations.select("situation_id", "state_id", "observer_id", "ord"), ["situation_id", "state_id"])
    return seen.groupBy(*keys).agg(_distinct_in_order(F.collect_list(F.struct("ord", F.col("observer_id").alias("value")))).alias("observer_ids"))


def pairs(s: sit.Situations) -> DataFrame:
    """Every transition with actions: (situation_id, game_id, transition_id, ord, pair_id, from_state_id, to_state_id, action_ids, observer_ids, source_id)."""
    acting = s.transitions.where(F.size("action_ids") > 0).withColumn("_states", F.array("from_state_id", "to_state_id"))
    seen = observers_at(s, acting, ["situation_id", "transition_id"], "_states")
    both = acting.join(seen, ["situation_id", "transition_id"], "left").join(s.situations.select("situation_id", "game_id"), "situation_id")
    source = F.sha2(F.concat_ws("|", "from_state_id", F.array_join("action_ids", ","), "to_state_id"), 256)
    return both.select("situation_id", "game_id", "transition_id", "ord", pair_id().alias("pair_id"), "from_state_id", "to_state_id", "action_ids", F.coalesce("observer_ids", F.array().cast("array<string>")).alias("observer_ids"), source.alias("source_id"))


def skipped_pairs(s: sit.Situations) -> DataFrame:
    """(situation_id, transition_id, reason) of the transitions that are no pairs."""
    return s.transitions.where(F.coalesce(F.size("action_ids"), F.lit(0)) <= 0).select("situation_id", "transition_id", F.lit("no actions").alias("reason"))


def aligned_pairs(s: sit.Situations, dim: int = sit.DIM) -> DataFrame:
    """Pairs with z_from, z_action and z_to."""
    states, actions = sit.state_vectors(s, dim), sit.action_sets(s, dim).select("situation_id", "transition_id", F.col("z").alias("z_action"))
    start = states.select("situation_id", F.col("state_id").alias("from_state_id"), F.col("z").alias("z_from"))
    stop = states.select("situation_id", F.col("state_id").alias("to_state_id"), F.col("z").alias("z_to"))
    found = relational.require_all(pairs(s), start, ["situation_id", "from_state_id"], "state")
    found = relational.require_all(found, actions, ["situation_id", "transition_id"], "action set")
    return relational.require_all(found, stop, ["situation_id", "to_state_id"], "target state")


def _at(measures: DataFrame, metric: str, who: str = "observer_id") -> DataFrame:
    """(situation_id, state_id, who, value): a metric per state and observer, the first where several are given."""
    rows = measures.where((F.col("metric") == metric) & F.col("value").isNotNull())
    return rows.groupBy("situation_id", "state_id", F.col("observer_id").alias(who)).agg(F.min_by("value", "scope_key").alias("value"))


def pair_scalars(s: sit.Situations, measures: DataFrame) -> DataFrame:
    """(pair_id, the four PAIR_SCALARS): means over observers and players for whom both sides are there, else null."""
    p = pairs(s)
    moved = measures.where(F.col("metric").isin("information_gain", "information_loss")).groupBy("situation_id", F.col("scope_key").alias("transition_id")).pivot("metric", ["information_gain", "information_loss"]).agg(F.avg("value"))

    def change(metric: str, name: str, of: DataFrame) -> DataFrame:
        at = _at(measures, metric)
        before = at.select("situation_id", F.col("state_id").alias("from_state_id"), "observer_id", F.col("value").alias("_b"))
        after = at.select("situation_id", F.col("state_id").alias("to_state_id"), "observer_id", F.col("value").alias("_a"))
        steps = of.join(before, ["situation_id", "from_state_id", "observer_id"] if "observer_id" in of.columns else ["situation_id", "from_state_id"]).join(after, ["situation_id", "to_state_id", "observer_id"])
        return steps.groupBy("situation_id", "transition_id").agg(F.avg(F.col("_a") - F.col("_b")).alias(name))

    ends = p.select("situation_id", "transition_id", "from_state_id", "to_state_id")
    seen = p.select("situation_id", "transition_id", "from_state_id", "to_state_id", F.explode("observer_ids").alias("observer_id"))
    volume = change("information_volume", "information_volume_delta", seen)
    decisions = change("available_decision_count", "available_decision_count_delta", ends)
    out = p.select("situation_id", "game_id", "transition_id", "pair_id")
    for part in (moved, volume, decisions):
        out = out.join(part, ["situation_id", "transition_id"], "left")
    return out.select("situation_id", "game_id", "transition_id", "pair_id", *PAIR_SCALARS)


def scalar_measurements(measures: DataFrame) -> DataFrame:
    """The measurements that are numbers, in long form."""
    return measures.where(F.col("value").isNotNull()).select("situation_id", "metric", "state_id", "observer_id", "scope_key", "value")


def observation_labels(s: sit.Situations, measures: DataFrame) -> DataFrame:
    """Every observation with the five LABELS as columns; available decisions where its observer has a decision at its state."""
    per_view = measures.where(F.col("metric").isin(*LABELS[:4])).groupBy("situation_id", F.col("scope_key").alias("observation_id")).pivot("metric", list(LABELS[:4])).agg(F.first("value"))
    decisions = _at(measures, LABELS[4]).withColumnRenamed("value", LABELS[4])
    both = s.observations.select("situation_id", "ord", "observation_id", "state_id", "observer_id").join(per_view, ["situation_id", "observation_id"], "left").join(decisions, ["situation_id", "state_id", "observer_id"], "left")
    return both.select("situation_id", "ord", "observation_id", "state_id", "observer_id", *LABELS)


def steps(s: sit.Situations) -> DataFrame:
    """Every step of every trajectory: (situation_id, game_id, trajectory_id, pos, pair_id, transition_id, from, to, action_ids, observer_ids, actor_id, source_id)."""
    p = pairs(s)
    placed = sequence.chains(p, "situation_id", "transition_id", "from_state_id", "to_state_id", "ord").where(F.col("chain").isNotNull()).select("situation_id", "transition_id", "chain", "pos")
    first = F.min_by("transition_id", "pos").over(Window.partitionBy("situation_id", "chain"))
    named = placed.withColumn("trajectory_id", F.concat_ws("/", "situation_id", F.lit("trajectory"), first))
    actor = s.states.select("situation_id", F.col("state_id").alias("from_state_id"), F.col("active_player_id").alias("actor_id"))
    both = named.join(p.drop("source_id"), ["situation_id", "transition_id"]).join(actor, ["situation_id", "from_state_id"], "left")
    text = F.concat_ws("|", "trajectory_id", F.col("pos").cast("string"), "transition_id", "from_state_id", "to_state_id", F.array_join("action_ids", ","))
    return both.select("situation_id", "game_id", "trajectory_id", "pos", "pair_id", "transition_id", "from_state_id", "to_state_id", "action_ids", "observer_ids", "actor_id", F.sha2(text, 256).alias("source_id"))


def skipped_steps(s: sit.Situations) -> DataFrame:
    """(situation_id, transition_id, reason) of the pairs in no trajectory."""
    out = sequence.chains(pairs(s), "situation_id", "transition_id", "from_state_id", "to_state_id", "ord")
    return out.where(F.col("skipped").isNotNull()).select("situation_id", "transition_id", F.col("skipped").alias("reason"))


def trajectories(steps_: DataFrame) -> DataFrame:
    """One row per trajectory: its states, actors, observers in order of appearance, and number of steps."""
    e = F.struct("pos", "from_state_id", "to_state_id", "actor_id", "observer_ids", "pair_id")
    g = steps_.groupBy("situation_id", "game_id", "trajectory_id").agg(F.array_sort(F.collect_list(e)).alias("_s"))
    states = F.concat(F.array(F.get("_s", F.lit(0))["from_state_id"]), F.transform("_s", lambda x: x["to_state_id"]))
    return g.select(
        "situation_id", "game_id", "trajectory_id", F.size("_s").alias("n_steps"), states.alias("state_ids"), F.transform("_s", lambda x: x["actor_id"]).alias("actor_ids"),
        F.array_distinct(F.flatten(F.transform("_s", lambda x: x["observer_ids"]))).alias("observer_ids"), F.transform("_s", lambda x: x["pair_id"]).alias("pair_ids"),
    )


def prefixes(s: sit.Situations, steps_: DataFrame) -> DataFrame:
    """One row per step: states, actions and actors up to it, the observers seen at those states, and its end as target."""
    upto = Window.partitionBy("situation_id", "trajectory_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = steps_.select(
        "situation_id", "game_id", "trajectory_id", "pos", F.concat_ws("/", "trajectory_id", F.lit("prefix"), F.col("pos").cast("string")).alias("prefix_id"), F.col("to_state_id").alias("target_state_id"),
        F.collect_list("from_state_id").over(upto).alias("state_ids"), F.collect_list("action_ids").over(upto).alias("action_groups"), F.collect_list(F.coalesce("actor_id", F.lit(""))).over(upto).alias("actor_ids"), "transition_id",
    )
    seen = observers_at(s, held, ["situation_id", "prefix_id"], "state_ids")
    return held.join(seen, ["situation_id", "prefix_id"], "left").withColumn("observer_ids", F.coalesce("observer_ids", F.array().cast("array<string>")))


def prefix_events(s: sit.Situations, steps_: DataFrame, dim: int = sit.DIM) -> DataFrame:
    """(situation_id, trajectory_id, pos, event): z of a step's first state followed by z of its actions, zeros without actions."""
    states = sit.state_vectors(s, dim).select("situation_id", F.col("state_id").alias("from_state_id"), F.col("z").alias("_s"))
    actions = sit.action_sets(s, dim).select("situation_id", "transition_id", F.col("z").alias("_a"))
    found = relational.require_all(steps_, states, ["situation_id", "from_state_id"], "state").join(actions, ["situation_id", "transition_id"], "left")
    return found.select("situation_id", "trajectory_id", "pos", "transition_id", F.concat("_s", F.coalesce("_a", F.array_repeat(F.lit(0.0), dim))).alias("event"))


def prefix_summaries(s: sit.Situations, steps_: DataFrame, dim: int = sit.DIM) -> DataFrame:
    """(situation_id, prefix_id, summary): first, last, mean and change of the events so far, their number, steps with actions, observers (4 * 2 dim + 3 numbers)."""
    events = prefix_events(s, steps_, dim)
    upto = Window.partitionBy("situation_id", "trajectory_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    means = F.array(*[F.avg(F.get("event", F.lit(i))).over(upto) for i in range(2 * dim)])
    first, n = F.first("event").over(upto), F.count("*").over(upto)
    running = events.select("situation_id", "trajectory_id", "pos", "event", first.alias("_f"), means.alias("_m"), n.alias("_n"))
    held = prefixes(s, steps_).select("situation_id", "trajectory_id", "pos", "prefix_id", F.size(F.filter("action_groups", lambda a: F.size(a) > 0)).alias("_acts"), F.size("observer_ids").alias("_seen"))
    change = F.zip_with("event", "_f", lambda x, y: x - y)
    extras = F.array(*[F.col(x).cast("double") for x in ("_n", "_acts", "_seen")])
    both = running.join(held, ["situation_id", "trajectory_id", "pos"])
    return both.select("situation_id", "trajectory_id", "pos", "prefix_id", F.concat("_f", "event", "_m", change, extras).alias("summary"))


def last_steps(s: sit.Situations, steps_: DataFrame, dim: int = sit.DIM) -> DataFrame:
    """Prefixes aligned for a baseline that sees the last step only: (prefix_id, z_from, z_action, z_to); a step without actions stops the job."""
    a = aligned_pairs(s, dim).select("situation_id", "transition_id", "z_from", "z_action", "z_to")
    named = prefixes(s, steps_).select("situation_id", "game_id", "trajectory_id", "pos", "prefix_id", "transition_id")
    return relational.require_all(named, a, ["situation_id", "transition_id"], "observed action")


def prefix_scalars(prefixes_: DataFrame, measures: DataFrame) -> DataFrame:
    """(prefix_id, the three PREFIX_SCALARS): means over whoever is measured at the target state, else null."""
    at = measures.where(F.col("metric").isin(*PREFIX_SCALARS)).groupBy("situation_id", F.col("state_id").alias("target_state_id")).pivot("metric", list(PREFIX_SCALARS)).agg(F.avg("value"))
    return prefixes_.select("situation_id", "game_id", "prefix_id", "target_state_id").join(at, ["situation_id", "target_state_id"], "left").select("situation_id", "game_id", "prefix_id", *PREFIX_SCALARS)


def features(*vectors: tuple[str, int]) -> list[Column]:
    """The components of vector columns as feature columns."""
    return [F.get(F.col(name), F.lit(i)) for name, dim in vectors for i in range(dim)]


def fit_conditioned(train: DataFrame, dim: int = sit.DIM, penalty: float = linear.RIDGE) -> np.ndarray:
    """Ridge weights (1 + 2 dim, dim) from z_from and z_action to z_to."""
    return linear.fit_ridge(train, features(("z_from", dim), ("z_action", dim)), features(("z_to", dim)), penalty)


def predict_conditioned(df: DataFrame, weights: np.ndarray, state: str = "z_from", action: str = "z_action", name: str = "predicted") -> DataFrame:
    return df.withColumn(name, linear.predict_array(F.concat(state, action), weights))


def vector_mse(predicted: Column, actual: Column) -> Column:
    """Mean squared error of one row over its components."""
    return F.aggregate(F.zip_with(predicted, actual, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x) / F.size(actual)


def zero_change(scalars: DataFrame, names: Sequence[str]) -> DataFrame:
    """The baseline that predicts no change: 0 where a number is there, else null."""
    return scalars.withColumns({n: F.when(F.col(n).isNotNull(), F.lit(0.0)) for n in names})


def probe_scalars(train: DataFrame, test: DataFrame, vector: str, dim: int, names: Sequence[str], penalty: float = linear.RIDGE) -> DataFrame:
    """test with p_<name>: ridge from a vector to each scalar, fitted on the train rows that have it; a scalar never labelled stays null."""
    out = test
    for name in names:
        labelled = train.where(F.col(name).isNotNull())
        if labelled.isEmpty():
            out = out.withColumn(f"p_{name}", F.lit(None).cast("double"))
        else:
            weights = linear.fit_ridge(labelled, features((vector, dim)), [F.col(name)], penalty)
            out = out.withColumn(f"p_{name}", linear.predict(features((vector, dim)), weights)[0])
    return out


def scalar_errors(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    """(scalar, n, dropped, rmse, mae) of p_<name> against <name>."""
    long = scored.select(F.inline(F.array(*[F.struct(F.lit(n).alias("scalar"), F.col(f"p_{n}").alias("p"), F.col(n).alias("y")) for n in names])))
    return linear.errors(long, F.col("p"), F.col("y"), ["scalar"])


def _sides(df: DataFrame, seed: int, percent: int) -> tuple[DataFrame, DataFrame]:
    sided = linear.split_by_hash(df, "game_id", seed, percent)
    train, test = sided.where("side = 'train'").drop("side"), sided.where("side = 'test'").drop("side")
    if train.isEmpty() or test.isEmpty():
        raise ValueError("the split leaves a side without games")
    return train, test


def evaluate_transitions(s: sit.Situations, seed: int = 7, percent: int = 30, dim: int = sit.DIM) -> tuple[DataFrame, DataFrame]:
    """((pairs, conditioned_mse, copy_mse), errors per scalar) on the games held out, by models fitted on the others."""
    scalars = pair_scalars(s, sit.measures(s)).select("pair_id", *PAIR_SCALARS)
    train, test = _sides(materialize(aligned_pairs(s, dim).join(scalars, "pair_id"), "aligned-pairs"), seed, percent)
    weights = fit_conditioned(train, dim)
    known, unknown = predict_conditioned(train, weights), predict_conditioned(test, weights)
    report = unknown.agg(F.count("*").alias("pairs"), F.avg(vector_mse(F.col("predicted"), F.col("z_to"))).alias("conditioned_mse"), F.avg(vector_mse(F.col("z_from"), F.col("z_to"))).alias("copy_mse"))
    return report, scalar_errors(probe_scalars(known, unknown, "predicted", dim, PAIR_SCALARS), PAIR_SCALARS)


def evaluate_sequences(s: sit.Situations, seed: int = 7, percent: int = 30, dim: int = sit.DIM) -> tuple[DataFrame, DataFrame]:
    """((prefixes, sequence_mse, last_state_mse, transition_mse), errors per scalar) on the games held out."""
    walked = materialize(steps(s), "steps")
    summaries = prefix_summaries(s, walked, dim).select("prefix_id", "summary")
    scalars = prefix_scalars(prefixes(s, walked), sit.measures(s)).select("prefix_id", *PREFIX_SCALARS)
    train, test = _sides(materialize(last_steps(s, walked, dim).join(summaries, "prefix_id").join(scalars, "prefix_id"), "aligned-prefixes"), seed, percent)
    width = 8 * dim + 3
    by_prefix = linear.fit_ridge(train, features(("summary", width)), features(("z_to", dim)))
    by_step = fit_conditioned(train, dim)

    def scored(df: DataFrame) -> DataFrame:
        return predict_conditioned(df, by_step, name="by_step").withColumn("by_prefix", linear.predict_array(F.col("summary"), by_prefix))

    unknown = scored(test)
    mse = lambda name: F.avg(vector_mse(F.col(name), F.col("z_to")))
    report = unknown.agg(F.count("*").alias("prefixes"), mse("by_prefix").alias("sequence_mse"), mse("z_from").alias("last_state_mse"), mse("by_step").alias("transition_mse"))
    return report, scalar_errors(probe_scalars(scored(train), unknown, "by_prefix", dim, PREFIX_SCALARS), PREFIX_SCALARS)


def rollout(s: sit.Situations, steps_: DataFrame, weights: np.ndarray, most: int, dim: int = sit.DIM) -> DataFrame:
    """(situation_id, trajectory_id, pos, z): from a trajectory's first state, what the model makes of the observed actions one after the other, for at most `most` steps."""
    a = aligned_pairs(s, dim).select("situation_id", "transition_id", "z_from", "z_action")
    taken = relational.require_all(sequence.bounded(steps_, "pos", most), a, ["situation_id", "transition_id"], "action set")
    g = taken.groupBy("situation_id", "trajectory_id").agg(F.min_by("z_from", "pos").alias("z0"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "z_action"))), lambda x: x["z_action"]).alias("acts"))
    path = F.aggregate("acts", F.array("z0"), lambda zs, action: F.array_append(zs, linear.predict_array(F.concat(F.element_at(zs, -1), action), weights)))
    return g.select("situation_id", "trajectory_id", F.posexplode(path).alias("pos", "z"))


#: Operations of interventions (fixed names).
OPERATIONS = ("identity", "hide_information", "reveal_information", "change_observer", "substitute_action")


def intervention(operation: str, **fields: Column) -> Column:
    """A struct of an intervention's fields with intervention_id, the digest of the operation and the fields that are given, in order of name."""
    if operation not in OPERATIONS:
        raise ValueError(f"no operation {operation!r}")
    needed = {"hide_information": {"item_id"}, "reveal_information": {"item_id"}, "change_observer": {"target_observer_id"}, "substitute_action": {"factual_action_ids", "alternative_action_ids"}}.get(operation, set())
    if missing := needed - set(fields):
        raise ValueError(f"{operation} needs {', '.join(sorted(missing))}")
    body = F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]))
    digest = F.sha2(F.concat_ws("|", F.lit(operation), body), 256)
    return F.struct(F.concat(F.lit("iv/"), digest).alias("intervention_id"), F.lit(operation).alias("operation"), *[fields[n].alias(n) for n in sorted(fields)])


def counterfactual_id(source: Column, intervention_: Column) -> Column:
    """The id of what an intervention makes of an entity: source/cf/operation/first 16 digits."""
    return F.concat_ws("/", source, F.lit("cf"), intervention_["operation"], F.substr(F.substring_index(intervention_["intervention_id"], "/", -1), F.lit(1), F.lit(16)))


def alternatives(s: sit.Situations) -> DataFrame:
    """Pairs with an alternative action set: of several actions the first alone, else the first other action authored; pairs without one are left out."""
    first = relational.first_by(s.actions.select("situation_id", "action_id", "ord"), ["situation_id"], ["ord"]).select("situation_id", F.col("action_id").alias("_first"), F.col("ord").alias("_o"))
    later = s.actions.select("situation_id", "action_id", "ord").join(first, "situation_id").where(F.col("ord") > F.col("_o"))
    second = relational.first_by(later.select("situation_id", "action_id", "ord"), ["situation_id"], ["ord"]).select("situation_id", F.col("action_id").alias("_second"))
    p = pairs(s).join(first.drop("_o"), "situation_id", "left").join(second, "situation_id", "left")
    one = F.get("action_ids", F.lit(0))
    other = F.when(F.col("_first") != one, F.col("_first")).otherwise(F.col("_second"))
    alternative = F.when(F.size("action_ids") > 1, F.array(one)).when(other.isNotNull(), F.array(other))
    return p.withColumn("alternative_action_ids", alternative).where(F.col("alternative_action_ids").isNotNull()).drop("_first", "_second")


def counterfactual_transitions(s: sit.Situations, weights: np.ndarray, dim: int = sit.DIM) -> DataFrame:
    """Pairs with an alternative: what the model predicts under the observed and the alternative actions, and the difference."""
    a = alternatives(s)
    asked = a.select("situation_id", F.col("pair_id").alias("transition_id"), F.col("alternative_action_ids").alias("action_ids"))
    z_other = sit.encoded_action_sets(s, asked, dim).select("situation_id", F.col("transition_id").alias("pair_id"), F.col("z").alias("z_other"))
    known = aligned_pairs(s, dim).select("pair_id", "z_from", "z_action")
    both = relational.require_all(relational.require_all(a, z_other, ["situation_id", "pair_id"], "alternative action set"), known, ["pair_id"], "state")
    told = intervention("substitute_action", game_id=F.col("game_id"), situation_id=F.col("situation_id"), source_state_id=F.col("from_state_id"), factual_action_ids=F.col("action_ids"), alternative_action_ids=F.col("alternative_action_ids"))
    out = predict_conditioned(predict_conditioned(both, weights, name="factual"), weights, action="z_other", name="counterfactual").withColumn("_iv", told)
    query = F.concat_ws("/", "pair_id", F.lit("cf"), F.substr(F.substring_index("_iv.intervention_id", "/", -1), F.lit(1), F.lit(16)))
    return out.select("situation_id", "pair_id", query.alias("query_id"), "action_ids", "alternative_action_ids", "factual", "counterfactual", F.zip_with("counterfactual", "factual", lambda x, y: x - y).alias("delta"))


def apply_to_views(s: sit.Situations, wanted: DataFrame) -> DataFrame:
    """Views after interventions.

    wanted: (situation_id, state_id, observer_id, operation, item_id,
    target_observer_id). An unknown view, an item not in the view or a target
    observer without a view at the state stops the job.
    """
    seen = sit.views(s).select("situation_id", "state_id", "observer_id", "observation_id", "items").dropDuplicates(["situation_id", "state_id", "observer_id"])
    at = relational.require_all(wanted, seen, ["situation_id", "state_id", "observer_id"], "view")
    target = seen.select("situation_id", "state_id", F.col("observer_id").alias("target_observer_id"), F.col("items").alias("_theirs"))
    at = at.join(target, ["situation_id", "state_id", "target_observer_id"], "left")
    there = F.exists("items", lambda i: i["item_id"] == F.col("item_id"))
    stop = lambda text, x: F.raise_error(F.concat(F.lit(text), F.coalesce(x, F.lit("null")))).cast("boolean")
    changes = F.col("operation").isin("hide_information", "reveal_information")
    guard = F.when(changes & ~F.coalesce(there, F.lit(False)), stop("missing item: ", F.col("item_id"))).when((F.col("operation") == "change_observer") & F.col("_theirs").isNull(), stop("missing observer: ", F.col("target_observer_id")))
    guard = guard.when(~F.col("operation").isin(*OPERATIONS[:4]), stop("not applicable to a view: ", F.col("operation"))).otherwise(F.lit(True))
    after = F.when(F.col("operation") == "hide_information", sit.intervene(F.col("items"), F.col("item_id"), "hide")).when(F.col("operation") == "reveal_information", sit.intervene(F.col("items"), F.col("item_id"), "reveal"))
    return at.where(guard).withColumn("items_after", after.when(F.col("operation") == "change_observer", F.col("_theirs")).otherwise(F.col("items"))).drop("_theirs")


def scalar_deltas(applied: DataFrame) -> DataFrame:
    """Volume, visibility and hidden items after less before."""
    def figures(x: str) -> tuple[Column, Column, Column]:
        items = F.col(x)
        return F.size(items), sit.visibility(items), F.size(items) - F.size(sit.known(items))

    pairs_ = zip(("volume_delta", "visibility_delta", "hidden_delta"), figures("items_after"), figures("items"), strict=True)
    return applied.select("situation_id", "state_id", "observer_id", "operation", "item_id", *[(a - b).cast("double").alias(n) for n, a, b in pairs_])


def intervened_about(s: sit.Situations, wanted: DataFrame, dim: int = sit.DIM) -> DataFrame:
    """A about B before and after an intervention on B's view, and the difference of the two vectors.

    wanted as in apply_to_views, observer_id being B, with focal_id, A.
    """
    applied = apply_to_views(s, wanted)
    seen = sit.view_vectors(s, dim).select("situation_id", "state_id", "observer_id", "items", "z").dropDuplicates(["situation_id", "state_id", "observer_id"])
    focal = seen.select("situation_id", "state_id", F.col("observer_id").alias("focal_id"), F.col("items").alias("_focal"), F.col("z").alias("z_focal"))
    own = seen.select("situation_id", "state_id", "observer_id", F.col("z").alias("z_before"))
    both = relational.require_all(applied, focal, ["situation_id", "state_id", "focal_id"], "observer").join(own, ["situation_id", "state_id", "observer_id"])
    both = both.withColumn("z_after", F.when(F.col("operation") == "identity", F.col("z_before")).otherwise(sit.view_vector(F.col("items_after"), dim)))
    vector = lambda items, z: sit.about_vector(F.col("_focal"), F.col(items), F.col("z_focal"), F.col(z))
    out = both.withColumn("before", vector("items", "z_before")).withColumn("after", vector("items_after", "z_after"))
    return out.select("situation_id", "state_id", "focal_id", "observer_id", "operation", "before", "after", F.zip_with("after", "before", lambda x, y: x - y).alias("delta"))


def require_observers(s: sit.Situations, wanted: DataFrame) -> DataFrame:
    """wanted (situation_id, state_id, observer_id) as it is; an observer without a view at the state stops the job."""
    return relational.require_all(wanted, s.observations.select("situation_id", "state_id", "observer_id").distinct(), ["situation_id", "state_id", "observer_id"], "observer")


def compose_paths(s: sit.Situations, paths: DataFrame, dim: int = sit.DIM, allow_cycles: bool = False) -> DataFrame:
    """(path_id, situation_id, state_id, vector): the view vectors along each path of observers, then last less first.

    paths: (path_id, situation_id, state_id, observers ARRAY). An observer that
    is missing, or comes twice unless cycles are allowed, stops the job.
    """
    twice = F.size(F.array_distinct("observers")) < F.size("observers")
    checked = paths if allow_cycles else paths.where(F.when(twice, F.raise_error(F.concat(F.lit("cycle in path "), F.col("path_id").cast("string"))).cast("boolean")).otherwise(F.lit(True)))
    long = checked.select("path_id", "situation_id", "state_id", F.posexplode("observers").alias("pos", "observer_id"))
    z = sit.view_vectors(s, dim).select("situation_id", "state_id", "observer_id", "z").dropDuplicates(["situation_id", "state_id", "observer_id"])
    found = relational.require_all(long, z, ["situation_id", "state_id", "observer_id"], "observer")
    g = found.groupBy("path_id", "situation_id", "state_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "z"))), lambda x: x["z"]).alias("_z"))
    return g.select("path_id", "situation_id", "state_id", F.concat(F.flatten("_z"), F.zip_with(F.element_at("_z", -1), F.element_at("_z", 1), lambda x, y: x - y)).alias("vector"))


def mean_pair_distances(s: sit.Situations, dim: int = sit.DIM) -> DataFrame:
    """(situation_id, state_id, pairs, distance): mean cosine distance over the pairs of views of each state with two or more; views have a place of their own."""
    state = ["situation_id", "state_id"]
    z = sit.seen(s).where("placed > 0").select(*state, sit.view_vector(F.col("items"), dim).alias("z"), "placed")
    sums = sit.cosine_sums(z, state, "z", "placed", dim).withColumn("pairs", F.expr("rows * (rows - 1) div 2"))
    return sums.where("pairs > 0").select(*state, "pairs", (F.col("distance") / F.col("pairs")).alias("distance"))


def distance_against_asymmetry(s: sit.Situations, dim: int = sit.DIM) -> DataFrame:
    """(situation_id, state_id, a, b, distance, asymmetry): vector distance and Jaccard distance of what is known, per pair of views."""
    p, col = sit.view_pairs(s, sit.key_text(), dim), F.col
    distance = F.coalesce(1.0 - F.try_divide("product", col("norm_a") * col("norm_b")), F.lit(0.0))
    united = col("n_a") + col("n_b") - col("both")
    return p.select("situation_id", "state_id", col("observer_id_a").alias("a"), col("observer_id_b").alias("b"), distance.alias("distance"), F.when(united == 0, 0.0).otherwise(1.0 - col("both") / united.cast("double")).alias("asymmetry"))
