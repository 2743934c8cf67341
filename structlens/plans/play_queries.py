"""Situations derived from the events table, and every operator on situations run over them.

A day is a situation, ten minutes with events a state, a user in it an observer
with one view, its events the items, options and actions. Transitions lead from
a state to the next; some states have a second one that leads back, so that
chains fork. What is known, legal, held or named follows from ids and types by
fixed rules, so that SQL can tell the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structlens.functions import columns as c
from structlens.operators import design_geometry, design_space, examples, linear
from structlens.operators import situations as sit
from structlens.sources.tables import table
from structlens.storage import materialize, together

r6 = c.rounded


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    bucket = F.floor((F.hour("ts") * 60 + F.minute("ts")) / 10).cast("int")
    e = e.withColumn("situation_id", F.date_format("ts", "yyyy-MM-dd")).withColumn("b", bucket).withColumn("observer_id", F.col("user_id").cast("string"))
    e = e.withColumn("state_id", F.concat("situation_id", F.lit("T"), F.lpad(F.col("b").cast("string"), 3, "0")))
    action = F.concat(F.when(F.col("event_type") == "click", "give").when(F.col("event_type") == "view", "guess").otherwise("take"), F.lit("_"), F.col("event_type"))
    return e.withColumn("observation_id", F.concat_ws("/", "state_id", "observer_id")).withColumn("action_type", action)


def star(spark: SparkSession, sf: str, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> sit.Situations:
    """keep: what becomes of the aggregates of events that several tables derive from; as they are if not told."""
    e = _events(spark, sf)
    kind, nth = F.col("event_type"), F.col("event_id")
    day = F.substr("situation_id", F.lit(9), F.lit(2)).cast("int")
    situations = e.groupBy("situation_id").agg(F.array_sort(F.collect_set("action_type")).alias("legal_action_types")).select(
        "situation_id", F.concat(F.lit("g"), (day % 7).cast("string")).alias("game_id"), F.when(day % 2 == 0, "direct").otherwise("none").alias("interaction"),
        F.when(day % 3 == 0, "simultaneous").otherwise("sequential").alias("decision_timing"), "legal_action_types",
    )
    first = F.struct("ts", "event_id")
    states = e.groupBy("situation_id", "state_id", "b").agg(F.min_by(F.struct("observer_id", "event_type", "props"), first).alias("_f"), F.sort_array(F.collect_list(F.when(nth % 2 == 0, nth))).alias("_acts"))
    states = states.select(
        "situation_id", F.col("b").cast("bigint").alias("ord"), "state_id", F.when(F.col("b") % 7 != 0, F.col("b")).alias("turn_number"), F.when(F.col("_f.event_type") != "error", F.col("_f.observer_id")).alias("active_player_id"),
        F.when(F.col("b") < 72, "early").when(F.col("b") % 5 != 0, "late").alias("phase"), F.col("_f.props").alias("data"), F.transform("_acts", lambda x: F.concat(F.lit("a"), x.cast("string"))).alias("_acts"),
    )
    views = e.select("situation_id", "state_id", "observation_id", "observer_id", "user_id", "b").distinct()
    situations, states, views = together(spark, lambda: keep(situations, "play-situations"), lambda: keep(states, "play-states"), lambda: keep(views, "play-views"))
    place = (F.col("b").cast("bigint") * 100000 + F.col("user_id")).alias("ord")
    observations = views.select("situation_id", place, "observation_id", "state_id", "observer_id", F.col("observation_id").alias("information_space_id"))
    seen_as = F.when(kind == "error", "unknown_to_self").when(kind == "signup", "private").when(kind == "view", "public").when(kind == "click", "other_private").otherwise("hidden")
    holder = F.when(nth % 4 == 0, F.lit(None)).when(nth % 4 == 2, (F.col("user_id") + 1).cast("string")).otherwise(F.col("observer_id"))
    known_to = F.when(nth % 3 > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), nth % 3), lambda x: x.cast("string")))
    items = e.select("situation_id", F.col("observation_id").alias("information_space_id"), nth.alias("ord"), kind.alias("item_id"), seen_as.alias("visibility"), kind.alias("about"), known_to.alias("known_to"), F.col("props").alias("payload"), (~kind.isin("error", "purchase")).alias("content_known"), holder.alias("holder_id"))
    spaces = views.select("situation_id", place, F.col("observation_id").alias("space_id"), F.col("observer_id").alias("player_id"), F.when(F.col("user_id") % 5 != 0, F.col("state_id")).alias("state_id"), (F.col("user_id") % 3 != 0).alias("complete"))
    options = e.select("situation_id", F.col("observation_id").alias("space_id"), nth.alias("ord"), (kind != "error").alias("legal"), (F.col("value") > 20).alias("available"))
    actions = e.select("situation_id", nth.alias("ord"), F.concat(F.lit("a"), nth.cast("string")).alias("action_id"), F.col("observer_id").alias("player_id"), "action_type", F.col("props").alias("parameters"))
    w = Window.partitionBy("situation_id").orderBy("ord")
    chain = states.select("situation_id", "ord", "state_id", "_acts", F.lead("state_id").over(w).alias("_next"), F.lag("state_id").over(w).alias("_before"))
    number = F.lpad(F.col("ord").cast("string"), 3, "0")
    on = chain.where(F.col("_next").isNotNull()).select("situation_id", "ord", F.concat(F.lit("t"), number).alias("transition_id"), F.col("state_id").alias("from_state_id"), F.col("_next").alias("to_state_id"), F.col("_acts").alias("action_ids"))
    back = chain.where(F.col("_before").isNotNull() & (F.col("ord") % 11 == 0)).select("situation_id", (F.col("ord") + 1000).alias("ord"), F.concat(F.lit("r"), number).alias("transition_id"), F.col("state_id").alias("from_state_id"), F.col("_before").alias("to_state_id"), F.col("_acts").alias("action_ids"))
    interpretations = e.where(nth % 100 == 0).select("situation_id", kind.alias("label"))
    return sit.Situations(situations, states.drop("_acts"), observations, items, spaces, options, actions, on.unionByName(back), interpretations)


def _stored(spark: SparkSession, sf: str) -> sit.Situations:
    """The star written once, for queries that use its tables many times."""
    s = star(spark, sf)
    return sit.Situations(**{name: materialize(getattr(s, name), f"play-{name}") for name in s.__dataclass_fields__})


def _shared(spark: SparkSession, sf: str) -> sit.Situations:
    """The star with only its aggregates of events written, for queries that use each table once or twice; the others are plain columns of events."""
    return star(spark, sf, materialize)


def pair_star(spark: SparkSession, sf: str) -> sit.Situations:
    """The star for lists of pairs: items tell the state of their view, and a view comes once for each of its events, so that both are shuffled once."""
    s = star(spark, sf)
    place = (F.col("b").cast("bigint") * 100000 + F.col("user_id")).alias("ord")
    observations = _events(spark, sf).select("situation_id", place, "observation_id", "state_id", "observer_id", F.col("observation_id").alias("information_space_id"))
    return replace(s, observations=observations, info_items=s.info_items.withColumn("state_id", F.substring_index("information_space_id", "/", 1)))


def play_measures(spark: SparkSession, sf: str) -> DataFrame:
    """The metrics that are numbers, of every situation, state, view, transition and decision."""
    s = star(spark, sf)
    m = examples.scalar_measurements(sit.measures(s, v=materialize(sit.views(s), "views")))
    return m.withColumn("value", r6(F.col("value")))


def play_ownership(spark: SparkSession, sf: str) -> DataFrame:
    """Per state: how many items each holder has, and how many know each subject (last written)."""
    m = sit.measures(star(spark, sf)).where("metric = 'information_ownership'")
    body = F.from_json("value_json", "by_holder map<string,bigint>, n_holders int, known_to_sizes map<string,bigint>")
    kinds = lambda name, kind: F.transform(F.map_entries(F.col(f"v.{name}")), lambda x: F.struct(F.lit(kind).alias("kind"), x["key"].alias("of"), x["value"].alias("n")))
    return m.select("state_id", body.alias("v")).select("state_id", F.col("v.n_holders").alias("holders"), F.inline(F.concat(kinds("by_holder", "held by"), kinds("known_to_sizes", "known of"))))


def play_interaction(spark: SparkSession, sf: str) -> DataFrame:
    m = sit.measures(star(spark, sf)).where("metric = 'structural_interaction'")
    v = F.from_json("value_json", "interaction string, decision_timing string, targeting_action_types array<string>, labels array<string>")
    return m.select("situation_id", v.alias("v")).select("situation_id", "v.interaction", "v.decision_timing", F.array_join("v.targeting_action_types", ",").alias("targeting"), F.array_join("v.labels", ",").alias("labels"))


def _long(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("idx", "x")).withColumn("x", r6(F.col("x")))


def play_state_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _long(sit.state_vectors(star(spark, sf)), "z", "state_id")


def play_view_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _long(sit.view_vectors(star(spark, sf)), "z", "observation_id")


def play_action_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _long(sit.action_sets(star(spark, sf)), "z", "situation_id", "transition_id")


def play_about(spark: SparkSession, sf: str) -> DataFrame:
    """What one observer's view has over another's, both ways round, at every state."""
    p = sit.about_figures(pair_star(spark, sf))
    width = F.lit(3 * sit.DIM + 5)  # of about's vector
    return p.select("state_id", "observer_id_a", "observer_id_b", "only_a", "only_b", "shared", "hidden_both", r6(F.col("distance")).alias("distance"), width.alias("width"))


def play_asymmetric_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return sit.asymmetric_counts(sit.seen(star(spark, sf)))


def play_mean_distances(spark: SparkSession, sf: str) -> DataFrame:
    return examples.mean_pair_distances(star(spark, sf)).withColumn("distance", r6(F.col("distance")))


def play_distance_asymmetry(spark: SparkSession, sf: str) -> DataFrame:
    d = examples.distance_against_asymmetry(pair_star(spark, sf))
    return d.withColumn("distance", r6(F.col("distance"))).withColumn("asymmetry", r6(F.col("asymmetry")))


def play_interventions(spark: SparkSession, sf: str) -> DataFrame:
    """How a view's visibility moves when its first item is hidden, revealed or left alone."""
    m = sit.intervention_summaries(star(spark, sf))
    return m.select("observation_id", "item_id", *[r6(F.col(x)).alias(x) for x in ("identity_delta", "hide_delta", "reveal_delta")])


def play_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return examples.pairs(star(spark, sf)).select("situation_id", "game_id", "transition_id", "pair_id", "from_state_id", "to_state_id", F.array_join("action_ids", ",").alias("actions"), F.array_join("observer_ids", ",").alias("observers"), "source_id")


def play_skipped_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return examples.skipped_pairs(star(spark, sf))


def play_pair_scalars(spark: SparkSession, sf: str) -> DataFrame:
    s = _stored(spark, sf)
    out = examples.pair_scalars(s, sit.measures(s))
    return out.select("pair_id", *[r6(F.col(x)).alias(x) for x in examples.PAIR_SCALARS])


def play_labels(spark: SparkSession, sf: str) -> DataFrame:
    s = _stored(spark, sf)
    return examples.observation_labels(s, sit.measures(s)).select("observation_id", *[r6(F.col(x)).alias(x) for x in examples.LABELS])


def play_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    return examples.alternatives(star(spark, sf)).select("pair_id", F.array_join("alternative_action_ids", ",").alias("alternative"))


def play_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of pairs, which fork and turn back; tested against a plain walk."""
    return examples.trajectories(examples.steps(star(spark, sf)))


def play_skipped_steps(spark: SparkSession, sf: str) -> DataFrame:
    return examples.skipped_steps(star(spark, sf))


def play_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    s = star(spark, sf)
    return examples.prefixes(s, examples.steps(s))


def play_prefix_summaries(spark: SparkSession, sf: str) -> DataFrame:
    s = _stored(spark, sf)
    return examples.prefix_summaries(s, materialize(examples.steps(s), "steps"))


def play_prefix_scalars(spark: SparkSession, sf: str) -> DataFrame:
    s = _stored(spark, sf)
    return examples.prefix_scalars(examples.prefixes(s, materialize(examples.steps(s), "steps")), sit.measures(s))


def play_transition_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return examples.evaluate_transitions(_stored(spark, sf))[0]


def play_transition_scalar_errors(spark: SparkSession, sf: str) -> DataFrame:
    return examples.evaluate_transitions(_stored(spark, sf))[1]


def play_sequence_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return examples.evaluate_sequences(_stored(spark, sf))[0]


def _fitted(s: sit.Situations):
    train = linear.split_by_hash(examples.aligned_pairs(s), "game_id", 7, 30).where("side = 'train'")
    return examples.fit_conditioned(train)


def play_rollout(spark: SparkSession, sf: str) -> DataFrame:
    """Five steps at most of the fitted model along the observed actions of every trajectory."""
    s = _stored(spark, sf)
    return examples.rollout(s, materialize(examples.steps(s), "steps"), _fitted(s), 5)


def play_counterfactuals(spark: SparkSession, sf: str) -> DataFrame:
    s = _stored(spark, sf)
    return examples.counterfactual_transitions(s, _fitted(s))


def _wanted(s: sit.Situations) -> DataFrame:
    """For every view: its first item hidden, revealed, or the next observer of the state taken instead."""
    v = sit.views(s).withColumn("item_id", F.get("items", F.lit(0))["item_id"])
    other = F.lead("observer_id").over(Window.partitionBy("situation_id", "state_id").orderBy("ord"))
    before = F.lag("observer_id").over(Window.partitionBy("situation_id", "state_id").orderBy("ord"))
    v = v.select("situation_id", "state_id", "observer_id", "item_id", F.coalesce(other, before).alias("target_observer_id"))
    each = v.withColumn("operation", F.explode(F.array(F.lit("identity"), F.lit("hide_information"), F.lit("reveal_information"), F.lit("change_observer"))))
    return each.where((F.col("operation") != "change_observer") | F.col("target_observer_id").isNotNull())


def play_applied(spark: SparkSession, sf: str) -> DataFrame:
    """What four operations do to the figures of every view."""
    s = star(spark, sf)
    d = examples.scalar_deltas(examples.apply_to_views(s, _wanted(s)))
    return d.select("state_id", "observer_id", "operation", *[r6(F.col(x)).alias(x) for x in ("volume_delta", "visibility_delta", "hidden_delta")])


def play_intervened_about(spark: SparkSession, sf: str) -> DataFrame:
    s = star(spark, sf)
    wanted = _wanted(s).where(F.col("target_observer_id").isNotNull()).withColumn("focal_id", F.col("target_observer_id"))
    return examples.intervened_about(s, wanted)


def play_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The first three observers of every state that has three, as a path."""
    s = star(spark, sf)
    seen = s.observations.groupBy("situation_id", "state_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "observer_id"))), 1, 3), lambda x: x["observer_id"]).alias("observers"))
    return examples.compose_paths(s, seen.where(F.size("observers") == 3).withColumn("path_id", F.col("state_id")))


def play_features(spark: SparkSession, sf: str) -> DataFrame:
    """The 42 columns of every situation."""
    return design_space.situation_features(_shared(spark, sf))


def play_game_features(spark: SparkSession, sf: str) -> DataFrame:
    return design_space.game_features(materialize(design_space.situation_features(_shared(spark, sf)), "situation-features"))


def play_feature_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Those of the 42 columns that SQL can tell without vectors."""
    f = design_space.situation_features(_stored(spark, sf))
    names = ("state__n_states", "state__n_phases", "state__n_active_players", "perspective__n_observations", "perspective__n_observers", "perspective__mean_volume", "perspective__mean_visibility", "perspective__mean_hidden", "action__n_actions", "action__n_action_types", "action__n_transitions", "action__n_actors", "action__n_decision_spaces", "action__n_decision_options", "region__n_units")
    return f.select("situation_id", *[r6(F.col(n)).alias(n) for n in names])


def _space(s: sit.Situations) -> design_geometry.Space:
    train = linear.split_by_hash(s.situations.select("game_id").distinct(), "game_id", 3, 30).where("side = 'train'").select("game_id")
    return design_geometry.build_space(s, materialize(train, "train-games"), 5)


def play_space(spark: SparkSession, sf: str) -> DataFrame:
    """Games and situations in the scaled and the projected view."""
    space = _space(_shared(spark, sf))
    out = None
    for level in ("game", "situation"):
        for view in ("normalized", "projected"):
            part = space.view(level, view).select(F.lit(level).alias("level"), F.lit(view).alias("view"), "id", "z")
            out = part if out is None else out.unionByName(part)
    return out


def play_novelty_means(spark: SparkSession, sf: str) -> DataFrame:
    s = _shared(spark, sf)
    return design_geometry.novelty_means(design_geometry.novelty_table(_space(s), "situation", [1, 2], train_ids=s.situations.select(F.col("situation_id").alias("id"))))


def play_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return design_geometry.cluster(_space(_shared(spark, sf)), 2, seed=5)


def play_situation_distances(spark: SparkSession, sf: str) -> DataFrame:
    return design_geometry.distances(_space(_shared(spark, sf)), "situation", "projected")


QUERIES = {
    f.__name__: f
    for f in (
        play_measures, play_ownership, play_interaction, play_state_vectors, play_view_vectors, play_action_vectors, play_about, play_asymmetric_pairs, play_mean_distances, play_distance_asymmetry, play_interventions,
        play_pairs, play_skipped_pairs, play_pair_scalars, play_labels, play_alternatives, play_trajectories, play_skipped_steps, play_prefixes, play_prefix_summaries, play_prefix_scalars, play_transition_evaluation,
        play_transition_scalar_errors, play_sequence_evaluation, play_rollout, play_counterfactuals, play_applied, play_intervened_about, play_paths, play_features, play_game_features, play_feature_counts, play_space,
        play_novelty_means, play_clusters, play_situation_distances,
    )
}


def _r(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


_E = """WITH e0 AS (SELECT *, strftime(ts, '%Y-%m-%d') AS situation_id, CAST((hour(ts) * 60 + minute(ts)) // 10 AS INTEGER) AS b, CAST(user_id AS VARCHAR) AS u FROM events),
  e1 AS (SELECT *, situation_id || 'T' || lpad(CAST(b AS VARCHAR), 3, '0') AS state_id, (CASE event_type WHEN 'click' THEN 'give' WHEN 'view' THEN 'guess' ELSE 'take' END) || '_' || event_type AS action_type FROM e0),
  e AS (SELECT *, state_id || '/' || u AS observation_id, event_type NOT IN ('error', 'purchase') AS known,
    CASE event_type WHEN 'error' THEN 'unknown_to_self' WHEN 'signup' THEN 'private' WHEN 'view' THEN 'public' WHEN 'click' THEN 'other_private' ELSE 'hidden' END AS vis,
    CASE event_id % 4 WHEN 0 THEN NULL WHEN 2 THEN CAST(user_id + 1 AS VARCHAR) ELSE u END AS holder, b::BIGINT * 100000 + user_id AS place FROM e1),
  sits AS (SELECT situation_id, CAST(substr(situation_id, 9, 2) AS INTEGER) AS day, list_sort(list_distinct(list(action_type))) AS types FROM e GROUP BY 1),
  states AS (SELECT situation_id, state_id, b, arg_min(u, (ts, event_id)) AS u0, arg_min(event_type, (ts, event_id)) AS t0, arg_min(props, (ts, event_id)) AS props,
    string_agg('a' || event_id, ',' ORDER BY event_id) FILTER (event_id % 2 = 0) AS acts, count(*) FILTER (event_id % 2 = 0) AS n_acts, min(event_id) FILTER (event_id % 2 = 0) AS a0 FROM e GROUP BY 1, 2, 3),
  views AS (SELECT DISTINCT situation_id, state_id, observation_id, u, user_id, b, place FROM e),
  links AS (SELECT *, lead(state_id) OVER w AS following, lag(state_id) OVER w AS before FROM states WINDOW w AS (PARTITION BY situation_id ORDER BY b)),
  transitions AS (SELECT situation_id, 't' || lpad(CAST(b AS VARCHAR), 3, '0') AS transition_id, state_id AS from_id, following AS to_id, acts, n_acts, a0 FROM links WHERE following IS NOT NULL
    UNION ALL SELECT situation_id, 'r' || lpad(CAST(b AS VARCHAR), 3, '0'), state_id, before, acts, n_acts, a0 FROM links WHERE before IS NOT NULL AND b % 11 = 0),
  keysets AS (SELECT situation_id, state_id, u, place, list_distinct(list(event_type || '|' || coalesce(holder, '')) FILTER (known)) AS keys, list_distinct(list(event_type) FILTER (known)) AS ids,
    list_distinct(list(event_type)) AS every FROM e GROUP BY 1, 2, 3, 4),
  clean AS (SELECT situation_id, state_id, u, place, coalesce(keys, []) AS keys, coalesce(ids, []) AS ids, every FROM keysets)
"""

_M = _E + """, per AS (SELECT situation_id, state_id, observation_id, u, count(*) AS n, count(*) FILTER (known) AS k,
    count(*) FILTER (holder = u AND (vis = 'unknown_to_self' OR NOT known)) AS own, count(*) FILTER (holder IS NOT NULL AND holder <> u AND vis = 'other_private' AND known) AS theirs FROM e GROUP BY 1, 2, 3, 4),
  moved AS (SELECT t.situation_id, transition_id, x.u, len(y.keys) - len(list_intersect(x.keys, y.keys)) AS gain, len(x.keys) - len(list_intersect(x.keys, y.keys)) AS loss
    FROM transitions t JOIN clean x ON x.state_id = from_id JOIN clean y ON y.state_id = to_id AND y.u = x.u),
  opts AS (SELECT situation_id, observation_id AS space_id, u, user_id, state_id, place, count(*) FILTER (event_type <> 'error' AND value > 20) AS available, count(*) FILTER (event_type <> 'error' AND NOT value > 20) AS constrained FROM e GROUP BY ALL),
  spaces AS (SELECT situation_id, space_id, u, place, CASE WHEN user_id % 5 <> 0 THEN state_id END AS state_id, user_id % 3 <> 0 AS complete, available, constrained FROM opts),
  branch AS (SELECT s.situation_id, s.state_id, s.u0, arg_min(d.available, d.place) AS available, arg_min(d.complete, d.place) AS complete
    FROM states s JOIN spaces d ON d.situation_id = s.situation_id AND d.u = s.u0 AND (d.state_id IS NULL OR d.state_id = s.state_id) WHERE t0 <> 'error' GROUP BY 1, 2, 3),
  m AS (SELECT situation_id, 'information_volume' AS metric, state_id, u AS observer_id, observation_id AS scope_key, n::DOUBLE AS value FROM per
    UNION ALL SELECT situation_id, 'information_visibility', state_id, u, observation_id, k / n FROM per
    UNION ALL SELECT situation_id, 'hidden_information', state_id, u, observation_id, n - k FROM per
    UNION ALL SELECT situation_id, 'self_knowledge_asymmetry', state_id, u, observation_id, CASE WHEN own > 0 AND theirs > 0 THEN own + theirs ELSE 0 END FROM per
    UNION ALL SELECT x.situation_id, 'information_asymmetry', x.state_id, NULL, x.state_id, avg(CASE WHEN len(list_distinct(list_concat(x.keys, y.keys))) = 0 THEN 0 ELSE 1 - len(list_intersect(x.keys, y.keys)) / len(list_distinct(list_concat(x.keys, y.keys)))::DOUBLE END)
      FROM clean x JOIN clean y ON x.state_id = y.state_id AND x.place < y.place GROUP BY 1, 3
    UNION ALL SELECT situation_id, 'information_gain', NULL, u, transition_id, gain FROM moved
    UNION ALL SELECT situation_id, 'information_loss', NULL, u, transition_id, loss FROM moved
    UNION ALL SELECT situation_id, 'legal_action_type_count', NULL, NULL, situation_id, len(types) FROM sits
    UNION ALL SELECT situation_id, 'available_decision_count', state_id, u, space_id, available FROM spaces WHERE complete
    UNION ALL SELECT situation_id, 'decision_constraint', state_id, u, space_id, constrained FROM spaces
    UNION ALL SELECT situation_id, 'decision_branching_factor', state_id, u0, state_id, available FROM branch WHERE complete)
"""


def _pooled(tokens: str, key: str, stats: list[str], source: str, total: str) -> str:
    """SQL of the mean of 12 hash components over (key, token) rows, followed by four counts of another relation."""
    x = f"('0x' || substr(sha256(token), CAST(2 * i + 1 AS BIGINT), 2))::INTEGER / 127.5 - 1"
    parts = " UNION ALL ".join(f"SELECT {key}, {12 + k}, {_r(s)} FROM {source}" for k, s in enumerate(stats))
    return f", tokens AS ({tokens}) SELECT {key}, CAST(i AS INTEGER) AS idx, {_r(f'sum({x}) / {total}')} AS x FROM tokens, (SELECT unnest(range(0, 12)) AS i) GROUP BY {key}, i UNION ALL {parts}"


_VIEW_TOKENS = """SELECT observation_id, situation_id, state_id, place, 'vis=' || vis || '|known=' || known::INTEGER || '|about=' || event_type || '|holder=' || coalesce(holder, 'None') || '|keys=' || array_to_string(list_sort(json_keys(props)), ',') AS token FROM e"""
_VIEW_Z = (
    _E
    + f""", tokens AS ({_VIEW_TOKENS}),
  hashed AS (SELECT observation_id, situation_id, state_id, place, i, sum(('0x' || substr(sha256(token), CAST(2 * i + 1 AS BIGINT), 2))::INTEGER / 127.5 - 1) / count(*) AS x FROM tokens, (SELECT unnest(range(0, 12)) AS i) GROUP BY ALL),
  sized AS (SELECT observation_id, count(*) AS n, count(*) FILTER (known) AS k, count(*) FILTER (vis = 'unknown_to_self') AS blind FROM e GROUP BY 1),
  z AS (SELECT h.observation_id, situation_id, state_id, place, list_concat(list(x ORDER BY i), [any_value(n)::DOUBLE, any_value(k)::DOUBLE, any_value(n - k)::DOUBLE, any_value(blind)::DOUBLE]) AS z FROM hashed h JOIN sized USING (observation_id) GROUP BY 1, 2, 3, 4)"""
)

SQL = {
    "play_measures": _M + f" SELECT situation_id, metric, state_id, observer_id, scope_key, {_r('value')} AS value FROM m",
    "play_ownership": _E
    + """, held AS (SELECT state_id, 'held by' AS kind, coalesce(holder, '') AS "of", count(*) AS n FROM e GROUP BY 1, 3 UNION ALL SELECT state_id, 'known of', event_type, arg_max(event_id % 3, (place, event_id)) FROM e GROUP BY 1, 3)
    SELECT state_id, CAST(count(*) FILTER (kind = 'held by') OVER (PARTITION BY state_id) AS INTEGER) AS holders, kind, "of", n FROM held""",
    "play_interaction": _E
    + """, labels AS (SELECT situation_id, list_sort(list_distinct(list(event_type))) AS l FROM e WHERE event_id % 100 = 0 GROUP BY 1)
    SELECT situation_id, CASE WHEN day % 2 = 0 THEN 'direct' ELSE 'none' END AS interaction, CASE WHEN day % 3 = 0 THEN 'simultaneous' ELSE 'sequential' END AS decision_timing,
      array_to_string(list_filter(types, lambda x: regexp_matches(x, 'clue|communicate|give|guess|treat|block')), ',') AS targeting, coalesce(array_to_string(l, ','), '') AS labels FROM sits LEFT JOIN labels USING (situation_id)""",
    "play_state_vectors": _E
    + """, s AS (SELECT *, CASE WHEN b < 72 THEN 'early' WHEN b % 5 <> 0 THEN 'late' END AS phase, CASE WHEN b % 7 <> 0 THEN b END AS turn, (t0 <> 'error')::INTEGER AS active FROM states)"""
    + _pooled(
        """SELECT state_id, 'phase=' || coalesce(phase, 'None') AS token FROM s UNION ALL SELECT state_id, 'turn=' || coalesce(CAST(turn AS VARCHAR), 'None') FROM s UNION ALL SELECT state_id, 'active=' || active FROM s
        UNION ALL SELECT state_id, 'key=' || k || '|type=int' FROM (SELECT state_id, unnest(json_keys(props)) AS k FROM s)""",
        "state_id", ["len(json_keys(props))", "coalesce(turn, 0)", "(phase IS NOT NULL)::INTEGER", "active"], "s", "count(*)",
    ),
    "play_view_vectors": _VIEW_Z + f" SELECT observation_id, CAST(i - 1 AS INTEGER) AS idx, {_r('z[i]')} AS x FROM z, (SELECT unnest(range(1, 17)) AS i)",
    "play_action_vectors": _E
    + """, a AS (SELECT t.situation_id, transition_id, event_id, action_type, props FROM transitions t JOIN e ON e.state_id = t.from_id AND event_id % 2 = 0),
    sized AS (SELECT situation_id, transition_id, count(*) AS n, count(DISTINCT action_type) AS types, 1 AS keys FROM a GROUP BY 1, 2)"""
    + _pooled(
        """SELECT situation_id, transition_id, 'type=' || action_type AS token FROM a UNION ALL SELECT DISTINCT situation_id, transition_id, 'param_key=' || unnest(json_keys(props)) FROM a
        UNION ALL SELECT situation_id, transition_id, 'n=' || n FROM sized""",
        "situation_id, transition_id", ["n", "types", "keys", "0"], "sized", "count(*)",
    ),
    "play_about": _VIEW_Z
    + f""" SELECT a.state_id, a.u AS observer_id_a, b.u AS observer_id_b, CAST(len(a.ids) - len(list_intersect(a.ids, b.ids)) AS INTEGER) AS only_a, CAST(len(b.ids) - len(list_intersect(a.ids, b.ids)) AS INTEGER) AS only_b,
      CAST(len(list_intersect(a.ids, b.ids)) AS INTEGER) AS shared, CAST(len(list_filter(list_distinct(list_concat(a.every, b.every)), lambda x: NOT list_contains(a.ids, x) AND NOT list_contains(b.ids, x))) AS INTEGER) AS hidden_both,
      {_r("1 - list_cosine_similarity(p.z, q.z)")} AS distance, 53 AS width
      FROM clean a JOIN clean b ON a.state_id = b.state_id AND a.u <> b.u JOIN z p ON p.state_id = a.state_id AND p.place = a.place JOIN z q ON q.state_id = b.state_id AND q.place = b.place""",
    "play_mean_distances": _VIEW_Z + f" SELECT a.situation_id, a.state_id, count(*) AS pairs, {_r('avg(1 - list_cosine_similarity(a.z, b.z))')} AS distance FROM z a JOIN z b ON a.state_id = b.state_id AND a.place < b.place GROUP BY 1, 2",
    "play_distance_asymmetry": _VIEW_Z
    + f""" SELECT a.situation_id, a.state_id, a.u AS a, b.u AS b, {_r("1 - list_cosine_similarity(p.z, q.z)")} AS distance,
      {_r("CASE WHEN len(list_distinct(list_concat(a.keys, b.keys))) = 0 THEN 0 ELSE 1 - len(list_intersect(a.keys, b.keys)) / len(list_distinct(list_concat(a.keys, b.keys)))::DOUBLE END")} AS asymmetry
      FROM clean a JOIN clean b ON a.state_id = b.state_id AND a.u < b.u JOIN z p ON p.state_id = a.state_id AND p.place = a.place JOIN z q ON q.state_id = b.state_id AND q.place = b.place""",
    "play_interventions": _E
    + f""", f AS (SELECT observation_id, arg_min(event_type, event_id) AS item_id, count(*) AS n, count(*) FILTER (known) AS k FROM e GROUP BY 1),
    g AS (SELECT f.observation_id, item_id, n, k, count(*) FILTER (event_type = item_id) AS same, count(*) FILTER (event_type = item_id AND known) AS same_known FROM f JOIN e USING (observation_id) GROUP BY ALL)
    SELECT observation_id, item_id, 0.0::DOUBLE AS identity_delta, {_r("(k - same_known) / n - k / n")} AS hide_delta, {_r("(k + same - same_known) / n - k / n")} AS reveal_delta FROM g""",
    "play_pairs": _E
    + """, seen AS (SELECT situation_id, transition_id, string_agg(u, ',' ORDER BY o) AS observers FROM (SELECT t.situation_id, transition_id, u, min(place) AS o FROM transitions t JOIN views v ON v.state_id IN (from_id, to_id) GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT t.situation_id, 'g' || day % 7 AS game_id, transition_id, t.situation_id || '/pair/' || transition_id AS pair_id, from_id AS from_state_id, to_id AS to_state_id, acts AS actions, observers, sha256(from_id || '|' || acts || '|' || to_id) AS source_id
    FROM transitions t JOIN seen USING (situation_id, transition_id) JOIN sits USING (situation_id) WHERE n_acts > 0""",
    "play_skipped_pairs": _E + " SELECT situation_id, transition_id, 'no actions' AS reason FROM transitions WHERE n_acts = 0",
    "play_pair_scalars": _M
    + f""", ats AS (SELECT situation_id, metric, state_id, observer_id, arg_min(value, scope_key) AS value FROM m WHERE metric IN ('information_volume', 'available_decision_count') AND state_id IS NOT NULL GROUP BY 1, 2, 3, 4),
    gl AS (SELECT situation_id, transition_id, avg(gain) AS gain, avg(loss) AS loss FROM moved GROUP BY 1, 2),
    d AS (SELECT t.situation_id, transition_id, x.metric, avg(y.value - x.value) AS v FROM transitions t JOIN ats x ON x.state_id = from_id JOIN ats y ON y.state_id = to_id AND y.metric = x.metric AND y.observer_id = x.observer_id GROUP BY 1, 2, 3)
    SELECT t.situation_id || '/pair/' || t.transition_id AS pair_id, {_r("gain")} AS information_gain, {_r("loss")} AS information_loss, {_r("v.v")} AS information_volume_delta, {_r("a.v")} AS available_decision_count_delta
    FROM transitions t LEFT JOIN gl USING (situation_id, transition_id) LEFT JOIN d v ON v.situation_id = t.situation_id AND v.transition_id = t.transition_id AND v.metric = 'information_volume'
      LEFT JOIN d a ON a.situation_id = t.situation_id AND a.transition_id = t.transition_id AND a.metric = 'available_decision_count' WHERE n_acts > 0""",
    "play_labels": _M
    + f""" SELECT p.observation_id, n::DOUBLE AS information_volume, {_r("k / n")} AS information_visibility, (n - k)::DOUBLE AS hidden_information, (CASE WHEN own > 0 AND theirs > 0 THEN own + theirs ELSE 0 END)::DOUBLE AS self_knowledge_asymmetry,
      d.available::DOUBLE AS available_decision_count FROM per p LEFT JOIN spaces d ON d.state_id = p.state_id AND d.u = p.u AND d.complete""",
    "play_alternatives": _E
    + """, firsts AS (SELECT situation_id, list(event_id ORDER BY event_id)[1:2] AS f FROM e GROUP BY 1)
    SELECT situation_id || '/pair/' || transition_id AS pair_id, 'a' || CASE WHEN n_acts > 1 THEN a0 WHEN f[1] <> a0 THEN f[1] ELSE f[2] END AS alternative FROM transitions JOIN firsts USING (situation_id)
    WHERE n_acts > 1 OR n_acts = 1 AND CASE WHEN f[1] <> a0 THEN f[1] ELSE f[2] END IS NOT NULL""",
    "play_applied": _E
    + f""", f AS (SELECT situation_id, state_id, u, place, arg_min(event_type, event_id) AS item_id, count(*) AS n, count(*) FILTER (known) AS k FROM e GROUP BY 1, 2, 3, 4),
    g AS (SELECT f.*, (SELECT count(*) FROM e WHERE e.state_id = f.state_id AND e.u = f.u AND event_type = item_id) AS same, (SELECT count(*) FROM e WHERE e.state_id = f.state_id AND e.u = f.u AND event_type = item_id AND known) AS same_known,
      coalesce(lead(place) OVER w, lag(place) OVER w) AS other FROM f WINDOW w AS (PARTITION BY state_id ORDER BY place)),
    h AS (SELECT g.state_id, g.u, 'identity' AS operation, n, k, n AS n2, k AS k2 FROM g UNION ALL SELECT state_id, u, 'hide_information', n, k, n, k - same_known FROM g UNION ALL SELECT state_id, u, 'reveal_information', n, k, n, k + same - same_known FROM g
      UNION ALL SELECT g.state_id, g.u, 'change_observer', g.n, g.k, o.n, o.k FROM g JOIN f o ON o.state_id = g.state_id AND o.place = g.other)
    SELECT state_id, u AS observer_id, operation, (n2 - n)::DOUBLE AS volume_delta, {_r("k2 / n2 - k / n")} AS visibility_delta, ((n2 - k2) - (n - k))::DOUBLE AS hidden_delta FROM h""",
    "play_feature_counts": _M
    + f""", st AS (SELECT situation_id, count(*) AS n, count(DISTINCT CASE WHEN b < 72 THEN 'early' WHEN b % 5 <> 0 THEN 'late' END) AS p, count(DISTINCT u0) FILTER (t0 <> 'error') AS a FROM states GROUP BY 1),
    pv AS (SELECT situation_id, count(*) AS n, count(DISTINCT u) AS o, avg(n) AS vol, avg(k / n) AS vis, avg(n - k) AS hid FROM per GROUP BY 1),
    ac AS (SELECT situation_id, count(*) AS n, count(DISTINCT action_type) AS t, count(DISTINCT u) AS w FROM e GROUP BY 1),
    tr AS (SELECT situation_id, count(*) AS n FROM transitions GROUP BY 1)
    SELECT situation_id, st.n::DOUBLE AS state__n_states, st.p::DOUBLE AS state__n_phases, st.a::DOUBLE AS state__n_active_players, pv.n::DOUBLE AS perspective__n_observations, pv.o::DOUBLE AS perspective__n_observers, {_r("vol")} AS perspective__mean_volume,
      {_r("vis")} AS perspective__mean_visibility, {_r("hid")} AS perspective__mean_hidden, ac.n::DOUBLE AS action__n_actions, ac.t::DOUBLE AS action__n_action_types, coalesce(tr.n, 0)::DOUBLE AS action__n_transitions, ac.w::DOUBLE AS action__n_actors,
      pv.n::DOUBLE AS action__n_decision_spaces, ac.n::DOUBLE AS action__n_decision_options, 1.0::DOUBLE AS region__n_units FROM st JOIN pv USING (situation_id) JOIN ac USING (situation_id) LEFT JOIN tr USING (situation_id)""",
}
