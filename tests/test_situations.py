import json

import pytest
from pyspark.sql import functions as F

from structlens.operators import design_space, linear, relational, sequence
from structlens.operators import situations as sit
from structlens.plans import structure_queries


@pytest.fixture(scope="module")
def tables(spark):
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)

    j = json.dumps
    item = "situation_id string, information_space_id string, ord int, item_id string, visibility string, about string, known_to array<string>, payload string, content_known boolean, holder_id string"
    return sit.Situations(
        df([("g/1", "g", "competitive", "sequential", ["give_clue", "pass"]), ("h/1", "h", "coop", "simultaneous", [])], "situation_id string, game_id string, interaction string, decision_timing string, legal_action_types array<string>"),
        df(
            [("g/1", 0, "s1", 1, "p1", "deal", j({"b": 1, "a": [1], "c": None, "d": 1.5, "e": {"x": 1}})), ("g/1", 1, "s2", None, None, "", "{}"), ("h/1", 0, "s1", 0, "q", None, None)],
            "situation_id string, ord int, state_id string, turn_number int, active_player_id string, phase string, data string",
        ),
        df(
            [("g/1", 0, "o1", "s1", "p1", "i1"), ("g/1", 1, "o2", "s1", "p2", "i2"), ("g/1", 2, "o3", "s2", "p1", "i3"), ("g/1", 3, "o4", "s1", "p1", "i2")],
            "situation_id string, ord int, observation_id string, state_id string, observer_id string, information_space_id string",
        ),
        df(
            [
                ("g/1", "i1", 0, "x", "unknown_to_self", "card", ["p2"], "{}", False, "p1"), ("g/1", "i1", 1, "y", "other_private", "hand", ["p1", "p2"], j({"k": 1, "c": 2}), True, "p2"),
                ("g/1", "i2", 0, "x", "public", "card", ["p2"], None, True, "p1"), ("g/1", "i3", 0, "x", "public", "card", [], None, True, "p1"), ("g/1", "i3", 1, "z", "public", None, ["p1"], None, True, None),
            ],
            item,
        ),
        df([("g/1", 0, "d1", "p1", None, True), ("g/1", 1, "d2", "p1", "s1", False), ("g/1", 2, "d3", "p2", "s1", False)], "situation_id string, ord int, space_id string, player_id string, state_id string, complete boolean"),
        df([("g/1", "d1", 0, True, True), ("g/1", "d1", 1, True, False), ("g/1", "d1", 2, False, True), ("g/1", "d3", 0, True, False)], "situation_id string, space_id string, ord int, legal boolean, available boolean"),
        df([("g/1", 0, "a1", "p1", "give_clue", j({"n": 1})), ("g/1", 1, "a2", "p2", "pass", "{}")], "situation_id string, ord int, action_id string, player_id string, action_type string, parameters string"),
        df([("g/1", 0, "t1", "s1", "s2", ["a2", "a1"]), ("g/1", 1, "t2", "s2", "s1", [])], "situation_id string, ord int, transition_id string, from_state_id string, to_state_id string, action_ids array<string>"),
        df([("g/1", "bluff"), ("g/1", "bluff"), ("g/1", "aim")], "situation_id string, label string"),
    )


def test_thirteen_measures(tables):
    rows = {(r.situation_id, r.metric, r.scope_key, r.observer_id): (r.value if r.value is not None else json.loads(r.value_json)) for r in sit.measures(tables).collect()}
    get = lambda m, k, o=None: rows["g/1", m, k, o]
    assert get("information_volume", "o1", "p1") == 2 and get("information_visibility", "o1", "p1") == 0.5 and get("hidden_information", "o1", "p1") == 1
    assert get("information_volume", "o4", "p1") == 2  # the first observation's space, not its own
    assert get("self_knowledge_asymmetry", "o1", "p1") == 2 and get("self_knowledge_asymmetry", "o2", "p2") == 0
    assert get("information_asymmetry", "s1") == pytest.approx((1 + 0 + 1) / 3) and ("g/1", "information_asymmetry", "s2", None) not in rows
    owned = get("information_ownership", "s1")
    assert owned == {"by_holder": {"p1": 3, "p2": 2}, "n_holders": 2, "known_to_sizes": {"card": 1, "hand": 2}}
    assert get("information_ownership", "s2") == {"by_holder": {"": 1, "p1": 1}, "n_holders": 2, "known_to_sizes": {"card": 0, "z": 1}}
    assert rows["h/1", "information_ownership", "s1", None] == {"by_holder": {}, "n_holders": 0, "known_to_sizes": {}}
    assert get("information_gain", "t1", "p1") == 2 and get("information_loss", "t1", "p1") == 1 and ("g/1", "information_gain", "t1", "p2") not in rows
    assert get("legal_action_type_count", "g/1") == 2 and rows["h/1", "legal_action_type_count", "h/1", None] == 0
    assert get("available_decision_count", "d1", "p1") == 1 and ("g/1", "available_decision_count", "d3", "p2") not in rows
    assert get("decision_constraint", "d1", "p1") == 1 and get("decision_constraint", "d3", "p2") == 1 and get("decision_constraint", "d2", "p1") == 0
    assert get("decision_branching_factor", "s1", "p1") == 1 and ("h/1", "decision_branching_factor", "s1", "q") not in rows
    assert get("structural_interaction", "g/1") == {"interaction": "competitive", "decision_timing": "sequential", "targeting_action_types": ["give_clue"], "labels": ["aim", "bluff"]}


def reference_vector(tokens, stats, dim):
    import hashlib

    vectors = [[hashlib.sha256(t.encode()).digest()[i % 32] / 127.5 - 1 for i in range(dim)] for t in tokens]
    pooled = [sum(x) / len(vectors) for x in zip(*vectors, strict=True)] if vectors else [0.0] * dim
    return pooled if dim <= 4 else pooled[: dim - 4] + stats


def test_bag_encoders(tables):
    states = {(r.situation_id, r.state_id): r.z for r in sit.state_vectors(tables).collect()}
    tokens = ["phase=deal", "turn=1", "active=1", "key=a|type=list", "key=b|type=int", "key=c|type=NoneType", "key=d|type=float", "key=e|type=dict"]
    assert states["g/1", "s1"] == pytest.approx(reference_vector(tokens, [5.0, 1.0, 1.0, 1.0], 16))
    assert states["h/1", "s1"] == pytest.approx(reference_vector(["phase=None", "turn=0", "active=1"], [0.0, 0.0, 0.0, 1.0], 16))
    view = {r.observation_id: r.z for r in sit.view_vectors(tables, 40).collect()}
    tokens = ["vis=unknown_to_self|known=0|about=card|holder=p1|keys=", "vis=other_private|known=1|about=hand|holder=p2|keys=c,k"]
    assert view["o1"] == pytest.approx(reference_vector(tokens, [2.0, 1.0, 1.0, 1.0], 40))
    sets = {r.transition_id: (r.set_key, r.z) for r in sit.action_sets(tables).collect()}
    assert sets["t1"][0] == "a1\x1fa2" and sets["t1"][1] == pytest.approx(reference_vector(["type=pass", "type=give_clue", "param_key=n", "n=2"], [2.0, 2.0, 1.0, 0.0], 16)) and "t2" not in sets


def test_interventions_are_monotone_and_identity_changes_nothing(tables):
    rows = sit.intervention_summaries(tables).collect()
    assert len(rows) == 4 and all(r.identity_delta == 0 and r.hide_delta <= 0 <= r.reveal_delta for r in rows)
    by = {r.observation_id: (r.hide_delta, r.reveal_delta) for r in rows}
    assert by["o1"] == (0.0, 0.5) and by["o2"] == (-1.0, 0.0)


def test_perspectives_are_directed(tables):
    rows = {(r.state_id, r.observer_id_a, r.observer_id_b): r for r in sit.about(tables).collect()}
    ab = rows["s1", "p1", "p2"]
    assert (ab.only_a, ab.only_b, ab.shared, ab.hidden_both) == (1, 1, 0, 0) and len(ab.vector) == 53
    assert sit.asymmetric_pairs(sit.about(tables)).collect()[0].n_asymmetric == 1


def test_design_space_has_42_columns_and_no_catalog_column(tables):
    df = design_space.situation_features(tables)
    assert len(design_space.COLUMNS) == 42 and df.columns[2:] == list(design_space.COLUMNS)
    rows = {r.situation_id: r for r in df.collect()}
    g, h = rows["g/1"], rows["h/1"]
    assert (g.state__n_states, g.state__n_phases, g.perspective__n_observations, g.perspective__n_observers, g.action__n_transitions, g.sequence__max_steps) == (2, 1, 4, 2, 2, 1)
    assert (h.perspective__present, h.action__present, h.state__present, h.region__present, h.perspective__mean_volume) == (0, 0, 1, 1, 0)
    games = design_space.game_features(df)
    assert {r.game_id: r.region__n_units for r in games.collect()} == {"g": 1, "h": 1}
    scaled = {r.game_id: r for r in design_space.scale(games, design_space.fit_scaler(games), "game_id").collect()}
    assert scaled["h"].perspective__mean_volume == 0 and scaled["g"].state__n_states == pytest.approx(1) and scaled["h"].state__n_states == pytest.approx(-1)
    with pytest.raises(ValueError):
        design_space.require_no_metadata(["state__n_states", "rating"])
    design_space.require_no_metadata(design_space.COLUMNS)


def test_chains_stop_at_forks_and_skip_loops():
    assert sequence.walk([("t1", "a", "b"), ("t2", "b", "c")]) == ([["t1", "t2"]], [])
    assert sequence.walk([("t2", "b", "c"), ("t1", "a", "b")]) == ([["t1", "t2"]], [])
    chains, skipped = sequence.walk([("t1", "a", "b"), ("t2", "b", "c"), ("t3", "b", "d")])
    assert chains == [["t1"], ["t2"], ["t3"]] and not skipped
    assert sequence.walk([("t1", "a", "a")]) == ([], [("t1", "cycle")])
    assert sequence.walk([("t1", "a", "b"), ("t2", "b", "a")]) == ([], [("t2", "cycle"), ("t1", "into a cycle")])
    assert sequence.walk([("e1", "a", "b"), ("e2", "b", "c"), ("e3", "c", "b")]) == ([], [("e3", "cycle"), ("e1", "into a cycle"), ("e2", "into a cycle")])
    assert sequence.walk([("e1", "a", "b"), ("e2", "b", "b"), ("e3", "b", "c")]) == ([["e1"], ["e3"]], [("e2", "cycle")])
    assert sequence.walk([("e1", "a", "b"), ("e2", "x", "b"), ("e3", "b", "c")]) == ([["e1", "e3"], ["e2"]], [])
    assert sequence.walk([]) == ([], [])


def test_sequence_frames(spark):
    steps = spark.createDataFrame([("g", 0, "a", "b"), ("g", 1, "b", "c")], "g string, pos int, start string, end string")
    back = sequence.reversed_steps(steps, "g", "pos", "start", "end").orderBy("pos").collect()
    assert [(r.pos, r.start, r.end) for r in back] == [(0, "c", "b"), (1, "b", "a")]
    assert {r.pos: r.prefix for r in sequence.prefixes(steps, "g", "pos", "start").collect()} == {0: ["a"], 1: ["a", "b"]}
    assert sequence.bounded(steps, "pos", 1).count() == 1


def test_first_match_prefers_the_earlier_of_equal_and_null(spark):
    left = spark.createDataFrame([("p", "s1"), ("p", "s2"), ("q", "s1")], "player string, state string")
    right = spark.createDataFrame([("p", None, 2, "any"), ("p", "s1", 3, "late"), ("p", "s2", 1, "early"), ("p", "s2", 0, "first")], "player string, state string, ord int, v string")
    got = {(r.player, r.state): r.v for r in relational.first_match(left, right, ["player"], "state", "ord", ["v"]).collect()}
    assert got == {("p", "s1"): "any", ("p", "s2"): "first", ("q", "s1"): None}
    with pytest.raises(Exception, match="missing thing"):
        relational.require_all(left, right.select("player", "state").where("v = 'late'"), ["player", "state"], "thing").collect()


def test_ridge_solves_its_normal_equations(spark):
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ np.array([[1.0, 0.5], [2.0, 0.0], [-1.0, 3.0]]) + 4
    df = spark.createDataFrame([tuple(map(float, (*a, *b))) for a, b in zip(x, y, strict=True)], "a double, b double, c double, u double, v double")
    weights = linear.fit_ridge(df, [F.col(n) for n in "abc"], [F.col(n) for n in "uv"])
    full = np.c_[np.ones(200), x]
    assert np.allclose(weights, np.linalg.solve(full.T @ full + 1e-4 * np.eye(4), full.T @ y))
    u, _ = linear.predict([F.col(n) for n in "abc"], weights)
    assert linear.errors(df, u, F.col("u")).first().rmse < 1e-3
    train, test = linear.split_groups([f"g{i}" for i in range(10)], 3, 0.3)
    assert len(test) == 3 and not set(train) & set(test) and linear.split_groups(["b", "a", "c"], 0, 0.34)[1] and linear.split_groups(list("cab"), 5, 0.3) == linear.split_groups(list("abc"), 5, 0.3)


def test_observers_who_meet_on_a_day_but_in_no_hour_are_compared(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 09:10:00", "view"), (2, 2, "2024-01-01 15:00:00", "view"), (3, 2, "2024-01-01 16:00:00", "buy"), (4, 3, "2024-01-02 09:00:00", "view")]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    day = [tuple(r)[1:] for r in structure_queries.known_set_asymmetry_daily(spark, str(tmp_path)).collect()]
    counts = [tuple(r)[1:] for r in structure_queries.a_about_b_counts_daily(spark, str(tmp_path)).collect()]
    assert day == [(1, 0.5)] and counts == [(2, 1, 1, 2, 2)]
    assert structure_queries.known_set_asymmetry(spark, str(tmp_path)).count() == 0
