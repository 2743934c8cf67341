"""Pairs, trajectories, prefixes, models and interventions against plain walks over small fixtures."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from structlens.operators import design_geometry, examples, geometry, linear, sequence
from structlens.operators import situations as sit

DIM = 6


@pytest.fixture(scope="module")
def star(spark):
    """Two games, three situations of four states in a row, three observers."""
    rows = {name: [] for name in sit.Situations.__dataclass_fields__}
    for n, (situation, game) in enumerate((("g/1", "g"), ("g/2", "g"), ("h/1", "h"))):
        rows["situations"].append((situation, game, "none", "now", ["take"]))
        for i in range(4):
            state = f"s{i}"
            rows["states"].append((situation, i, state, i, "ann" if i % 2 else "bob", "early", json.dumps({"k": i + n})))
            for j, who in enumerate(("ann", "bob", "cy")[: 3 if i < 2 else 2]):
                obs = f"{state}/{who}"
                rows["observations"].append((situation, 10 * i + j, obs, state, who, obs))
                for k in range(1 + (i + j) % 3):
                    rows["info_items"].append((situation, obs, k, f"i{k}", "public" if k else "private", f"a{k}", ["x"], "{}", (i + k + j) % 2 == 0, who if k else None))
                rows["decision_spaces"].append((situation, 10 * i + j, obs, who, state, True))
                rows["decision_options"] += [(situation, obs, o, True, (o + i) % 2 == 0) for o in range(3)]
            rows["actions"].append((situation, i, f"m{i}", "ann", f"type{i % 2}", json.dumps({"p": 1})))
            if i < 3:
                acts = [f"m{i}", f"m{i + 1}"] if i == 1 else [f"m{i}"]
                rows["transitions"].append((situation, i, f"t{i}", state, f"s{i + 1}", acts if situation != "g/2" or i != 1 else []))
    rows["interpretations"].append(("g/1", "x"))
    kinds = {
        "situations": "situation_id string, game_id string, interaction string, decision_timing string, legal_action_types array<string>",
        "states": "situation_id string, ord bigint, state_id string, turn_number int, active_player_id string, phase string, data string",
        "observations": "situation_id string, ord bigint, observation_id string, state_id string, observer_id string, information_space_id string",
        "info_items": "situation_id string, information_space_id string, ord bigint, item_id string, visibility string, about string, known_to array<string>, payload string, content_known boolean, holder_id string",
        "decision_spaces": "situation_id string, ord bigint, space_id string, player_id string, state_id string, complete boolean",
        "decision_options": "situation_id string, space_id string, ord bigint, legal boolean, available boolean",
        "actions": "situation_id string, ord bigint, action_id string, player_id string, action_type string, parameters string",
        "transitions": "situation_id string, ord bigint, transition_id string, from_state_id string, to_state_id string, action_ids array<string>",
        "interpretations": "situation_id string, label string",
    }
    return sit.Situations(**{name: spark.createDataFrame(found, kinds[name]) for name, found in rows.items()})


def test_pairs_and_what_is_skipped(star):
    got = {(r.situation_id, r.transition_id): r for r in examples.pairs(star).collect()}
    assert len(got) == 8 and ("g/2", "t1") not in got
    assert got["g/1", "t1"].action_ids == ["m1", "m2"] and got["g/1", "t1"].observer_ids == ["ann", "bob", "cy"] and got["g/1", "t2"].observer_ids == ["ann", "bob"]
    assert [tuple(r) for r in examples.skipped_pairs(star).collect()] == [("g/2", "t1", "no actions")]


def test_trajectories_and_prefixes(star):
    walked = examples.steps(star)
    whole = {r.trajectory_id: r for r in examples.trajectories(walked).collect()}
    assert whole["g/1/trajectory/t0"].state_ids == ["s0", "s1", "s2", "s3"] and whole["g/1/trajectory/t0"].actor_ids == ["bob", "ann", "bob"]
    assert {k for k in whole if k.startswith("g/2")} == {"g/2/trajectory/t0", "g/2/trajectory/t2"}
    held = {r.prefix_id: r for r in examples.prefixes(star, walked).collect()}
    third = held["g/1/trajectory/t0/prefix/2"]
    assert third.state_ids == ["s0", "s1", "s2"] and third.target_state_id == "s3" and third.action_groups == [["m0"], ["m1", "m2"], ["m2"]] and third.observer_ids == ["ann", "bob", "cy"]
    assert all(r.target_state_id not in r.state_ids for r in held.values()) and len(held) == 8


def test_prefix_summaries_match_plain_sums(star):
    walked = examples.steps(star)
    z = {(r.situation_id, r.state_id): r.z for r in sit.state_vectors(star, DIM).collect()}
    a = {(r.situation_id, r.transition_id): r.z for r in sit.action_sets(star, DIM).collect()}
    for r in examples.prefix_summaries(star, walked, DIM).collect():
        if r.situation_id != "h/1":
            continue
        events = [np.array([*z["h/1", f"s{i}"], *a["h/1", f"t{i}"]]) for i in range(r.pos + 1)]
        expected = np.concatenate([events[0], events[-1], np.mean(events, axis=0), events[-1] - events[0], [len(events), len(events), 3]])
        assert len(r.summary) == 8 * DIM + 3 and np.allclose(r.summary, expected)


def test_pair_scalars_are_means_over_who_is_there_on_both_sides(star):
    m = sit.measures(star).cache()
    got = {r.pair_id: r for r in examples.pair_scalars(star, m).collect()}
    size = lambda i, j: 1 + (i + j) % 3
    assert got["g/1/pair/t0"].information_volume_delta == pytest.approx(np.mean([size(1, j) - size(0, j) for j in range(3)]))
    assert got["g/1/pair/t1"].information_volume_delta == pytest.approx(np.mean([size(2, j) - size(1, j) for j in range(2)]))
    assert got["g/1/pair/t0"].available_decision_count_delta == pytest.approx(1 - 2)
    labels = {r.observation_id: r for r in examples.observation_labels(star, m).where("situation_id = 'g/1'").collect()}
    assert len(labels) == 10 and labels["s1/cy"].information_volume == size(1, 2) and labels["s1/cy"].available_decision_count == 1
    assert {r.metric for r in examples.scalar_measurements(m).select("metric").distinct().collect()}.isdisjoint({"information_ownership", "structural_interaction"})


def test_models_predict_as_plain_ridge_does(star):
    pairs = examples.aligned_pairs(star, DIM).cache()
    rows = pairs.orderBy("pair_id").collect()
    x = np.array([[1, *r.z_from, *r.z_action] for r in rows])
    y = np.array([r.z_to for r in rows])
    expected = np.linalg.solve(x.T @ x + 1e-4 * np.eye(x.shape[1]), x.T @ y)
    weights = examples.fit_conditioned(pairs, DIM)
    assert np.allclose(weights, expected, atol=1e-6)
    found = examples.predict_conditioned(pairs, weights).orderBy("pair_id").collect()
    assert np.allclose([r.predicted for r in found], x @ expected, atol=1e-6)
    error = pairs.select(F.avg(examples.vector_mse(F.col("z_from"), F.col("z_to")))).first()[0]
    assert error == pytest.approx(np.mean((x[:, 1 : DIM + 1] - y) ** 2))
    rolled = {(r.situation_id, r.pos): r.z for r in examples.rollout(star, examples.steps(star), weights, 2, DIM).where("trajectory_id like '%t0'").collect()}
    one = next(r for r in rows if r.pair_id == "h/1/pair/t0")
    first = np.array([1, *one.z_from, *one.z_action]) @ expected
    second = np.array([1, *first, *next(r for r in rows if r.pair_id == "h/1/pair/t1").z_action]) @ expected
    assert ("h/1", 3) not in rolled and np.allclose(rolled["h/1", 0], one.z_from) and np.allclose(rolled["h/1", 2], second, atol=1e-6)
    probed = examples.probe_scalars(pairs.withColumn("v", F.get("z_to", F.lit(0))).withColumn("none", F.lit(None).cast("double")), pairs, "z_from", DIM, ["v", "none"])
    assert probed.where("p_none is not null").isEmpty() and probed.where("p_v is null").isEmpty()


def test_evaluations_report_every_held_out_pair(star):
    import hashlib

    side = lambda seed, g: int(hashlib.sha256(f"{seed}|{g}".encode()).hexdigest()[:8], 16) % 100 < 50
    split = next(i for i in range(50) if side(i, "g") != side(i, "h"))
    one_sided = next(i for i in range(50) if side(i, "g") == side(i, "h"))
    with pytest.raises(ValueError):
        examples.evaluate_transitions(star, seed=one_sided, percent=50, dim=DIM)
    report, errors = examples.evaluate_transitions(star, seed=split, percent=50, dim=DIM)
    assert report.first().pairs in (3, 5) and {r.scalar for r in errors.collect()} == set(examples.PAIR_SCALARS)
    report, errors = examples.evaluate_sequences(star, seed=split, percent=50, dim=DIM)
    row = report.first()
    assert row.prefixes in (3, 5) and min(row.sequence_mse, row.last_state_mse, row.transition_mse) >= 0 and len(errors.collect()) == 3


def test_alternatives_and_counterfactuals(star):
    other = {r.pair_id: r.alternative_action_ids for r in examples.alternatives(star).collect()}
    assert other["g/1/pair/t0"] == ["m1"] and other["g/1/pair/t1"] == ["m1"] and other["g/1/pair/t2"] == ["m0"]
    weights = examples.fit_conditioned(examples.aligned_pairs(star, DIM), DIM)
    for r in examples.counterfactual_transitions(star, weights, DIM).collect():
        assert np.allclose(np.array(r.counterfactual) - r.factual, r.delta) and r.query_id.startswith(f"{r.pair_id}/cf/")


def wanted(spark, *rows):
    return spark.createDataFrame(rows, "situation_id string, state_id string, observer_id string, operation string, item_id string, target_observer_id string")


def test_interventions_on_views(spark, star):
    ask = wanted(spark, ("g/1", "s1", "bob", "identity", None, None), ("g/1", "s1", "bob", "hide_information", "i0", None), ("g/1", "s1", "bob", "reveal_information", "i1", None), ("g/1", "s1", "bob", "change_observer", None, "cy"))
    got = {r.operation: r for r in examples.scalar_deltas(examples.apply_to_views(star, ask)).collect()}
    known = [(1 + k + 1) % 2 == 0 for k in range(3)]
    assert got["identity"].visibility_delta == 0 and got["hide_information"].hidden_delta == known[0] and got["reveal_information"].hidden_delta == -(not known[1])
    assert got["change_observer"].volume_delta == 1 - 3
    about = examples.intervened_about(star, ask.withColumn("focal_id", F.lit("ann")), DIM).collect()
    plain = {(r.observer_id_a, r.observer_id_b): r.vector for r in sit.about(star, DIM).where("situation_id = 'g/1' and state_id = 's1'").collect()}
    for r in about:
        assert np.allclose(r.before, plain["ann", "bob"]) and len(r.delta) == 3 * DIM + 5
        assert not np.any(r.delta) if r.operation == "identity" else np.any(r.delta)
    for bad in (("g/1", "s9", "bob", "identity", None, None), ("g/1", "s1", "bob", "hide_information", "i9", None), ("g/1", "s1", "bob", "change_observer", None, "zoe"), ("g/1", "s1", "bob", "substitute_action", None, None)):
        with pytest.raises(Exception, match="missing|not applicable"):
            examples.apply_to_views(star, wanted(spark, bad)).collect()


def test_intervention_ids_depend_on_content_only(spark):
    df = spark.createDataFrame([("s", "o", "i"), ("s", "o", "j")], "state string, observer string, item string")
    make = lambda: examples.intervention("hide_information", source_state_id=F.col("state"), observer_id=F.col("observer"), item_id=F.col("item"))
    a, b = [[r.iv.intervention_id for r in df.select(make().alias("iv")).collect()] for _ in range(2)]
    assert a == b and len(set(a)) == 2 and all(x.startswith("iv/") and len(x) == 67 for x in a)
    named = df.select(examples.counterfactual_id(F.lit("view/1"), make()).alias("x")).first().x
    assert named == f"view/1/cf/hide_information/{a[0][3:19]}"
    with pytest.raises(ValueError):
        examples.intervention("hide_information", observer_id=F.col("observer"))
    with pytest.raises(ValueError):
        examples.intervention("swap")


def test_paths_and_presence(spark, star):
    paths = spark.createDataFrame([("p", "g/1", "s1", ["cy", "ann", "bob"])], "path_id string, situation_id string, state_id string, observers array<string>")
    z = {r.observer_id: r.z for r in sit.view_vectors(star, DIM).where("situation_id = 'g/1' and state_id = 's1'").collect()}
    got = examples.compose_paths(star, paths, DIM).first().vector
    assert np.allclose(got, [*z["cy"], *z["ann"], *z["bob"], *(np.array(z["bob"]) - z["cy"])])
    for bad in (["cy", "cy"], ["cy", "zoe"]):
        with pytest.raises(Exception, match="cycle|missing"):
            examples.compose_paths(star, paths.withColumn("observers", F.array(*[F.lit(x) for x in bad])), DIM).collect()
    assert examples.compose_paths(star, paths.withColumn("observers", F.array(F.lit("cy"), F.lit("cy"))), DIM, allow_cycles=True).count() == 1
    with pytest.raises(Exception, match="missing observer"):
        examples.require_observers(star, spark.createDataFrame([("g/1", "s3", "cy")], "situation_id string, state_id string, observer_id string")).collect()
    means = {(r.situation_id, r.state_id): r.pairs for r in examples.mean_pair_distances(star, DIM).collect()}
    assert means["g/1", "s0"] == 3 and means["g/1", "s3"] == 1


def test_chains_equal_a_plain_walk_on_random_graphs(spark):
    rng = random.Random(3)
    edges = [(f"g{g}", i, f"{g}.{i}", f"n{rng.randrange(6)}", f"n{rng.randrange(6)}") for g in range(40) for i in range(rng.randrange(8))]
    df = spark.createDataFrame(edges, "g string, ord int, e string, a string, b string")
    got = {(r.g, r.e): (r.chain, r.pos, r.skipped) for r in sequence.chains(df, "g", "e", "a", "b", "ord").collect()}
    assert len(got) == len(edges)
    for g in {e[0] for e in edges}:
        own = [(e, a, b) for x, _, e, a, b in edges if x == g]
        by_chain = {}
        for e, a, b in own:
            chain, pos, why = got[g, e]
            if why is None:
                by_chain.setdefault(chain, {})[pos] = (e, a, b)
        for chain in by_chain.values():
            path = [chain[i] for i in range(len(chain))]
            assert all(x[2] == y[1] for x, y in zip(path, path[1:], strict=False))
            points = [path[0][1], *(x[2] for x in path)]
            assert len(set(points)) == len(points)


def test_space_clusters_and_novelty(spark, star):
    train = spark.createDataFrame([("g",), ("h",)], "game_id string")
    space = design_geometry.build_space(star, train, 3)
    assert len(space.kept) == 3 and len(space.view("game", "projected").first().z) == 3 and len(space.view("situation").first().z) == 42
    whole = {r.id: r.z for r in space.view("game").collect()}
    assert all(np.allclose(r.z, [whole[r.id][i] for i in space.kept]) for r in space.view("game", "projected").collect())
    assert {r.cluster for r in design_geometry.cluster(space, 2).collect()} == {0, 1} and design_geometry.cluster(space, 2, seed=9).count() == 2
    assert design_geometry.distances(space, "situation").count() == 3
    out = design_geometry.experiment(star, train, 2, [1])
    assert out["novelty_means"].first().rows == 2
    with pytest.raises(ValueError):
        design_geometry.build_space(star, spark.createDataFrame([("nowhere",)], "game_id string"))
    with pytest.raises(ValueError):
        design_geometry.build_space(star, train).view("game", "projected")


def test_wide_sums_equal_column_sums(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(60, 13))
    df = spark.createDataFrame([(list(map(float, r)),) for r in data], "v array<double>").repartition(3)
    x, y = [F.get("v", F.lit(i)) for i in range(10)], [F.get("v", F.lit(i)) for i in (10, 11, 12)]
    a, b = linear.gram(df, x, y)
    full = np.c_[np.ones(60), data[:, :10]]
    assert np.allclose(a, full.T @ full) and np.allclose(b, full.T @ data[:, 10:])
    weights = linear.fit_ridge(df, x, y)
    got = df.select("v", linear.predict_array(F.slice("v", 1, 10), weights).alias("p")).collect()
    assert all(np.allclose(r.p, [1, *r.v[:10]] @ weights) for r in got)
    assert linear.gram(df.limit(0), x, y)[0].sum() == 0


def test_distances_and_places(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id int, v array<double>").repartition(4)
    got = {(r.id_a, r.id_b): r.distance for r in geometry.all_distances(df, "id", "v").collect()}
    assert len(got) == 190 and all(a < b and d == pytest.approx(b - a) for (a, b), d in got.items())
    assert geometry.vectors_at(df, "id", "v", [3, 0, 19]) == [[3.0, 1.0], [0.0, 1.0], [19.0, 1.0]]


def test_cell_index_finds_most_neighbours_and_splits_hot_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 8)) * 4
    z = [centers[0 if i % 3 == 0 else rng.integers(12)] + rng.normal(size=8) for i in range(1500)]
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(z)] + [(None, [0.0] * 8)], "id bigint, v array<double>").repartition(4)
    monkeypatch.setattr(geometry, "BLOCK_ROWS", 100)
    index = geometry.CellIndex(df, "id", "v")
    asked = df.where("id % 50 = 0")
    exact = geometry.nearest(asked, df.where("id is not null"), "id", "v", 5)
    probes = index.probes_for(5)
    assert 1 <= probes <= 6
    row = geometry.recall(index.search(asked, 5, probes), exact, "id").first()
    assert row.queries == 30 and row.recall >= 0.9 and sum(index.sizes.values()) == 1500 and max(index.sizes.values()) > 100
    whole = index.search(asked, 5, probes=len(index.centers))
    assert geometry.recall(whole, exact, "id").first().recall == 1.0


def test_widest_pair_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, list(map(float, rng.normal(size=4)))) for i in range(150)] + [(999, 7, [1.0] * 4)]
    df = spark.createDataFrame(rows, "id int, g int, v array<double>")
    monkeypatch.setattr(geometry, "BLOCK_ROWS", 16)
    got = {r.g: r.widest for r in geometry.widest(df, "g", "id", "v").collect()}
    for g in range(3):
        z = np.array([v for _, x, v in rows if x == g])
        assert got[g] == pytest.approx(max(np.sqrt(((z - p) ** 2).sum(1)).max() for p in z))
    assert got[7] == 0
    pairs = geometry.group_distances(df.where("id < 60").unionByName(spark.createDataFrame([(-1, 0, [0.0] * 4)], df.schema)), "g", "id", "v").collect()
    assert len(pairs) == sum(n * (n - 1) // 2 for n in (21, 20, 20)) and all(r.id_a < r.id_b for r in pairs)
    z = {i: np.array(v) for i, _, v in rows}
    for r in pairs:
        if r.id_a < 0:
            assert r.cosine is None
        else:
            a, b = z[r.id_a], z[r.id_b]
            assert r.l2 == pytest.approx(np.linalg.norm(a - b)) and r.cosine == pytest.approx(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def test_components_that_vary_alike_are_kept_by_place(spark, star):
    """Scaled columns vary by 1 or not at all; rounding decides nothing."""
    space = design_geometry.build_space(star, spark.createDataFrame([("g",), ("h",)], "game_id string"), 5)
    z = np.array([r.z for r in space.view("game").collect() if r.id in ("g", "h")])
    assert list(space.kept) == [int(i) for i in np.flatnonzero(z.var(0) > 0.5)[:5]]
