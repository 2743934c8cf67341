"""Sums over the pairs of a state without its pairs, held against the pairs."""

import dataclasses
import hashlib
import itertools
import random

import numpy as np
import pytest

from structlens.operators import design_space, examples
from structlens.operators import situations as sit
from structlens.plans import play_queries


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(i, f"2024-01-0{rng.choice((1, 2))} 0{rng.choice((1, 9))}:{rng.choice((10, 20))}:00", rng.randrange(14), rng.choice(("view", "click", "signup", "error", "purchase")), float(rng.randrange(40)), '{"k": 1}') for i in range(150)]
    rows.append((999, "2024-01-03 05:00:00", 3, "view", 1.0, '{"k": 1}'))  # alone in its state
    folder = tmp_path_factory.mktemp("events")
    spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").write.parquet(f"{folder}/events.parquet")
    return play_queries.star(spark, str(folder))


def formed(df):
    """Whether the plan joins the views of a state with each other."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return any(f"{x}_a" in plan for x in ("ord", "observer_id"))


def by_state(rows):
    groups = {}
    for r in rows:
        groups.setdefault((r.situation_id, r.state_id), []).append(r)
    return groups


def cosine(a, b):
    scale = np.linalg.norm(a) * np.linalg.norm(b)
    return 1 - np.dot(a, b) / scale if scale else 0.0


def test_mean_distances_form_no_pairs(star):
    df = examples.mean_pair_distances(star)
    assert not formed(df)
    got = {(r.situation_id, r.state_id): (r.pairs, r.distance) for r in df.collect()}
    want = {k: list(itertools.combinations([np.array(r.z) for r in rows], 2)) for k, rows in by_state(sit.view_vectors(star).collect()).items()}
    assert got == {k: (len(p), pytest.approx(np.mean([cosine(a, b) for a, b in p]), abs=1e-12)) for k, p in want.items() if p}


def test_cosine_sums_count_a_zero_vector_as_no_distance(spark):
    df = spark.createDataFrame([("s", [1.0, 0.0], 2), ("s", [0.0, 1.0], 1), ("s", [0.0, 0.0], 1), ("t", [1.0, 1.0], 1)], "g string, z array<double>, n int")
    assert {r.g: (r.rows, round(r.distance, 9)) for r in sit.cosine_sums(df, ["g"], "z", "n", 2).collect()} == {"s": (4, 2.0), "t": (1, 0.0)}


def test_asymmetric_counts_equal_the_pairs(star):
    df = sit.asymmetric_counts(sit.seen(star))
    assert not formed(df)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, sit.asymmetric_pairs(sit.about(star)).collect()))


def test_information_asymmetry_forms_no_pairs(star):
    df = sit.measures(star)
    assert not formed(df)
    got = {(r.situation_id, r.state_id): r.value for r in df.where("metric = 'information_asymmetry'").collect()}
    keys = {k: [{tuple(x) for x in r.k} for r in rows] for k, rows in by_state(sit.views(star).select("situation_id", "state_id", sit.known_keys(sit.F.col("items")).alias("k")).collect()).items()}
    apart = lambda a, b: 1 - len(a & b) / len(a | b) if a | b else 0.0
    assert got == {k: pytest.approx(np.mean([apart(a, b) for a, b in itertools.combinations(sets, 2)])) for k, sets in keys.items() if len(sets) > 1}


def test_pairs_of_views_measure_each_vector_once(star):
    """The norms are columns of the views, not worked out per pair."""
    for df in (sit.about_counts(star), examples.distance_against_asymmetry(star)):
        assert "norm_a" in df._jdf.queryExecution().analyzed().toString()
    z = {(r.state_id, r.observer_id): np.array(r.z) for r in sit.view_vectors(star).collect()}
    ids = {(r.state_id, r.observer_id): ({i.item_id for i in r["items"]}, {i.item_id for i in r["items"] if i.content_known}) for r in sit.views(star).collect()}
    rows = sit.about_counts(star).collect()
    for r in rows:
        (a, ka), (b, kb) = ids[r.state_id, r.observer_id_a], ids[r.state_id, r.observer_id_b]
        assert (r.only_a, r.only_b, r.shared, r.hidden_both) == (len(ka - kb), len(kb - ka), len(ka & kb), len((a | b) - ka - kb))
        assert r.distance == pytest.approx(cosine(z[r.state_id, r.observer_id_a], z[r.state_id, r.observer_id_b]), abs=1e-12)
    sizes = [len(x) for x in by_state(sit.seen(star).collect()).values()]
    assert len(rows) == sum(n * (n - 1) for n in sizes)
    assert examples.distance_against_asymmetry(star).count() * 2 == len(rows)


def test_features_form_no_pairs(star):
    df = design_space.situation_features(star)
    assert not formed(df)
    got = {r.situation_id: r for r in df.collect()}
    about, views = sit.about(star).collect(), sit.view_vectors(star).collect()
    uneven = dict(map(tuple, sit.asymmetric_pairs(sit.about(star)).collect()))
    for s, r in got.items():
        mine = [x for x in about if x.situation_id == s]
        assert (r.higher_order__n_pairs, r.higher_order__n_asymmetric) == (len(mine), uneven.get(s, 0))
        for name, of in (("mean_distance", "distance"), ("mean_only_focal", "only_a"), ("mean_only_target", "only_b"), ("mean_shared", "shared")):
            assert r[f"higher_order__{name}"] == pytest.approx(np.mean([x[of] for x in mine]) if mine else 0.0, abs=1e-12)
        z = np.array([x.z for x in views if x.situation_id == s])
        assert r.perspective__dispersion == pytest.approx(np.linalg.norm(z - z.mean(0), axis=1).mean() if len(z) > 1 else 0.0, abs=1e-12)
        known = [[{i.item_id for i in x["items"] if i.content_known} for x in rows] for rows in by_state(x for x in views if x.situation_id == s).values()]
        apart = [1 - len(a & b) / len(a | b) if a | b else 0.0 for sets in known for a, b in itertools.combinations(sets, 2)]
        assert (r.perspective__n_asymmetry_pairs, r.perspective__mean_asymmetry) == (len(apart), pytest.approx(np.mean(apart) if apart else 0.0))


def test_the_range_of_a_game_comes_in_blocks(spark, star):
    df = design_space.situation_features(star)
    stored = spark.createDataFrame(df.collect(), df.schema)
    games = design_space.game_features(stored)
    assert "z_a" not in games._jdf.queryExecution().analyzed().toString()
    rows = {}
    for r in stored.collect():
        rows.setdefault(r.game_id, []).append(np.array([r[x] for x in design_space.COLUMNS]))
    got = {r.game_id: r.region__range for r in games.collect()}
    assert got == {g: pytest.approx(max([np.linalg.norm(a - b) for a, b in itertools.combinations(z, 2)], default=0.0)) for g, z in rows.items()}


def test_view_summaries_tell_what_the_items_tell(spark, star):
    """Also where the rows of a space come in several batches."""
    col = sit.F.col
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {(r.state_id, r.observer_id): r for r in sit.view_summaries(star).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sit.seen(star).withColumn("z", sit.view_vector(col("items"))).collect()
    assert len(got) == len(want)
    for r in want:
        mine, ids = got[r.state_id, r.observer_id], [i.item_id for i in r["items"]]
        known = [i.item_id for i in r["items"] if i.content_known]
        assert (mine.copies, mine.placed, mine.n, mine.n_known, mine.z) == (r.copies, r.placed, len(ids), len(known), r.z)
        assert (set(mine.known), len(mine.known)) == (set(known), len(set(known)))
        assert (mine.same, mine.same_known) == (ids.count(ids[0]), known.count(ids[0]))


def test_view_summaries_of_views_without_items(spark):
    """A space without items or without a name, items without an id, two views of a space, an unknown that is null."""
    none = [spark.createDataFrame([], "situation_id string")] * 7
    items = spark.createDataFrame([("s", "i", 2, "x", None, False), ("s", "i", 1, "", "unknown_to_self", True), ("s", "j", 1, "y", "public", None), (None, None, 1, "lost", "public", True)], "situation_id string, information_space_id string, ord int, item_id string, visibility string, content_known boolean")
    items = items.selectExpr("*", "'a' AS about", "array('p') AS known_to", "'{}' AS payload", "'h' AS holder_id")
    views = spark.createDataFrame([("s", 1, "t", "p", "i"), ("s", 2, "t", "q", "i"), ("s", 3, "t", "r", "nothing"), ("s", 4, "t", "u", None), ("s", 5, "t", "v", "j"), ("s", 6, "t", "v", "i")], "situation_id string, ord int, state_id string, observer_id string, information_space_id string")
    s = sit.Situations(none[0], none[1], views, items, *none[2:])
    got = {r.observer_id: r for r in sit.view_summaries(s).collect()}
    assert {k: (r.copies, r.n, r.n_known, r.same, r.same_known, r.known) for k, r in got.items()} == {
        "p": (1, 2, 1, 1, 0, [""]), "q": (1, 2, 1, 1, 0, [""]), "r": (1, 0, 0, None, None, []), "u": (1, 0, 0, None, None, []), "v": (2, 1, 0, 1, 0, []),
    }
    assert {r.observer_id: r.z for r in sit.seen(s).select("observer_id", sit.view_vector(sit.F.col("items")).alias("z")).collect()} == {k: r.z for k, r in got.items()}


def test_state_sums_equal_the_views(spark, star):
    """Also where a state's rows come in several batches and its views go into several rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        frame = sit.state_sums(star, piece=3)
        assert not formed(frame)
        rows = frame.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    views = sit.view_summaries(star).collect()
    assert max(len(r.observers) for r in rows) == 3 and sorted((r.situation_id, o) for r in rows for o in r.observers) == sorted((v.situation_id, v.observer_id) for v in views)
    for s in {v.situation_id for v in views}:
        mine, own = [r for r in rows if r.situation_id == s], [v for v in views if v.situation_id == s]
        got = {x: sum(r[x] for r in mine) for x in frame.columns[1:15]}
        pairs = [(a, b) for group in by_state(own).values() for a, b in itertools.permutations(group, 2)]
        known = [(set(a.known), set(b.known)) for a, b in pairs]
        assert (got["copies"], got["volume"], got["hidden"]) == (len(own), sum(v.n for v in own), sum(v.n - v.n_known for v in own))
        assert (got["pairs"], got["only"], got["shared"]) == (len(pairs), sum(len(a - b) for a, b in known), sum(len(a & b) for a, b in known))
        assert got["uneven"] * 2 == sum((a.z, len(a.known)) != (b.z, len(b.known)) for a, b in pairs) and got["set_pairs"] * 2 == len(pairs)
        assert got["distance"] == pytest.approx(sum(cosine(a.z, b.z) for a, b in pairs), abs=1e-9)
        assert got["set_distance"] * 2 == pytest.approx(sum(1 - len(a & b) / len(a | b) for a, b in known if a | b), abs=1e-9)
        total = np.sum([r.total for r in mine if r.total], axis=0)
        assert total == pytest.approx(np.sum([v.z for v in own], axis=0)) and sum(len(r.z) for r in mine) == len(own) * sit.DIM


def test_state_sums_of_odd_views(spark):
    """Views told twice or without a place, a token that is null, a view without items, an observer that is null, a state of one."""
    none = [spark.createDataFrame([], "situation_id string")] * 7
    items = spark.createDataFrame([("s", "i", 1, "x", "public", True), ("s", "j", 1, "y", "public", None), ("s", "k", 1, None, "private", True)], "situation_id string, information_space_id string, ord int, item_id string, visibility string, content_known boolean")
    items = items.selectExpr("*", "'a' AS about", "array('p') AS known_to", "'{}' AS payload", "'h' AS holder_id")
    rows = [("s", 2, "t", "p", "j"), ("s", 1, "t", "p", "i"), ("s", None, "t", "q", "j"), ("s", 4, "t", "r", "nothing"), ("s", 5, "t", None, "i"), ("s", 6, "t", "v", "k"), ("s", 7, "u", "p", "i")]
    s = sit.Situations(none[0], none[1], spark.createDataFrame(rows, "situation_id string, ord int, state_id string, observer_id string, information_space_id string"), items, *none[2:])
    one, two = sorted(sit.state_sums(s).collect(), key=lambda r: r.copies, reverse=True)
    assert (one.copies, one.volume, one.hidden, one.changed, one.observers, one.times) == (5, 4, 1, 3, ["p", "q", "r", "v"], [2, 1, 1, 1])
    assert (one.set_pairs, one.set_distance, one.pairs, one.shared, one.only) == (6, 5.0, 12, 0, 6)  # p, p, r, v are placed
    z = np.array(one.z, float).reshape(4, sit.DIM)
    assert np.isnan(z[1, :12]).all() and not np.isnan(z[[0, 2, 3]]).any() and one.total == pytest.approx(np.nansum(z * [[2], [1], [1], [1]], axis=0))
    assert one.distance == pytest.approx(2 * cosine(z[0], z[3])) and one.uneven == 6
    assert (two.copies, two.pairs, two.distance, two.set_pairs, two.set_distance, two.uneven) == (1, 0, 0.0, 0, 0.0, 0)


def test_action_sets_come_as_a_stream(spark, star):
    """No list of a set's actions is formed; sets that go over several batches, an action taken twice, one without type and parameters."""
    acts = spark.createDataFrame([("s", "a1", "x", '{"b": 1, "a": 2}'), ("s", "a2", "y", '{"a": 1, "c": 1}'), ("s", "a3", None, None)], "situation_id string, action_id string, action_type string, parameters string")
    wanted = spark.createDataFrame([("s", "t1", ["a2", "a1", "a2"]), ("s", "t2", ["a3"])], "situation_id string, transition_id string, action_ids array<string>")
    df = sit.encoded_action_sets(dataclasses.replace(star, actions=acts), wanted)
    assert "collect_list" not in df._jdf.queryExecution().analyzed().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        one, two = sorted(df.collect(), key=lambda r: r.transition_id)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    tokens = ["type=y", "type=x", "type=y", "param_key=a", "param_key=c", "param_key=b", "n=3"]
    assert one.set_key == "a1\x1fa2\x1fa2" and one.z == [*[pytest.approx(sum(hashlib.sha256(t.encode()).digest()[i] / 127.5 - 1 for t in tokens) / 7) for i in range(12)], 3, 2, 3, 0]
    assert two.set_key == "a3" and two.z == [None] * 12 + [1, 1, 0, 0]


def test_features_hash_no_item_again(star):
    """The views are summed up once and written; nothing that follows reads items."""
    plan = design_space.situation_features(star)._jdf.queryExecution().analyzed().toString()
    assert "sha2" not in plan and "payload" not in plan


def test_options_of_spaces_need_no_join(star):
    """Options and spaces are counted in one shuffle."""
    plan = design_space._options_of_spaces(star)._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan
    got = {r.situation_id: (r.nd, r.no) for r in design_space._options_of_spaces(star).collect()}
    want = sit.options(star).groupBy("situation_id").agg(sit.F.count("*").alias("nd"), sit.F.sum("options").alias("no")).collect()
    assert got == {r.situation_id: (r.nd, r.no) for r in want}


def test_novelty_reads_no_events_for_its_training_situations(spark, tmp_path, monkeypatch):
    """The star is derived once per query, and what novelty compares with is written."""
    rows = [(i, f"2024-01-{1 + i % 9:02d} 0{i % 3}:10:00", i % 7, ("view", "click", "signup")[i % 3], float(i % 40), '{"k": 1}') for i in range(120)]
    spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    derived, star_of = [], play_queries.star
    monkeypatch.setattr(play_queries, "star", lambda *args: derived.append(args) or star_of(*args))
    df = play_queries.play_novelty_means(spark, str(tmp_path))
    assert len(derived) == 1 and "event_type" not in df._jdf.queryExecution().analyzed().toString()
    assert [(r.k, r.rows) for r in df.orderBy("k").collect()] == [(1, 9), (2, 9)]
