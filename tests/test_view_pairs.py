"""Pairs of the views of a state, listed in blocks, held against the views taken two by two."""

import itertools
import random

import numpy as np
import pytest

from structlens.operators import examples
from structlens.operators import situations as sit
from structlens.plans import play_queries


@pytest.fixture(scope="module")
def star(spark):
    """States of up to nine observers; views told twice, without items or of an unnamed space; about, holder, token and ids that are null; names that run into each other."""
    rng, none = random.Random(7), [spark.createDataFrame([], "situation_id string")] * 7
    items = [("s", f"i{rng.randrange(12)}", n, rng.choice(("x", "y")), rng.choice(("public", "unknown_to_self")), rng.choice((True, True, None, False)), rng.choice((None, "", "1:a", "a", "a/=h")), rng.choice((None, "", "h", "a"))) for n in range(60)]
    items += [("s", "odd", 99, "x", "public", True, "a", "h"), (None, "i1", 1, "x", "public", True, "a", "h"), ("s", None, 1, "x", "public", True, "a", "h")]
    items = spark.createDataFrame(items, "situation_id string, information_space_id string, ord int, item_id string, visibility string, content_known boolean, about string, holder_id string").selectExpr("*", "array('p') AS known_to", "if(information_space_id = 'odd', '{\"k\": 1}', '{}') AS payload")
    views = [("s", n, f"t{n % 5}", rng.choice((*map(str, range(9)), "10", None)), f"i{rng.randrange(14)}") for n in range(50)]
    views += [("s", 100, "t1", "z", "odd"), ("s", 101, "t1", "zz", None), ("s", None, "t1", "zzz", "i1"), ("s", 102, None, "z", "i1"), ("s", 103, None, "y", "i1"), (None, 104, "t1", "z", "i1"), (None, 105, "t1", "y", "i1"), ("s", 106, "alone", "z", "i1")]
    return sit.Situations(none[0], none[1], spark.createDataFrame(views, "situation_id string, ord int, state_id string, observer_id string, information_space_id string"), items, *none[2:])


def test_pairs_are_listed_without_a_join_of_views(star):
    """No list of a view's items is formed, no view is copied beside another."""
    plan = examples.distance_against_asymmetry(star)._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("piece", [1, 7, sit.PAIRS])
def test_view_pairs_equal_the_views_two_by_two(spark, star, monkeypatch, piece):
    """Also where a state's rows come in several batches and its pairs go into several blocks."""
    seen = sit.seen(star).select("situation_id", "state_id", "observer_id", sit.view_vector(sit.F.col("items")).alias("z"), sit.known_keys(sit.F.col("items")).alias("k")).collect()
    want = {}
    for a, b in itertools.permutations([r for r in seen if None not in r[:3]], 2):
        if a[:2] == b[:2] and a.observer_id < b.observer_id:
            lost, (x, y) = None in [*a.z, *b.z], (set(map(tuple, r.k)) for r in (a, b))
            scale = 0.0 if lost else np.linalg.norm(a.z) * np.linalg.norm(b.z)
            want[*a[:3], b.observer_id] = (pytest.approx(1 - np.dot(a.z, b.z) / scale if scale else 0.0, abs=1e-12), pytest.approx(1 - len(x & y) / len(x | y) if x | y else 0.0, abs=1e-12))
    plain = sit.view_pairs
    monkeypatch.setattr(sit, "view_pairs", lambda s, member, dim: plain(s, member, dim, piece))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = examples.distance_against_asymmetry(star).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r.situation_id, r.state_id, r.a, r.b): (r.distance, r.asymmetry) for r in rows}
    assert len(rows) == len(got) > 100 and got == want
    assert {round(x, 3) for _, x in got.values()} > {0.0, 1.0}


def test_a_view_without_items_is_no_distance_away(star):
    got = [r.distance for r in examples.distance_against_asymmetry(star).where("state_id = 't1' AND b = 'zz'").collect()]
    assert got and set(got) == {0.0}


def test_key_texts_tell_keys_apart(spark):
    keys = [("a", None), (None, "a"), ("a", ""), ("", "a"), (None, None), ("", ""), ("", None), (None, ""), ("a/=h", None), ("a", "h")]
    rows = spark.createDataFrame(keys, "about string, holder_id string").select(sit.key_text().alias("x")).collect()
    assert None not in {r.x for r in rows} and len({r.x for r in rows}) == len(keys)


def test_about_is_listed_without_a_join_of_views(star):
    plan = sit.about_figures(star)._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("piece", [1, 7, sit.PAIRS])
def test_pairs_both_ways_equal_the_joined_views(spark, star, monkeypatch, piece):
    """Ids that are null or known of one item and not of another, also where a state's rows come in several batches and its pairs go into several blocks."""
    want = {tuple(r[:4]): (*r[4:8], pytest.approx(r.distance, abs=1e-12)) for r in sit.about_counts(star).select("situation_id", "state_id", "observer_id_a", "observer_id_b", "only_a", "only_b", "shared", "hidden_both", "distance").collect()}
    plain = sit.view_pairs
    monkeypatch.setattr(sit, "view_pairs", lambda s, member, dim, ordered: plain(s, member, dim, piece, ordered))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = sit.about_figures(star).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {(r.situation_id, r.state_id, r.observer_id_a, r.observer_id_b): (r.only_a, r.only_b, r.shared, r.hidden_both, r.distance) for r in rows}
    assert len(rows) == len(got) > 200 and got == want
    assert max(r.hidden_both for r in rows) > 1 and max(r.shared for r in rows) > 0


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Users with several events in a state, known and not, and states of one user."""
    rng = random.Random(9)
    rows = [(i, f"2024-01-0{rng.choice((1, 2))} 0{rng.choice((1, 9))}:{rng.choice((10, 20))}:00", rng.randrange(14), rng.choice(("view", "click", "signup", "error", "purchase")), 1.0, '{"k": 1}') for i in range(170)]
    rows.append((999, "2024-01-03 05:00:00", 3, "view", 1.0, '{"k": 1}'))
    folder = tmp_path_factory.mktemp("pairs")
    spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def shuffles(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Repartition"), plan.count("Aggregate") + plan.count("Join")


def test_about_shuffles_items_and_views_once(spark, events):
    df = play_queries.play_about(spark, events)
    assert shuffles(df) == (1, 0)
    want = {tuple(r[:3]): (*r[3:7], pytest.approx(r.distance, abs=2e-6)) for r in sit.about_counts(play_queries.star(spark, events)).select("state_id", "observer_id_a", "observer_id_b", "only_a", "only_b", "shared", "hidden_both", "distance").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len(want) > 500 and {tuple(r[:3]): (r.only_a, r.only_b, r.shared, r.hidden_both, r.distance) for r in rows} == want
    assert {r.width for r in rows} == {53}


def test_distances_and_asymmetries_shuffle_items_and_views_once(spark, events):
    df = play_queries.play_distance_asymmetry(spark, events)
    assert shuffles(df) == (1, 0)
    want = {tuple(r[:4]): tuple(pytest.approx(x, abs=2e-6) for x in r[4:]) for r in examples.distance_against_asymmetry(play_queries.star(spark, events)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == len(want) > 250 and {tuple(r[:4]): tuple(r[4:]) for r in rows} == want


def test_the_star_for_pairs_tells_the_same_views_and_items(spark, events):
    plain, s = play_queries.star(spark, events), play_queries.pair_star(spark, events)
    assert set(map(tuple, s.observations.collect())) == set(map(tuple, plain.observations.collect()))
    states = {r.information_space_id: r.state_id for r in plain.observations.collect()}
    items = [r.asDict() for r in s.info_items.collect()]
    assert all(states[r["information_space_id"]] == r.pop("state_id") for r in items)
    assert sorted(map(str, items)) == sorted(str(r.asDict()) for r in plain.info_items.collect())


def test_pairs_of_odd_views_with_items_that_tell_their_state(spark):
    """Views told twice with different places, of a space without items or without a name, items of no state; a state of one, an observer that is null."""
    none = [spark.createDataFrame([], "situation_id string")] * 7
    items = spark.createDataFrame([("s", "t", "i", 1, "x", True), ("s", "t", "i", 2, None, False), ("s", "t", "j", 1, "x", None), ("s", "t", "k", 1, "y", True), (None, "t", "i", 1, "z", True), ("s", None, "i", 1, "z", True), ("s", "u", "l", 1, "x", True)], "situation_id string, state_id string, information_space_id string, ord int, item_id string, content_known boolean")
    items = items.selectExpr("*", "'public' AS visibility", "'a' AS about", "array('p') AS known_to", "'{}' AS payload", "'h' AS holder_id")
    views = [("s", 2, "t", "p", "k"), ("s", 1, "t", "p", "i"), ("s", 1, "t", "p", "i"), ("s", 3, "t", "q", "j"), ("s", 9, "t", "q", "i"), ("s", None, "t", "q", "k"), ("s", 4, "t", "r", "nothing"), ("s", 5, "t", "u", None), ("s", 6, "t", None, "i"), ("s", 7, None, "w", "i"), ("s", 8, "u", "w", "l")]
    s = sit.Situations(none[0], none[1], spark.createDataFrame(views, "situation_id string, ord int, state_id string, observer_id string, information_space_id string"), items, *none[2:])
    loose = sit.Situations(*[getattr(s, x) for x in ("situations", "states", "observations")], items.where("state_id IS NOT NULL").drop("state_id"), *none[2:])
    for figures in (sit.about_figures, examples.distance_against_asymmetry):
        got, want = (sorted(map(tuple, figures(x).collect())) for x in (s, loose))
        assert got == want and len(got) == (12 if figures is sit.about_figures else 6)
