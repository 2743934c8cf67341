import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from structlens.functions import columns as c
from structlens.operators import catalog, geometry, quality, stats


def average_ranks(values):
    order = sorted(values)
    return [sum(i + 1 for i, v in enumerate(order) if v == x) / order.count(x) for x in values]


def rho(pairs):
    pairs = [(x, y) for x, y in pairs if x is not None and y is not None]
    if len(pairs) < 8:
        return None
    a, b = average_ranks([p[0] for p in pairs]), average_ranks([p[1] for p in pairs])
    if len(set(a)) == 1 or len(set(b)) == 1:
        return None
    return float(np.corrcoef(a, b)[0, 1])


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(6)
    out = {"many": [(rng.choice((None, 1.0, 2.0, 3.0, -4.0)), rng.choice((None, 0.5, 1.5, 9.0))) for _ in range(60)], "seven": [(float(i), float(i)) for i in range(7)], "eight": [(float(i), float(-i)) for i in range(8)], "flat": [(1.0, float(i)) for i in range(9)]}
    out["nine"] = [(float(i), float(i % 4)) for i in range(9)]
    return out


def test_rank_correlation_and_its_limits(spark, pairs):
    df = spark.createDataFrame([(g, x, y, "clash") for g, rows in pairs.items() for x, y in rows], "grid string, x double, y double, n string")
    got = {r.grid: (r.n, r.rho) for r in stats.spearman(df).collect()}
    for grid, rows in pairs.items():
        expected = rho(rows)
        assert got[grid][0] == sum(x is not None and y is not None for x, y in rows)
        assert got[grid][1] is None if expected is None else got[grid][1] == pytest.approx(expected)


def test_leaving_one_out_equals_leaving_it_out(spark, pairs):
    df = spark.createDataFrame([(g, x, y) for g, rows in pairs.items() for x, y in rows], "grid string, x double, y double")
    cases = df.where("x IS NOT NULL AND y IS NOT NULL").distinct()
    got = {(r.grid, r.x, r.y): (r.n, r.rho) for r in stats.spearman_without(df, cases).collect()}
    seen = 0
    for grid, rows in pairs.items():
        for x, y in {p for p in rows if None not in p}:
            rest = list(rows)
            rest.remove((x, y))
            expected = rho(rest)
            assert got[grid, x, y][1] is None if expected is None else got[grid, x, y][1] == pytest.approx(expected), (grid, x, y)
            seen += 1
    assert seen == len(got)


def test_boxes_hold_for_none_one_and_several(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", None), ("b", 5.0)], "g string, v double")
    rows = {r.g: r for r in stats.boxes_by_group(df, "g", ["a", "b", "c"], ["v"]).collect()}
    assert (rows["a"].n, rows["a"].n_missing, rows["a"].q1, rows["a"].median, rows["a"].q3) == (3, 1, 1.5, 2.0, 3.0)
    assert rows["b"].stdev == 0.0 and rows["c"].n == 0 and rows["c"].median is None and rows["overall"].n == 4
    assert rows["a"].stdev == pytest.approx(np.std([1, 2, 4], ddof=1), abs=1e-6)


def test_prevalence_counts_writings_and_lift_counts_holders(spark):
    rows = [(f"g{i}", i, "two_only" if i < 3 else "unknown" if i > 9 else "five_plus", ["A", "A"] if i < 5 else ["B"]) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, row_seq int, profile string, names array<string>")
    found = {r.name: r.occurrences for r in stats.prevalence(df, "id", "row_seq", "names").collect()}
    assert found == {"A": 10, "B": 7}
    lifts = {(r.name, r.profile): r for r in stats.profile_lifts(df, "id", "names", "profile", ["two_only", "upto_four", "five_plus"], "unknown", 5).collect()}
    assert lifts["A", "two_only"].holders == 5 and lifts["A", "two_only"].lift == 2.0 and lifts["A", "upto_four"].lift is None
    assert ("B", "two_only") in lifts and stats.profile_lifts(df, "id", "names", "profile", ["two_only"], "unknown", 6).count() == 0
    assert [r.name for r in stats.top_labels(df, "id", "row_seq", "names", 1).collect()] == ["A"]


def test_ties_in_label_counts_go_by_first_appearance(spark):
    df = spark.createDataFrame([("b", 2, ["Z"]), ("a", 1, ["Y", "X"])], "id string, row_seq int, names array<string>")
    assert [r.name for r in stats.top_labels(df, "id", "row_seq", "names").collect()] == ["Y", "X", "Z"]


def test_scalar_derivations(spark):
    df = spark.createDataFrame([(2, 2), (2, 5), (1, 4), (None, 4)], "a int, b int")
    assert [r[0] for r in df.select(c.interval_profile(F.col("a"), F.col("b"))).collect()] == ["two_only", "five_plus", "upto_four", "unknown"]
    assert [r[0] for r in df.select(c.interval_kind(F.col("a"), F.col("b"))).collect()] == ["point", "range", "range", "unknown"]
    years = spark.createDataFrame([(1969,), (1970,), (1994,), (1995,), (2009,), (2010,), (2016,), (2017,), (None,)], "y int")
    assert [r[0] for r in years.select(c.era(F.col("y"))).collect()] == ["pre_1970", "1970_1994", "1970_1994", "1995_2009", "1995_2009", "2010_2016", "2010_2016", "2017_plus", "unknown"]
    texts = spark.createDataFrame([("0",), (" 7 ",), ("",), ("x",), (None,)], "t string")
    assert [(r[0], r[1]) for r in texts.select(c.whole_or_null(F.col("t")), c.whole_or_null(F.col("t"), True)).collect()] == [(None, 0), (7, 7), (None, None), (None, None), (None, None)]
    sets = spark.createDataFrame([([], []), (["a"], ["a"]), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [round(r[0], 6) for r in sets.select(c.jaccard_distance(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.666667]
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert zero.select(c.cosine_distance(F.col("a"), F.col("b"))).first()[0] is None


def test_extremes_at_the_limit_are_flagged_and_kept(spark):
    df = spark.createDataFrame([("a", 12, 20, 300), ("b", 11, 19, 299), ("c", None, None, None)], "id string, max_players int, player_span int, max_play_time_minutes int")
    assert [(r.id, r.reason) for r in quality.extreme_rows(df).collect()] == [("a", "max_players=12; player_span=20; max_play_time_minutes=300")]
    assert [r.id for r in df.where("max_players <= 12").collect()] == ["a", "b"]


def test_current_catalog_takes_the_latest_row(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/games.parquet")
    full = catalog.current_catalog(df)
    assert full.count() == df.select("id").distinct().count() and set(catalog.current_catalog(df, ["title"]).columns) == {"id", "row_seq", "title"}
    assert catalog.analytic_rows(catalog.current_catalog(df, ["title"])).columns == ["id", "row_seq", "title"]
    assert catalog.current_catalog(df.limit(0)).count() == 0


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_blockwise_neighbours_equal_a_full_search(spark, monkeypatch, metric):
    rng = np.random.default_rng(3)
    points = np.round(3 * rng.normal(size=(70, 3))) + (20 if metric == "cosine" else 0)  # whole numbers make exact ties
    monkeypatch.setattr(geometry, "BLOCK_ROWS", 16)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, v array<double>")
    got = {(r.id, r["rank"]): (r.other, r.distance) for r in geometry.nearest(df, df, "id", "v", 4, metric).collect()}
    assert len(got) == 70 * 4
    for i, p in enumerate(points):
        def gap(j, p=p):
            q = points[j]
            return math.sqrt(((p - q) ** 2).sum()) if metric == "l2" else 1 - p @ q / np.linalg.norm(p) / np.linalg.norm(q)

        near = sorted((round(gap(j), 9), j) for j in range(70) if j != i)[:4]
        assert [round(got[i, k + 1][1], 9) for k in range(4)] == pytest.approx([g for g, _ in near], abs=1e-8)
        if metric == "l2":
            assert [got[i, k + 1][0] for k in range(4)] == [j for _, j in near]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_lowest_keys_win_among_many_copies(spark, metric):
    points = [(5.0, 1.0) if i % 3 else (float(i), float(i * i + 1)) for i in range(900)]  # 600 copies in one block
    df = spark.createDataFrame([(i, list(p)) for i, p in enumerate(points)], "id bigint, v array<double>").repartition(3)
    got = {(r.id, r["rank"]): (r.other, r.distance) for r in geometry.nearest(df, df, "id", "v", 3, metric).collect()}
    assert len(got) == 900 * 3
    copies = [i for i in range(900) if i % 3]
    for i in copies:
        assert [got[i, k][0] for k in (1, 2, 3)] == [j for j in copies if j != i][:3]


def test_neighbours_far_from_the_origin_are_exact(spark, monkeypatch):
    monkeypatch.setattr(geometry, "EXACT_CELLS", 300)
    points = 1e9 + np.random.default_rng(4).integers(0, 30, size=(200, 3)).astype(float)  # gaps below the rounding of the squares
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, v array<double>")
    got = {(r.id, r["rank"]): (r.distance, r.other) for r in geometry.nearest(df, df, "id", "v", 3).collect()}
    for i, p in enumerate(points):
        near = sorted((math.sqrt(((p - q) ** 2).sum()), j) for j, q in enumerate(points) if j != i)[:3]
        assert [got[i, k] for k in (1, 2, 3)] == near


def test_novelty_leaves_out_k_beyond_the_train_size(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "id bigint, v array<double>")
    rows = {(r.id, r.k): r.novelty for r in geometry.novelty(df, df.where("id < 3"), "id", "v", [1, 2, 3]).collect()}
    assert rows[4, 1] == 2 and rows[4, 2] == 2.5 and rows[0, 1] == 1 and (0, 3) not in rows
    with pytest.raises(ValueError):
        geometry.novelty(df, df.where("id < 1"), "id", "v", [1])


def test_kmeans_repeats_itself_and_breaks_ties_low(spark):
    df = spark.createDataFrame([(i, [float(x), 0.0]) for i, x in enumerate((0, 1, 2, 10, 11, 12))], "id bigint, v array<double>")
    first = sorted((r.id, r.cluster) for r in geometry.kmeans(df, "id", "v", 2).collect())
    assert first == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1)] == sorted((r.id, r.cluster) for r in geometry.kmeans(df.repartition(3), "id", "v", 2).collect())
    tied = geometry.assign(spark.createDataFrame([(0, [1.0])], "id bigint, v array<double>"), "id", "v", [[0.0], [2.0]])
    assert tied.first().cluster == 0


def test_scaling_keeps_constant_columns_finite(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>")
    fitted = geometry.moments(df, "v")
    assert [r.v for r in geometry.standardize(df, "v", fitted).collect()] == [[-1.0, 0.0], [1.0, 0.0]]
    assert [r.idx for r in geometry.leading_components(fitted, 1).collect()] == [0]
