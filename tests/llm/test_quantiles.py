import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from structlens.llm import quantiles
from structlens.llm.quantiles import Sketch

PERCENTS = (1, 10, 25, 50, 75, 90, 99)


def rank_gap(values, found, percent):
    """How far the wanted rank is from the ranks the found value has."""
    ordered = np.sort(values)
    want = max(1, -(-percent * len(values) // 100))
    low, high = np.searchsorted(ordered, found, "left") + 1, np.searchsorted(ordered, found, "right")
    return max(0, low - want, want - high)


def test_error_stays_within_the_stated_bound_for_any_order_and_merge():
    rng = np.random.default_rng(1)
    shapes = (rng.lognormal(size=200_000), np.sort(rng.normal(size=100_000)), np.sort(rng.normal(size=100_000))[::-1], np.repeat(np.arange(5.0), 30_000), np.concatenate([np.zeros(100_000), rng.random(50_000)]))
    for values in shapes:
        parts = []
        for piece in np.array_split(values, 13):
            s = Sketch(64, 4)
            for step in np.array_split(piece, 7):
                s.update(step)
            parts.append(s)
        while len(parts) > 1:
            a, b = parts.pop(), parts.pop(0)
            a.merge(b)
            parts.append(a)
        s = parts[0]
        assert s.n == len(values) and s.waiting + sum(64 * 4**k * len(b) for k, b in enumerate(s.buffers)) == s.n
        assert s.rank_error <= s.n * (1 + math.log(s.n / 64, 4)) / (2 * 64) + 13 * 64
        for p, found in zip(PERCENTS, s.percentiles(PERCENTS), strict=True):
            assert rank_gap(values, found, p) <= s.rank_error


def test_small_groups_are_exact_and_missing_values_counted(spark):
    rows = [("a", dt.date(2024, 1, d % 3 + 1), float(x) if x % 7 else None, x, "clash", 0) for d, x in enumerate(range(500))] + [(None, None, float("nan"), None, "", 0), ("only missing", None, None, None, "", 0)]
    df = spark.createDataFrame(rows, "k string, d date, v double, w int, column_name string, n int").repartition(5)
    got = quantiles.percentiles(quantiles.merge(quantiles.build(df, ["k", "d"], ["v", "w"]), ["k", "d"]), ["k", "d"], PERCENTS).collect()
    by = {(r.k, r.d, r.column_name, r.percent): r for r in got}
    assert len(by) == 5 * 2 * len(PERCENTS)
    for d in range(3):
        values = sorted(float(x) for i, x in enumerate(range(500)) if i % 3 == d and x % 7)
        for p in PERCENTS:
            r = by["a", dt.date(2024, 1, d + 1), "v", p]
            assert r.value == values[max(1, -(-p * len(values) // 100)) - 1] and r.rank_error == 0 and r.n == len(values)
    assert by[None, None, "v", 50].missing == 1 and by["only missing", None, "w", 50].value is None


def test_unions_from_kept_sketches_hold_their_bound(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.gauss(0, 1)) for _ in range(60_000)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(6)
    kept = quantiles.merge(quantiles.build(df, ["k"], ["v"], 64, 4), ["k"], 64, 4)
    union = kept.withColumn("all", F.lit(1))
    got = quantiles.percentiles(quantiles.merge(union, ["all"], 64, 4), ["all"], PERCENTS, 64, 4).collect()
    values = np.array([v for _, v in rows])
    assert {r.n for r in got} == {60_000} and 0 < got[0].rank_error < 60_000 * 0.08
    for r in got:
        assert rank_gap(values, r.value, r.percent) <= r.rank_error


def test_tasks_hand_sketches_on_when_they_hold_too_much(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "HELD_VALUES", 100)
    df = spark.range(5000).selectExpr("id % 50 AS k", "cast(id AS double) AS v")
    got = quantiles.percentiles(quantiles.merge(quantiles.build(df, ["k"], ["v"]), ["k"]), ["k"], [50]).collect()
    assert {(r.k, r.value) for r in got} == {(k, k + 50.0 * 49) for k in range(50)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert quantiles.percentiles(quantiles.merge(quantiles.build(df, ["k"], ["v"]), ["k"]), ["k"], [50]).count() == 0
