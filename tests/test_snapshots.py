import datetime as dt
import random

from pyspark.sql import functions as F

from structlens.operators import snapshots

SCHEMA = "snapshot_id int, id string, rating double, rating_count int, at timestamp, delivered timestamp, key string, _snap int"


def changes(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    values = {"rating": snapshots.missing_as_null(F.col("rating"), "double"), "rating_count": F.col("rating_count")}
    out = snapshots.snapshot_changes(df, "snapshot_id", snapshots.clean_key("id"), values, [F.col("at"), F.col("delivered")], **kw)
    return {(r.snapshot_id, r.key, r.change_kind) for r in out.collect()}


def brute(rows):
    best = {}
    low = dt.datetime.min
    for s, i, rating, n, at, late in rows:
        key = (i or "").strip().lower()
        if s is None or not key:
            continue
        rating = None if rating is not None and rating != rating else rating
        rank = (at or low, late or low, -1e9 if rating is None else rating, -1 if n is None else n)
        if (s, key) not in best or rank > best[s, key][0]:
            best[s, key] = (rank, (rating, n))
    ids = sorted({s for s, _ in best})
    out = set()
    for before, now in zip(ids, ids[1:], strict=False):
        a = {k: v[1] for (s, k), v in best.items() if s == before}
        b = {k: v[1] for (s, k), v in best.items() if s == now}
        out |= {(now, k, "added") for k in b.keys() - a.keys()} | {(now, k, "removed") for k in a.keys() - b.keys()}
        out |= {(now, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


def test_matches_brute_force_on_dirty_rows(spark):
    rng = random.Random(3)
    day = dt.datetime(2024, 1, 1)
    rows = []
    for s in (1, 2, 5, 9):
        for g in range(300):
            if rng.random() < 0.9:
                for _ in range(rng.choice((1, 1, 2, 40 if g == 7 else 1))):
                    at = None if rng.random() < 0.1 else day + dt.timedelta(days=rng.randrange(50))
                    ident = rng.choice((f"bgg-{g}", f" BGG-{g}\t"))
                    rows.append((s, ident, rng.choice((1.0, 2.0, None, float("nan"))), rng.choice((None, 0, 3)), at, day + dt.timedelta(seconds=rng.randrange(10**6))))
    expected = brute(rows)
    for chunk, buckets in ((64, None), (1, 3), (10**6, 1)):
        assert changes(spark, rows, mean_chunk=chunk, buckets=buckets) == expected


def test_null_keys_empty_tables_and_single_snapshots(spark):
    t = dt.datetime(2024, 1, 1)
    assert changes(spark, []) == set()
    assert changes(spark, [(1, "a", 1.0, 1, t, t)]) == set()
    blank = [(1, None, 1.0, 1, t, t), (1, "  ", 1.0, 1, t, t), (None, "a", 1.0, 1, t, t)]
    assert changes(spark, blank) == set()
    assert changes(spark, [*blank, (2, "b", 1.0, 1, t, t)]) == {(2, "b", "added")}
    assert changes(spark, [(2, "b" * 100_000, None, None, None, None), (4, "c", 1.0, 1, t, t)]) == {(4, "b" * 100_000, "removed"), (4, "c", "added")}


def test_equal_rows_and_missing_values_are_no_change(spark):
    t = dt.datetime(2024, 1, 1)
    assert changes(spark, [(1, "a", None, None, t, t), (1, "a", None, None, t, t), (2, "A ", float("nan"), None, t, t)]) == set()


def test_chunk_digests_set_most_rows_aside(spark):
    rows = spark.range(0, 4000).selectExpr("id % 2 AS snapshot_id", "concat('g', cast(floor(id / 2) AS string)) AS id", "1.0D AS rating", "IF(id = 1001, 9, 1) AS rating_count")
    report = {r.snapshot_id: r for r in snapshots.chunk_report(rows, "snapshot_id", F.col("id"), {"rating": F.col("rating"), "rating_count": F.col("rating_count")}, [F.lit(1)], 32, 4).collect()}
    assert report[0].rows == report[1].rows == 2000
    assert report[1].chunks - report[1].chunks_set_aside == 1 and report[1].rows_set_aside > 1500
