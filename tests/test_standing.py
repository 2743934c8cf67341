import random

import pytest
from pyspark.sql import functions as F

from structlens import storage
from structlens.operators import standing


@pytest.mark.parametrize("most", [10**6, 0])
@pytest.mark.parametrize("stored", [True, False])
def test_the_latest_row_of_every_key_stands(spark, tmp_path, monkeypatch, most, stored):
    monkeypatch.setattr(standing, "BROADCAST_KEYS", most)
    rng = random.Random(8)
    rows = [("hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randrange(300)}", rng.randrange(1000) if i % 7 else None, i, "clash", "clash") for i in range(900)]
    df = spark.createDataFrame(rows, "k string, at int, v int, _key string, _twice string").repartition(5)
    if stored:
        df.write.parquet(str(tmp_path / "t"))
        df = spark.read.parquet(str(tmp_path / "t"))
        assert standing.places(df)
    got = {r._key: r for r in standing.newest(df, F.col("k"), [F.col("at")], {"at": F.col("at"), "v": F.col("v")}).collect()}
    rank = lambda a: -1 if a is None else a
    assert set(got) == {k for k, *_ in rows}
    for key, r in got.items():
        assert rank(r["at"]) == max(rank(a) for k, a, *_ in rows if k == key)
        assert any((k, a, v) == (key, r["at"], r["v"]) for k, a, v, *_ in rows)


def test_no_key_twice_and_no_row(spark, tmp_path):
    spark.range(5).withColumn("v", F.col("id") * 2).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert standing.newest(df, F.col("id"), [F.col("v")], {"v": F.col("v")}).count() == 5
    assert standing.newest(df.where("id < 0"), F.col("id"), [F.col("v")], {"v": F.col("v")}).count() == 0


def test_written_tables_can_be_released_between_queries(spark):
    storage.release(spark)
    first, second = (storage.materialize(spark.range(n), "numbers") for n in (3, 4))
    assert storage.release(spark, keep=1) == 1 and second.count() == 4
    with pytest.raises(Exception):
        first.collect()
    assert storage.release(spark) == 1 and storage.release(spark) == 0
