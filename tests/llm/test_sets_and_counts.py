import itertools
import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from structlens.llm import cooccurrence, queries, similar_sets, term_frequency

SCHEMA = "id string, items array<string>, item string, n int, tokens string"


def frame(spark, sets):
    return spark.createDataFrame([(i, s, "clash", 0, "clash") for i, s in sets], SCHEMA)


def random_sets(n, seed, vocabulary=40, hot=True):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice((0, 1, 5, 6, 7, 10, 25))
        s = [f"t{min(int(rng.expovariate(0.1)), vocabulary)}" for _ in range(size)]
        if hot and rng.random() < 0.34:
            s = [f"h{k}" for k in range(6)] + s[: rng.randrange(3)]
        out.append((f"r{i}", s + s[:1] + [None] * (i % 2)))
    return out


@pytest.mark.parametrize("lift", [None, 2])
def test_pairs_match_brute_force(spark, lift):
    sets = random_sets(400, 1) + [("n", None)]
    got = {(r.item_a, r.item_b): r for r in cooccurrence.cooccurrence(frame(spark, sets), "id", "items", 5, lift).collect()}
    clean = [sorted({x for x in s or () if x is not None}) for _, s in sets]
    single, joint = Counter(x for s in clean for x in s), Counter(p for s in clean for p in itertools.combinations(s, 2))
    n = len(sets)
    expected = {p: k for p, k in joint.items() if k >= 5 and (lift is None or k * n >= lift * single[p[0]] * single[p[1]])}
    assert {p: r.joint for p, r in got.items()} == expected
    for (a, b), r in got.items():
        assert (r.count_a, r.count_b, r.records) == (single[a], single[b], n)
        k = [[r.joint, single[a] - r.joint], [single[b] - r.joint, n - single[a] - single[b] + r.joint]]
        g = 2 * sum(k[i][j] * math.log(k[i][j] * n / (sum(k[i]) * (k[0][j] + k[1][j]))) for i in (0, 1) for j in (0, 1) if k[i][j])
        assert r.llr == pytest.approx(max(0, g), abs=1e-6)


def test_stripes_of_hot_items_are_split_and_merged_in_blocks(spark, monkeypatch):
    sets = random_sets(300, 2)
    whole = {tuple(r) for r in cooccurrence.cooccurrence(frame(spark, sets), "id", "items", 2).collect()}
    monkeypatch.setattr(cooccurrence, "SPLIT_RECORDS", 20)
    assert {tuple(r) for r in cooccurrence.cooccurrence(frame(spark, sets), "id", "items", 2).collect()} == whole


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert cooccurrence.cooccurrence(empty, "id", "items").count() == 0
    assert similar_sets.similar_pairs(empty, "id", "items").count() == 0
    assert similar_sets.similarity_classes(empty, "id", "items").count() == 0
    assert term_frequency.run_frequencies(empty.select(F.array("items").alias("s")), "s", True).count() == 0


def jaccard_pairs(sets, t, least):
    clean = {i: frozenset(x for x in s or () if x is not None) for i, s in sets if i is not None}
    kept = {i: s for i, s in clean.items() if len(s) >= least}
    return {(min(a, b), max(a, b)) for a, b in itertools.combinations(kept, 2) if len(kept[a] & kept[b]) >= t * len(kept[a] | kept[b])}


@pytest.mark.parametrize("hot,least,t", [(1, 5, Fraction(4, 5)), (4, 5, Fraction(4, 5)), (10**6, 5, Fraction(4, 5)), (2, 1, Fraction(1, 2)), (2, 3, Fraction(9, 10))])
def test_similar_pairs_match_brute_force_at_every_level(spark, hot, least, t):
    sets = random_sets(250, 5, vocabulary=15) + [(None, ["a", "b", "c", "d", "e"]), ("long", [f"t{i}" for i in range(900)]), ("long2", [f"t{i}" for i in range(890)])]
    got = similar_sets.similar_pairs(frame(spark, sets), "id", "items", t, least, hot=hot).collect()
    assert len(got) == len({(r.id_a, r.id_b) for r in got})
    assert {(r.id_a, r.id_b) for r in got} == jaccard_pairs(sets, t, least)


def test_groups_are_compared_in_small_batches_too(spark, monkeypatch):
    sets = random_sets(250, 9, vocabulary=15)
    monkeypatch.setattr(similar_sets, "BLOCK_PAIRS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got = similar_sets.similar_pairs(frame(spark, sets), "id", "items", Fraction(4, 5), 5, hot=20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.id_a, r.id_b) for r in got} == jaccard_pairs(sets, Fraction(4, 5), 5)


def test_classes_count_every_link_without_listing_copies(spark):
    copies = [(f"c{i:03}", ["a", "b", "c", "d", "e"]) for i in range(200)] + [("x", ["a", "b", "c", "d", "e", "f"]), ("y", ["q", "r", "s", "t", "u"]), ("y", ["q", "r", "s", "t", "u"])]
    got = {r.record_key: (r.class_key, r.class_size, r.links) for r in similar_sets.similarity_classes(frame(spark, copies), "id", "items").collect()}
    assert got["c005"] == ("c000", 200, 200) and got["x"] == ("x", 1, 200) and got["y"] == ("y", 1, 0)


def test_term_frequencies_match_brute_force(spark):
    rng = random.Random(4)
    records = [[[rng.choice("aab") * rng.choice((1, 1, 2)) for _ in range(rng.randrange(6))] for _ in range(rng.randrange(3))] for _ in range(200)] + [None, [None, ["z", None, "z"]], [["w" * 50_000]]]
    df = spark.createDataFrame([(r, "clash") for r in records], "s array<array<string>>, t1 string")
    got = {tuple(r.gram): (r.occurrences, r.records) for r in term_frequency.run_frequencies(df, "s").collect()}
    times, holds = Counter(), Counter()
    for record in records:
        grams = []
        for s in record or ():
            s = [x for x in s or () if x is not None]
            grams += [tuple(s[i : i + n]) for n in range(1, len(s) + 1) for i in range(len(s) - n + 1)]
        times.update(grams)
        holds.update(set(grams))
    assert got == {g: (times[g], holds[g]) for g in times}


def test_runs_of_any_length_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(term_frequency, "BLOCK_TERMS", 50)
    monkeypatch.setattr(term_frequency, "BATCH_TERMS", 20)
    rng = random.Random(6)
    records = [[[rng.choice("aab") for _ in range(rng.randrange(9))] for _ in range(rng.randrange(3))] for _ in range(150)] + [None, [None, ["z", None, "z"]], [[f"w{i}" for i in range(30)]] * 2]
    df = spark.createDataFrame([(r,) for r in records], "s array<array<string>>").repartition(3)
    rows = term_frequency.run_frequencies(df, "s").collect()
    times, holds = Counter(), Counter()
    for record in records:
        clean = [[x for x in s or () if x is not None] for s in record or ()]
        grams = [tuple(s[i:j]) for s in clean for i in range(len(s)) for j in range(i + 1, len(s) + 1)]
        times.update(grams)
        holds.update(set(grams))
    assert max(r.n for r in rows) == 30 and all(r.n == len(r.gram) for r in rows)
    assert len(rows) == len(times) and {tuple(r.gram): (r.occurrences, r.records) for r in rows} == {g: (times[g], holds[g]) for g in times}
    assert term_frequency.run_frequencies(df.limit(0), "s").count() == 0


def test_complete_sequences_are_counted_apart_from_runs_inside_others(spark):
    records = [[["a", "b"], ["a", "b"], ["a"]], [["a", "b", "c"], None, []], [["b"], ["a", "b"]], [["b", None]]]
    df = spark.createDataFrame([(r,) for r in records], "s array<array<string>>").repartition(2)
    got = {tuple(r.gram): (r.n, r.occurrences, r.records) for r in term_frequency.run_frequencies(df, "s", complete=True).collect()}
    assert got == {("a", "b"): (2, 3, 2), ("a",): (1, 1, 1), ("a", "b", "c"): (3, 1, 1), ("b",): (1, 2, 2)}


def test_words_of_long_label_names_are_counted_whole(spark, tmp_path):
    game = ("g1", "2024-01-01 00:00:00", [("1", "Hidden Roles At The Table")], ["Card"])
    schema = "id string, loaded_at string, mechanics array<struct<id: string, name: string>>, categories array<string>"
    spark.createDataFrame([game], schema).withColumn("loaded_at", F.col("loaded_at").cast("timestamp_ntz")).withColumn("row_seq", F.lit(1)).write.parquet(str(tmp_path / "games.parquet"))
    got = {r.words: (r.n, r.occurrences, r.games) for r in queries.p7_word_runs_whole(spark, str(tmp_path)).collect()}
    assert got["hidden roles at the table"] == (5, 1, 1) and got["roles at the table"] == (4, 1, 1) and len(got) == 16
