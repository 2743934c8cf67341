import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from structlens.llm import mixing, packing, tokens


def check_plan(histogram, capacity):
    plan = packing.make_plan(histogram, capacity)
    fills = Counter()
    for k, (size, start, container) in enumerate(zip(plan.sizes, plan.starts, plan.containers, strict=True)):
        following = plan.starts[k + 1] if k + 1 < len(plan.sizes) and plan.sizes[k + 1] == size else histogram[size]
        for r in range(following - start):
            fills[int(container + r)] += int(size)
    assert sum(fills.values()) == sum(s * n for s, n in histogram.items())
    assert not fills or max(fills.values()) <= capacity
    assert set(fills) == set(range(plan.count))
    return plan


def test_plan_places_every_item_once_within_capacity():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.randrange(1, 60)
        check_plan({rng.randrange(1, capacity + 1): rng.randrange(1, 9) for _ in range(rng.randrange(1, 20))}, capacity)
    assert packing.make_plan({}, 10).count == 0
    assert check_plan({10: 3}, 10).count == 3


def test_exact_complements_fill_containers():
    assert check_plan({6: 5, 4: 5}, 10).count == 5
    assert check_plan({5: 6}, 10).count == 3
    assert check_plan({7: 2, 2: 2, 1: 2}, 10).count == 2
    rng = random.Random(2)
    histogram = Counter(min(200, 1 + int(rng.expovariate(0.03))) for _ in range(5000))
    plan = check_plan(histogram, 200)
    total = sum(s * n for s, n in histogram.items())
    assert plan.count <= -(-total // 200) + 1


SCHEMA = "doc string, n bigint, item string, container int"


def packed(spark, rows, capacity, **kw):
    df = spark.createDataFrame([(d, n, "clash", 1) for d, n in rows], SCHEMA)
    return packing.pack(df, F.col("doc"), F.col("n"), capacity, **kw)


@pytest.mark.parametrize("buckets", [1, 7])
def test_every_item_gets_one_container_and_only_large_items_are_cut(spark, buckets):
    rng = random.Random(3)
    rows = [(f"d{i}", rng.choice((0, None, 10, 10, 10, rng.randrange(1, 101), 100, 250))) for i in range(600)] + [("twice", 5), ("twice", 5), (None, 7)]
    out = packed(spark, rows, 100, buckets=buckets).collect()
    fills, pieces = Counter(), defaultdict(list)
    for r in out:
        pieces[r.item].append(r)
        if r.container is None:
            assert r["size"] == 0
        else:
            fills[r.container] += r["size"]
    assert max(fills.values()) <= 100 and len(out) == sum(max(1, -(-(n or 0) // 100)) for _, n in rows)
    for name, n in rows:
        if name not in ("twice", None):
            assert sorted((p.piece, p.start, p["size"]) for p in pieces[name]) == [(k, 100 * k, min(100, (n or 0) - 100 * k)) for k in range(max(1, -(-(n or 0) // 100)))]
    total = sum(n or 0 for _, n in rows)
    assert len(fills) <= -(-total // 100) + 2
    report = packing.fill_report(packed(spark, rows, 100, buckets=buckets), 100).first()
    assert report.containers == len(fills) and report.room_used == total and report.overfull_containers == 0


def test_empty_tables(spark):
    assert packed(spark, [], 10).count() == 0
    counted = spark.createDataFrame([], "doc bigint, source string, tokens bigint")
    assert mixing.mix(counted, spark.createDataFrame([], "source string, share double, repeats int")).count() == 0


def mix(spark, docs, goals, block):
    counted = mixing.counted_sources(spark.createDataFrame([(*d, "clash") for d in docs], "doc bigint, source string, tokens bigint, slot string"))
    targets = spark.createDataFrame(goals, "source string, share double, repeats int")
    return mixing.mix(counted, targets, block), targets


def test_shares_are_reached_within_the_repeats(spark):
    rng = random.Random(5)
    docs, i = [], 0
    for source, n in (("big", 3000), ("mid", 700), ("tiny", 60)):
        for _ in range(n):
            docs.append((i, source, rng.randrange(0, 200)))
            i += 1
    docs += [(i + 1, "unlisted", 50), (i + 2, None, 50), (i + 3, "off", 50)]
    goals = [("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 3), ("absent", 0.1, 5), ("off", 0.0, 5), (None, 0.1, 1)]
    mixed, targets = mix(spark, docs, goals, 256)
    rows = mixed.collect()
    uses, got, slots, parts = defaultdict(set), Counter(), Counter(), defaultdict(list)
    for r in rows:
        got[r.source] += r.tokens
        slots[r.slot, r.source] += r.tokens
        uses[r.doc].add(r.use)
        parts[r.doc, r.use].append((r.start, r.start + r.tokens))
    by_source = {d: s for d, s, _ in docs}
    limits = {"big": 1, "mid": 2, "tiny": 3}
    assert all(max(uses[d]) <= limits[by_source[d]] for d in uses)
    for (d, use), found in parts.items():  # no token twice in a use, and all of them but in a source's last use
        found.sort()
        assert found[0][0] >= 0 and all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False))
        assert use == max(uses[d]) or (found[0][0], found[-1][1]) == (0, next(n for i, _, n in docs if i == d))
    assert sorted(s for s, _ in slots) == list(range(len(slots))) and sum(n != 256 for n in slots.values()) <= 1
    total = sum(got.values())
    assert set(got) == set(limits) and all(abs(got[s] - total * w / 0.9) <= 2 * 256 for s, w in (("big", 0.5), ("mid", 0.3), ("tiny", 0.1)))
    totals = Counter()
    for _, s, n in docs:
        totals[s] += n
    assert total > 0.95 * min(totals["big"] / 0.5, 2 * totals["mid"] / 0.3, 3 * totals["tiny"] / 0.1) * 0.9
    report = {r.source: r for r in mixing.share_report(mixed, targets).collect()}
    assert report["tiny"].tokens == got["tiny"] and report["absent"].reached_share == 0 and report["big"].most_uses == 1


def test_every_prefix_of_the_schedule_is_near_the_targets(spark):
    goals = {"a": 0.61, "b": 0.27, "c": 0.12}
    totals = spark.createDataFrame([(s, 10**6) for s in goals], "source string, total bigint")
    sources = mixing.planned_sources(totals, spark.createDataFrame([(s, w, 1) for s, w in goals.items()], "source string, share double, repeats int"))
    given = mixing.schedule(sources, 5000, 100).orderBy("slot").collect()
    assert [r.slot for r in given] == list(range(5000))
    seen = Counter()
    for i, r in enumerate(given):
        assert r["rank"] == seen[r.source]
        seen[r.source] += 1
        assert i < 50 or all(abs(seen[s] - (i + 1) * w) < 6 for s, w in goals.items())


def test_points_come_out_exact_for_any_slot(spark):
    slots = [0, 1, 2, 2**20 - 1, 2**20, 2**41 + 12345, 2**59 + 7]
    df = spark.createDataFrame([(i,) for i in slots], "slot bigint").select("slot", mixing.point_of(F.col("slot")).alias("p"))
    assert {r.slot: r.p for r in df.collect()} == {i: i * mixing.GOLDEN % mixing.POINTS for i in slots}


def test_token_counts_cover_whole_texts(spark):
    texts = [None, "", "hello world", "x " * 50_000, "Straße 😀\x00"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc bigint, text string, tokens string")
    got = {r.doc: r.tokens for r in tokens.token_counts(df, {"doc": F.col("doc")}, "text", tokens.DEFAULT).collect()}
    encode = tokens.encoding(tokens.DEFAULT)
    assert got == {i: len(encode.encode_ordinary(t or "")) for i, t in enumerate(texts)} and got[3] >= 50_000
    assert encode.decode(encode.encode_ordinary(texts[4])) == texts[4]
