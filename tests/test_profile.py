from structlens.operators import profile
from structlens.plans.pipeline_queries import LOAD_RULES

SCHEMA = "feed_id string, load_id int, row_seq bigint, release_year string, complexity string, min_play_time_minutes string, value string, mask string"


def issues(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return {tuple(r) for r in profile.load_issues(df, "feed_id", "load_id", "row_seq", LOAD_RULES).collect()}


def load(feed, number, years, start=0):
    return [(feed, number, start + i, y, "2.5", "30") for i, y in enumerate(years)]


def test_each_issue_and_its_threshold(spark):
    good = [str(1990 + i % 20) for i in range(100)]
    assert issues(spark, load("f", 1, good) + load("f", 2, good)) == set()
    assert issues(spark, load("f", 1, good) + load("f", 2, ["20xx"] * 2 + good[:98])) == set()
    assert issues(spark, load("f", 1, good) + load("f", 2, ["20xx"] * 3 + good[:97])) == {("f", 2, "release_year", "pattern")}
    assert issues(spark, load("f", 1, good) + load("f", 2, ["2031"] * 2 + good[:98])) == {("f", 2, "release_year", "range")}
    assert issues(spark, load("f", 1, good) + load("f", 2, ["0"] * 11 + good[:89])) == {("f", 2, "release_year", "nulls")}
    assert issues(spark, load("f", 1, good) + load("f", 2, [None] * 5 + [" \t"] * 5 + good[:90])) == set()
    assert issues(spark, load("f", 1, good) + load("f", 2, ["1990"] * 50 + ["2009"] * 50)) >= {("f", 2, "release_year", "distinct")}
    assert issues(spark, load("f", 1, ["1990"] * 50 + ["2000"] * 50) + load("f", 2, ["1990"] * 76 + ["2000"] * 24)) == {("f", 2, "release_year", "drift")}
    assert issues(spark, load("f", 1, ["1990"] * 50 + ["2000"] * 50) + load("f", 2, ["1990"] * 75 + ["2000"] * 25)) == set()


def test_lines_sent_twice_count_once_and_loads_may_have_gaps(spark):
    bad = load("f", 7, ["x", "1990"])
    assert issues(spark, load("f", 2, ["1990", "1991"]) + bad + bad) == issues(spark, load("f", 2, ["1990", "1991"]) + bad)


def test_null_keys_empty_and_long_values(spark):
    assert issues(spark, []) == set()
    rows = [(None, None, None, "9" * 5000, "x" * 100_000, None)] * 2
    assert {(f, l, c) for f, l, c, _ in issues(spark, rows)} == {(None, None, "release_year"), (None, None, "complexity")}


def test_masks(spark):
    text = ["2003", "-12.5", "PT90M", "12   min", "N/A", "Ärger 3", ""]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    assert [r[0] for r in df.select(profile.mask_of(df.t)).collect()] == ["9", "-9.9", "A9A", "9 a", "A/A", "Aa 9", ""]


def test_mask_divergence(spark):
    df = spark.createDataFrame([(*r, "", "") for r in load("f", 1, ["1990"] * 4) + load("f", 2, ["1990", "x", "x", "x"])], SCHEMA)
    out = {(r.load_id, r.column_name): r for r in profile.mask_profile(df, "feed_id", "load_id", "row_seq", LOAD_RULES).collect()}
    assert out[2, "release_year"].divergence == 0.75 and out[1, "release_year"].divergence is None
    assert out[2, "complexity"].divergence == 0.0 and out[2, "complexity"].top_mask == "9.9"
