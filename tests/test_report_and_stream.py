import json

from pyspark.sql import functions as F

from structlens import cli
from structlens.plans import report
from structlens.sources import files
from structlens.streaming import landing


def games(n, start=0):
    return [json.dumps({"id": f"g{i}", "title": f"T{i}", "min_players": 1 + i % 2, "max_players": 2 + i % 5, "min_play_time_minutes": 10 * (1 + i % 7), "max_play_time_minutes": 10 * (2 + i % 7), "complexity": 1 + (i % 7) / 2, "release_year": 1960 + i, "categories": [], "mechanics": [{"id": "1", "name": "Dice"}] * (i % 3), "sources": []}) for i in range(start, start + n)]


def test_report_is_repeatable_and_renders(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text("\n".join([*games(30), "{bad"]))
    assert cli.main(["analyze", str(tmp_path / "g.jsonl"), str(tmp_path / "a"), "--corpus", "demo"]) == 0
    assert cli.main(["analyze", str(tmp_path / "g.jsonl"), str(tmp_path / "b"), "--corpus", "demo"]) == 0
    made = json.loads((tmp_path / "a" / "report.json").read_text())
    assert (tmp_path / "a" / "report.json").read_bytes() == (tmp_path / "b" / "report.json").read_bytes()
    assert made["n_games"] == 30 and len(made["tables"]["coverage"]) == 16 and len(made["payload_id"]) == 64
    rho = {r["x"]: r["rho"] for r in made["tables"]["correlations"]}
    assert rho["play_time_midpoint"] == 1.0 and rho["log_play_time_midpoint"] == 1.0
    text = (tmp_path / "a" / "findings.md").read_text()
    assert "# demo" in text and "play_time_midpoint with complexity: 1.00 (n=30, strong)" in text
    assert report.markdown(made) == text


def test_stream_of_files_equals_a_batch_over_them(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "1.jsonl").write_text("\n".join([*games(10), "", "{bad", '{"id": ""}']))
    lines = lambda: landing.landing_lines(spark, str(folder), 1)
    landing.keep_up(lines(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (folder / "2.jsonl").write_text("\n".join(games(5, 10)))
    landing.keep_up(lines(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    landing.keep_up(lines(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "games"))
    assert sorted(r.id for r in got.collect()) == sorted(f"g{i}" for i in range(15))
    assert spark.read.parquet(str(tmp_path / "out" / "rejects")).count() == 2
    query = landing.label_counts(lines()).writeStream.format("memory").queryName("labels").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = got.select(F.explode("mechanics.name").alias("name")).groupBy("name").count().collect()
    assert {(r.name, r.occurrences) for r in spark.table("labels").collect()} == {(r.name, r["count"]) for r in batch}


def test_stream_rejects_what_the_batch_reader_rejects(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    sound = json.loads(games(1)[0])
    bad = [{"extra": 1}, {"rating_count": -1}, {"min_players": 5, "max_players": 2}, {"min_play_time_minutes": 90, "max_play_time_minutes": 30}, {"title": ""}, {"complexity": "x"}]
    (folder / "1.jsonl").write_text("\n".join([*games(3), "[1]", "null", "{bad", *[json.dumps({**sound, "id": f"b{i}", **x}) for i, x in enumerate(bad)]]))
    landing.keep_up(landing.landing_lines(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch, rejects = files.read_games(spark, str(folder))
    got = spark.read.parquet(str(tmp_path / "out" / "games"))
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in batch.collect()) == ["g0", "g1", "g2"]
    reasons = sorted(r.reason for r in spark.read.parquet(str(tmp_path / "out" / "rejects")).collect())
    assert reasons == sorted(r.reason for r in rejects.collect()) and len(reasons) == 9 and {"unknown_key", "negative_count", "inverted_range"} < set(reasons)


def test_event_windows_equal_batch_for_events_in_time(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = landing.event_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    expected = {(r.day, r.event_type): r.n for r in events.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("windows").collect()} == expected
