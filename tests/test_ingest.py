import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from structlens import cli
from structlens.errors import AuthenticationError, NotFoundError, ResponseError, SchemaDriftError, StructlensError, TamperedError
from structlens.functions import metrics
from structlens.plans import ingest, report, robustness
from structlens.sources import connector, dictionary, files, store
from structlens.sources.raw_cache import RAW, RawCache


def item(ident, kind="boardgame", title="Tin Orchard", extra=""):
    return f'<item type="{kind}" id="{ident}"><name type="primary" value="{title} {ident}"/><minplayers value="2"/><maxplayers value="4"/><link type="boardgamemechanic" id="9" value="Drafting"/>{extra}</item>'


def document(*items):
    return f'<items termsofuse="t">{"".join(items)}</items>'


class Source:
    """A transport with some items; counts what it was asked."""

    def __init__(self, items, statuses=()):
        self.items, self.statuses, self.asked = items, list(statuses), []

    def __call__(self, url, headers):
        self.asked.append((url, headers))
        if self.statuses:
            return self.statuses.pop(0), {}, ""
        wanted = url.split("id=")[1].split(",")
        return 200, {"Content-Type": "text/xml"}, document(*[self.items[i] for i in wanted if i in self.items])


def fetcher(source, **kw):
    return connector.HttpFetcher("http://catalog.example/thing", source, spacing=0.0, sleep=lambda s: None, **kw)


def test_batches_are_split_retried_and_refused():
    source = Source({str(i): item(i) for i in range(50)}, [202, 503])
    found = fetcher(source, batch=20, token="k").fetch([str(i) for i in range(45)] + ["99"])
    assert len(found) == 45 and len(source.asked) == 5 and source.asked[0][1] == {"Authorization": "Bearer k"}
    assert "<item " in found["7"].body and found["7"].body.count("<item ") == 1 and 'termsofuse="t"' in found["7"].body
    with pytest.raises(AuthenticationError):
        fetcher(Source({}, [401])).fetch(["1"])
    with pytest.raises(ResponseError):
        fetcher(Source({}, [503] * 9), retries=3).fetch(["1"])
    with pytest.raises(ResponseError):
        fetcher(Source({}, [404])).fetch(["1"])
    with pytest.raises(NotFoundError):
        fetcher(Source({})).fetch_one("1")
    waits = []
    clock = iter(range(100))
    connector.HttpFetcher("u", Source({"1": item(1)}), spacing=5.0, batch=1, sleep=waits.append, clock=lambda: float(next(clock))).fetch(["1", "1"])
    assert waits and all(0 < w <= 5 for w in waits)


def test_the_cache_keeps_the_first_document_unless_told(spark, tmp_path):
    cache = RawCache(spark, str(tmp_path / "raw"))
    rows = lambda body, day: spark.createDataFrame([("s", "1", datetime(2024, 1, day), "u", "text/xml", 200, body)], RAW)
    assert cache.load().count() == 0 and cache.save(rows("a", 1)) == 1 and cache.save(rows("b", 2)) == 0
    assert cache.load().first().body == "a" and cache.save(rows("c", 3), overwrite=True) == 1 and cache.load().first().body == "c"
    ids = spark.createDataFrame([("1",), ("2",)], "source_identifier string")
    assert [r[0] for r in cache.missing(ids).collect()] == ["2"]


def test_store_is_content_addressed_and_notices_tampering(spark, tmp_path):
    s = store.ArtifactStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, body string")
    put = {r.entity: r.payload_id for r in s.put(df, "raw", F.col("id"), F.col("body")).collect()}
    assert put["a"] == put["b"] != put["c"] and s.payloads().count() == 2 and s.records().count() == 3
    doc = s.put(spark.createDataFrame([("d", "z")], "id string, body string"), "document", F.col("id"), F.col("body"), F.array(F.lit(put["a"]), F.lit(put["c"]))).first()
    s.put(df.limit(1), "raw", F.col("id"), F.lit("newer"), at=datetime(2999, 1, 1))
    assert {r.logical_key: r.content for r in s.latest("raw").collect()}["raw/a"] == "newer"
    assert {(r.payload_id, r.depth) for r in s.lineage(doc.payload_id).collect()} == {(doc.payload_id, 0), (put["a"], 1), (put["c"], 1)}
    assert s.verify() == 4
    spark.createDataFrame([("0" * 64, "text", "forged")], store.PAYLOADS).write.mode("append").parquet(str(tmp_path / "store" / "payloads"))
    with pytest.raises(TamperedError):
        s.verify()


def test_a_corpus_run_and_its_repetition(spark, tmp_path):
    source = Source({"1": item(1), "2": item(2), "3": item(3, "boardgameexpansion"), "5": item(5, title="", extra="").replace(" 5", "")})
    (tmp_path / "ids.txt").write_text("1 # first\n2\n1\n3\n4\n5\n")
    registry = dictionary.CorpusRegistry()
    assert registry.register_folder(str(tmp_path)) == ["ids"]
    with pytest.raises(ValueError):
        registry["none"]
    out = str(tmp_path / "out")
    first = ingest.run_corpus(spark, out, fetcher(source), registry["ids"])
    assert first.counts == {"requested": 5, "ok": 2, "skipped": 1, "errors": 2, "cached": 0, "fetched": 5}
    manifest = json.loads(open(first.manifest_path).read())
    assert [r["source_id"] for r in manifest["ok"]] == ["1", "2"] and manifest["skipped"][0]["reason"] == "not_boardgame"
    assert {r["source_id"]: r["reason"] for r in manifest["errors"]} == {"4": "not_found", "5": "missing_name"} and manifest["ids_file_sha256"] == registry["ids"].ids_sha256()
    games, rejects = files.read_games(spark, first.jsonl_path)
    assert sorted(r.title for r in games.collect()) == ["Tin Orchard 1", "Tin Orchard 2"] and rejects.count() == 0
    asked = len(source.asked)
    again = ingest.run_corpus(spark, out, fetcher(source), registry["ids"], offset=1, limit=2)
    assert len(source.asked) == asked and again.counts == {"requested": 2, "ok": 1, "skipped": 1, "errors": 0, "cached": 2, "fetched": 0}
    kinds = {r.kind for r in store.ArtifactStore(spark, f"{out}/artifacts").records().select("kind").distinct().collect()}
    assert kinds == {"raw", "document", "dataset", "quality"} and store.ArtifactStore(spark, f"{out}/artifacts").verify() > 0
    with pytest.raises(StructlensError):
        ingest.run(spark, out, fetcher(source), ["1", "4"], go_on=False)


def test_command_line_ingests_from_a_folder(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "7.xml").write_text(document(item(7)))
    assert cli.main(["ingest", str(tmp_path / "o"), "7", "--documents", str(tmp_path / "docs")]) == 0
    assert "ok=1" in capsys.readouterr().out
    assert cli.main(["ingest", str(tmp_path / "o"), "8", "--documents", str(tmp_path / "docs")]) == 1
    with pytest.raises(SystemExit):
        cli.main(["ingest", str(tmp_path / "o"), "--documents", "x"])
    with pytest.raises(SystemExit):
        cli.main(["ingest", str(tmp_path / "o"), "7", "--limit", "1", "--documents", "x"])


def test_dictionary_schema_and_claims(spark):
    specs = dictionary.field_specs()
    assert {s.name for s in specs if s.model == "game"} >= {"id", "sources"} and {s.model for s in specs} == {"game", "mechanic", "source"}
    df = spark.createDataFrame([], dictionary.GAME_FIELDS)
    assert dictionary.require_no_drift(df) is df
    with pytest.raises(SchemaDriftError):
        dictionary.require_no_drift(df.withColumnRenamed("rating", "price"))
    schema = dictionary.json_schema()
    assert schema["required"] == ["id", "title"] and schema["properties"]["min_players"] == {"type": ["integer", "null"]} and schema["properties"]["mechanics"]["type"] == "array"
    told = spark.createDataFrame([("bluff", "hides cards", "me"), ("race", "", None)], "label string, description string, extractor string")
    made = dictionary.claims(told, F.lit("p" * 64), F.col("label")).collect()
    assert [(r.statement, r.confidence_policy) for r in made] == [("bluff: hides cards", "extractor:me"), ("race", None)] and made[0].evidence[0].excerpt == "bluff"


def test_metric_catalogue_and_registry():
    assert len(metrics.CATALOG) == 32 and sum(m.computable for m in metrics.CATALOG.values()) == 13
    metrics.require_known(["information_gain"])
    for bad in (["agency"], ["nothing"]):
        with pytest.raises(ValueError):
            metrics.require_known(bad)
    r = metrics.Registry("encoder")
    r.register("bag", len)
    assert r["bag"] is len and r.names() == ["bag"]
    for bad in (lambda: r.register("bag", len), lambda: r["x"]):
        with pytest.raises(ValueError):
            bad()


def test_robustness_report(spark):
    games = spark.read.parquet("/root/testdata/sf0.001/games.parquet")
    made = robustness.build(games, "small", ["b", "a"])
    assert made["inputs"] == ["a", "b"] and len(made["payload_id"]) == 64 and len(made["tables"]["composition"]["boxes"]) == 9
    text = robustness.markdown(made)
    assert all(f"## {title}" in text for title in ("What holds", "What depends on the representation", "What is sparse", "Limits"))
    assert report.json_bytes(made) == report.json_bytes(robustness.build(games, "small", ["a", "b"]))
    players = [r["max_players"] or 0 for r in made["tables"]["composition"]["extremes"]]
    assert players == sorted(players, reverse=True)
    t = made["tables"] | {"time_weight": {"correlations": [{"x": x, "rho": 0.6} for x in robustness.TIME[:3]] + [{"x": "play_time_span", "rho": 0.4}], "log_correlations": [{"x": "log_max_play_time_minutes", "rho": 0.7}], "leave_one_out": []}}
    found = robustness.findings(t)
    assert any("alike" in x for x in found["What holds"]) and any("span" in x for x in found["What depends on the representation"]) and any("Logarithms" in x for x in found["What depends on the representation"])
