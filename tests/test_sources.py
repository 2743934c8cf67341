import json
import xml.etree.ElementTree as ET

import pytest

from structlens.sources import files, things

DOC = """<items><item type="boardgame" id="913"><name type="alternate" value="Other"/><name type="primary" value=" Lantern Quay "/><yearpublished value="2031"/><minplayers value="2"/><maxplayers value="5"/>
<playingtime value="70"/><link type="boardgamedesigner" id="1" value="K T"/><link type="boardgamedesigner" id="2" value=" "/><link type="boardgamemechanic" id="55" value="Tide Reading"/><link type="boardgamemechanic" id="55" value="Tide Reading"/>
<link type="boardgameartist" id="3" value="no"/><statistics><ratings><usersrated value="10"/><average value="7.5"/><numweights value="0"/><averageweight value="2.3"/></ratings></statistics></item>
<item type="boardgameexpansion" id="14"><name value="X"/></item><item id="15"><name type="primary" value=" "/><name type="alternate" value="A"/></item><item><name value="Y"/></item>
<item id="16"><name value="Z"/><yearpublished value="0"/><minplayers value=""/><maxplayers value="x"/><minplaytime value="0"/><maxplaytime value="30"/><playingtime value="45"/>
<statistics><ratings><usersrated value="0"/><average value="5"/><numweights value="2"/><averageweight value="1.5"/></ratings></statistics></item>
<item id="17"><name value="I"/><minplayers value="5"/><maxplayers value="2"/></item><item id="16"><name value="again"/></item></items>"""


def artifacts(spark, bodies):
    rows = [(i, b, None, "http://x/thing?id=1") for i, b in bodies]
    return spark.createDataFrame(rows, "artifact_id bigint, body string, retrieved_at timestamp, request_url string")


def test_items_become_catalog_rows_by_the_null_rules(spark):
    rows = {r.item_pos: r for r in things.item_rows(artifacts(spark, [(1, DOC), (1, DOC), (2, "<bad"), (3, None)])).collect()}
    assert {p: (r.status, r.reason) for p, r in rows.items()} == {
        1: ("ok", None), 2: ("skipped", "not_boardgame"), 3: ("error", "missing_name"), 4: ("error", "missing_id"), 5: ("ok", None), 6: ("error", "inverted_range"), 7: ("ok", None),
    }
    a, b = rows[1], rows[5]
    assert (a.id, a.title, a.release_year, a.min_play_time_minutes, a.max_play_time_minutes, a.rating, a.rating_count, a.complexity) == ("bgg-913", "Lantern Quay", 2031, 70, 70, 7.5, 10, None)
    assert a.designers == ["K T"] and a.publishers == [] and [(m.id, m.name) for m in a.mechanics] == [("bgg-55", "Tide Reading")] * 2
    assert a.sources[0].source_identifier == "913" and a.popularity is None
    assert (b.release_year, b.min_players, b.max_players, b.min_play_time_minutes, b.max_play_time_minutes, b.rating, b.rating_count, b.complexity) == (None, None, None, None, 30, None, 0, 1.5)
    split = {r.source_id: r.document for r in things.item_documents(artifacts(spark, [(1, DOC), (2, "<bad")])).collect()}
    assert set(split) == {"913", "14", "15", "16", "17"} and "again" in split["16"] and ET.fromstring(split["913"]).find("item").get("id") == "913"
    first = things.first_items(artifacts(spark, [(1, DOC), (2, "<bad"), (3, "<items/>")])).collect()
    assert [(r.record_id, r.item_pos) for r in first] == [(1, 1)]
    with pytest.raises(Exception, match="no item"):
        things.first_items(artifacts(spark, [(1, DOC), (3, "<items/>")]), strict=True).collect()
    assert things.catalog_rows(things.item_rows(artifacts(spark, []))).count() == 0


def test_real_documents_agree_with_a_tree_parser(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/raw_artifacts.parquet")
    got = {(r.record_id, r.item_pos): r for r in things.item_rows(df).collect()}
    seen = 0
    for row in df.dropDuplicates(["artifact_id"]).collect():
        try:
            root = ET.fromstring(row.body)
        except (ET.ParseError, TypeError):
            continue
        for pos, item in enumerate(root.findall("item") if root.tag == "items" else [], 1):
            r = got[row.artifact_id, pos]
            names = [n for n in item.findall("name")]
            primary = next((n.get("value").strip() for n in names if n.get("type") == "primary" and (n.get("value") or "").strip()), (names[0].get("value") or "").strip() if names else "")
            assert (r.title or "") == primary and r.source_id == (item.get("id") or None)
            assert r.publishers == [x.get("value").strip() for x in item.findall("link") if x.get("type") == "boardgamepublisher" and (x.get("value") or "").strip()]
            seen += 1
    assert seen == len(got) > 20


def test_jsonl_lines_are_kept_or_rejected_with_their_number(spark, tmp_path):
    lines = [json.dumps({"id": "a", "title": "A", "min_players": 2, "mechanics": [{"id": "m", "name": "M"}]}), "", "{bad", "[1]", json.dumps({"id": "b", "title": "B", "price": 1}), json.dumps({"id": "c", "title": ""}), json.dumps({"id": "d", "title": "D", "rating_count": -1}), json.dumps({"id": "e", "title": "E", "min_players": "x"})]
    (tmp_path / "games.jsonl").write_text("\n".join(lines))
    games, rejects = files.read_games(spark, str(tmp_path / "games.jsonl"))
    assert [(r.line_no, r.id, r.mechanics[0].name) for r in games.collect()] == [(1, "a", "M")]
    assert {r.line_no: (r.reason, r.raw_id) for r in rejects.collect()} == {3: ("invalid_json", None), 4: ("not_an_object", None), 5: ("unknown_key", "b"), 6: ("missing_title", "c"), 7: ("negative_count", "d"), 8: ("invalid_value", "e")}


def test_lines_keep_their_numbers_across_splits(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("\n".join(f"line {i}" for i in range(1, 20_001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = files.numbered_lines(spark, str(tmp_path / "lines.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 20_000 and all(r.value == f"line {r.line_no}" for r in rows)


def test_id_lists_keep_the_first_and_slice_afterwards(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# head\n13 # a game\n 42\n13\n\n7 x\n\t9\n")
    ids = lambda **kw: [(r.id, r.place) for r in files.read_id_list(spark, str(tmp_path / "ids.txt"), **kw).orderBy("place").collect()]
    assert ids() == [("13", 0), ("42", 1), ("7", 2), ("9", 3)] and ids(offset=1, limit=2) == [("42", 1), ("7", 2)] and ids(offset=9) == [] and ids(limit=0) == []


def test_manifest_and_sinks(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"corpus_id": "c", "ok": [{"source_id": "1", "item_type": "boardgame"}, {"source_id": "2", "item_type": "expansion"}, {"source_id": "3", "item_type": None}]}, indent=1))
    assert [r.source_id for r in files.non_base_rows(files.read_manifest(spark, str(tmp_path / "m.json"))).collect()] == ["2"]
    df = spark.createDataFrame([(2, "b", 1.5), (1, "a", None)], "ord int, id string, x double")
    files.write_jsonl(df, str(tmp_path / "out"), ["ord"], leave_out=("ord",))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    assert "".join(p.read_text() for p in parts).split("\n")[:2] == ['{"id":"a"}', '{"id":"b","x":1.5}']
