import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from structlens.operators import shred

REPEATED = ("items/item", "items/item/link", "items/item/versions/item", "items/item/versions/item/link")
SCHEMA = "artifact_id bigint, retrieved_at timestamp, body string, record_id string, anchor string"


def table(spark, bodies):
    df = spark.createDataFrame([(i, None, b, "clash", "clash") for i, b in bodies], SCHEMA)
    return shred.instance_table(df, "artifact_id", "body", ["retrieved_at"], "items", REPEATED)


def test_positions_follow_the_document(spark):
    body = """<items><!-- <link type="no"/> --><note/><item id='1'><link value="a &amp; b" type='x'/><versions><item><link type="v" value=" w "/></item><item/></versions>
      <link type="y" value="&#xE9;"/><offer><link type="other" value="z"/></offer></item><item id="1"><link/><link type="t" value="u"/></item></items>"""
    got = table(spark, [(5, body), (5, body)])
    links = got.where(F.col("anchor") == "items/item/link")
    rows = {(tuple(r.positions), r.fields.get("@type"), r.fields.get("@value")) for r in links.collect()}
    assert rows == {((1, 1), "x", "a & b"), ((1, 2), "y", "é"), ((2, 1), None, None), ((2, 2), "t", "u")}
    nested = got.where(F.col("anchor") == "items/item/versions/item/link").collect()
    assert [(tuple(r.positions), r.fields["@value"]) for r in nested] == [((1, 1, 1), " w ")]
    flat = shred.pivot(got, "items/item/versions/item/link", ["item_pos", "version_pos", "link_pos"], {"kind": "@type", "value": "@value"})
    assert [tuple(r) for r in flat.collect()] == [(5, 1, 1, 1, "v", "w")]


def test_rejects_keep_their_reason_and_give_no_rows(spark):
    bodies = [(1, None), (2, ""), (3, "   "), (4, "<items><item></items>"), (5, "<error/>"), (6, '{"error": 1}'), (7, "<items/>"), (None, "<items><item/></items>")]
    got = table(spark, bodies)
    assert {r.record_id: r.reason for r in shred.rejects(got).collect()} == {1: "no content", 2: "no content", 3: "no content", 4: "not well-formed", 5: "another root element", 6: "not well-formed"}
    assert sorted((str(r.record_id), r.anchor) for r in got.where(F.col("anchor") != "!").collect()) == [("7", "items"), ("None", "items"), ("None", "items/item")]
    assert table(spark, []).count() == 0


def test_agrees_with_a_tree_parser_on_a_long_record(spark):
    body = "<items>" + "".join(f"<item><link type='t{i % 3}' value='{i}'/>{'<link/>' * (i % 4)}</item>" for i in range(30_000)) + "</items>"
    expected = [(i, j) for i, item in enumerate(ET.fromstring(body), 1) for j, _ in enumerate(item.findall("link"), 1)]
    got = table(spark, [(1, body)]).where(F.col("anchor") == "items/item/link").select("positions").collect()
    assert sorted(tuple(r.positions) for r in got) == expected


def test_path_summary_finds_what_repeats(spark):
    df = spark.createDataFrame([(1, None, "<items><item a='1'><link/><link/></item></items>", "", ""), (2, None, "<bad", "", "")], SCHEMA)
    found = {r.path: (r.records, r.occurrences, r.most_in_parent) for r in shred.path_summary(df, "artifact_id", "body", ["retrieved_at"]).collect()}
    assert found["items/item/link"] == (1, 2, 2) and found["items/item/@a"] == (1, 1, 1)


def test_a_second_value_at_a_path_is_not_lost(spark):
    body = "<items><item a='1'><note b='2'>x</note><note b='3'>y</note></item><item><box><note b='4'/></box></item></items>"
    got = table(spark, [(1, body)])
    assert sorted((tuple(r.positions), r.path, r.value) for r in shred.unplaced(got).collect()) == [((1,), "items/item/note", ""), ((1,), "items/item/note/@b", "3"), ((1,), "items/item/note/text()", "y")]
    df = spark.createDataFrame([(1, None, body, "", "")], SCHEMA)
    summary = shred.path_summary(df, "artifact_id", "body", ["retrieved_at"], "items")
    accounts = shred.reconcile(summary, got, "items").collect()
    assert len(accounts) == 9 and all(r.unaccounted == 0 for r in accounts)
    assert shred.repeated_ancestors(summary) == ["items/item", "items/item/note"]
    found = shred.instance_table(df, "artifact_id", "body", ["retrieved_at"], "items", shred.repeated_ancestors(summary))
    assert shred.unplaced(found).count() == 0
    assert {tuple(r.positions): r.fields["@b"] for r in found.where("anchor = 'items/item/note'").collect()} == {(1, 1): "2", (1, 2): "3"}


def test_triples_stream_over_chunk_edges(monkeypatch):
    body = "<items>" + "".join(f"<item n='{i}'>t\u00e9xt {i}</item>" for i in range(50)) + "</items>"
    whole = list(shred.triples(body))
    monkeypatch.setattr(shred, "CHUNK", 7)
    assert list(shred.triples(body)) == whole and len(whole) == 151


def test_of_repeated_records_the_latest_stands_without_moving_texts(spark, tmp_path):
    from datetime import datetime

    rows = [(1, datetime(2024, 1, d), f"<items><item id='{d}'/></items>") for d in (1, 3, 2)] + [(2, None, "<items/>"), (2, None, "<items/>"), (None, None, "<items/>"), (None, datetime(2024, 1, 1), "<items><item id='n'/></items>")]
    spark.createDataFrame(rows, "artifact_id bigint, retrieved_at timestamp, body string").repartition(3).write.parquet(str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a"))
    got = shred.instance_table(stored, "artifact_id", "body", ["retrieved_at"], "items", REPEATED)
    assert sorted((str(r.record_id), r.anchor, r.fields.get("@id", "")) for r in got.collect()) == [("1", "items", ""), ("1", "items/item", "3"), ("2", "items", ""), ("None", "items", ""), ("None", "items/item", "n")]
