"""Catalog rows from XML thing documents, with a status for every item."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structlens.functions import columns as c
from structlens.operators.shred import Shredder, root_of, standing_records, trimmed
from structlens.sources.connector import split_items

ANCHORS = ("items/item", "items/item/name", "items/item/link")
GAME_FIELDS = (
    "id string, title string, release_year int, min_players int, max_players int, min_play_time_minutes int, max_play_time_minutes int, popularity double, rating double, rating_count int, "
    "complexity double, designers array<string>, publishers array<string>, categories array<string>, mechanics array<struct<id:string,name:string,category:string,description:string>>, "
    "sources array<struct<source:string,source_type:string,url:string,source_identifier:string,retrieved_at:timestamp,page_number:int>>"
)


def _field(path: str) -> Column:
    return F.try_element_at("item", F.lit(path))


_PART = pa.struct([("pos", pa.int32()), ("type", pa.string()), ("id", pa.string()), ("value", pa.string())])
_GROUP = pa.schema([("record_id", pa.int64()), ("request_url", pa.string()), ("retrieved_at", pa.timestamp("us", "UTC")), ("item_pos", pa.int32()), ("item", pa.map_(pa.string(), pa.string())), ("names", pa.list_(_PART)), ("links", pa.list_(_PART))])
_GROUP_DDL = "record_id bigint, request_url string, retrieved_at timestamp, item_pos int, item map<string,string>, names array<struct<pos:int,type:string,id:string,value:string>>, links array<struct<pos:int,type:string,id:string,value:string>>"


def _parsed_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shredder = Shredder(ANCHORS, ANCHORS)
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _GROUP, strict=True)], schema=_GROUP)
        rows.clear()
        return out

    for batch in batches:
        for ident, body, url, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            try:
                if root_of(body) != "items":
                    continue
            except (expat.ExpatError, ValueError):
                continue
            parts: dict[str, list[dict]] = {"items/item/name": [], "items/item/link": []}

            def emit(anchor: str, positions: tuple[int, ...], fields: dict[str, str], ident=ident, url=url, at=at, parts=parts) -> None:
                if anchor == "items/item":
                    rows.append((ident, url, at, positions[0], list(fields.items()), list(parts["items/item/name"]), list(parts["items/item/link"])))
                    parts["items/item/name"].clear(), parts["items/item/link"].clear()
                elif anchor in parts:
                    parts[anchor].append({"pos": positions[1], "type": fields.get("@type"), "id": fields.get("@id"), "value": fields.get("@value")})

            shredder.run(body, emit)
            if len(rows) >= 2000:
                yield flush()
    if rows:
        yield flush()


def item_groups(documents: DataFrame) -> DataFrame:
    """(record_id, request_url, retrieved_at, item_pos, item, names, links) of raw artifacts: one row per item, whole from the parser, nothing shuffled."""
    records = standing_records(documents, "artifact_id", "body", ["retrieved_at"], ["request_url", "retrieved_at"])
    return records.select("record_id", "body", "request_url", F.col("retrieved_at").cast("timestamp").alias("retrieved_at")).mapInArrow(_parsed_items, _GROUP_DDL)


def first_items(documents: DataFrame, strict: bool = False) -> DataFrame:
    """The first item of every document that has one; strict stops the job at a document without."""
    first = item_groups(documents).where("item_pos = 1")
    if not strict:
        return first
    every = documents.select(F.col("artifact_id").alias("_id")).distinct().join(first, F.col("_id").eqNullSafe(F.col("record_id")), "left")
    guard = F.when(F.col("item_pos").isNull(), F.raise_error(F.concat(F.lit("no item in document "), F.coalesce(F.col("_id").cast("string"), F.lit("null")))).cast("boolean")).otherwise(F.lit(True))
    return every.where(guard).drop("_id")


def item_documents(documents: DataFrame) -> DataFrame:
    """(record_id, source_id, document): a document for every item id of a batch document; of a repeated id the last item stands."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for ident, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if root_of(body) == "items":
                        found += [(ident, source, text) for source, text in split_items(body).items()]
                except (expat.ExpatError, ValueError):
                    continue
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found]), pa.array([r[2] for r in found])], names=["record_id", "source_id", "document"])

    records = standing_records(documents, "artifact_id", "body", ["retrieved_at"])
    return records.select("record_id", "body").mapInArrow(split, "record_id bigint, source_id string, document string")


def primary_name(names: Column) -> Column:
    """The first primary name that is not blank, else the very first name if not blank, else null."""
    value = lambda n: F.nullif(trimmed(n["value"]), F.lit(""))
    primary = F.get(F.filter(names, lambda n: (n["type"] == "primary") & value(n).isNotNull()), F.lit(0))
    return F.coalesce(value(primary), value(F.get(names, F.lit(0))))


def typed_links(links: Column, kind: str) -> Column:
    """Links of a type with trimmed, non-blank values, in document order."""
    return F.filter(F.transform(F.filter(links, lambda x: x["type"] == kind), lambda x: F.struct(x["id"].alias("id"), trimmed(x["value"]).alias("value"))), lambda x: x["value"] != "")


def item_rows(documents: DataFrame, source: str = "bgg", source_type: str = "api", base_type: str = "boardgame") -> DataFrame:
    """Every item with its catalog row and status: ok, skipped (another type) or error (no id, no name, inverted range).

    Zero means missing for years, players and minutes, not for the number of
    ratings; a rating or weight without votes is null; a single playing time
    stands for both bounds only if both are missing.
    """
    items = item_groups(documents)
    lo, hi = c.whole_or_null(_field("minplaytime/@value")), c.whole_or_null(_field("maxplaytime/@value"))
    played = c.whole_or_null(_field("playingtime/@value"))
    neither = lo.isNull() & hi.isNull()
    votes, weights = c.whole_or_null(_field("statistics/ratings/usersrated/@value"), keep_zero=True), c.whole_or_null(_field("statistics/ratings/numweights/@value"), keep_zero=True)
    number = lambda path: F.trim(_field(path)).try_cast("double")
    values = lambda kind: F.transform(typed_links(F.col("links"), kind), lambda x: x["value"])
    ident = F.nullif(_field("@id"), F.lit(""))
    void = F.lit(None).cast("string")
    rows = items.select(
        "record_id", "item_pos", ident.alias("source_id"), F.coalesce(_field("@type"), F.lit(base_type)).alias("item_type"),
        F.concat(F.lit("bgg-"), ident).alias("id"), primary_name(F.col("names")).alias("title"),
        c.whole_or_null(_field("yearpublished/@value")).alias("release_year"), c.whole_or_null(_field("minplayers/@value")).alias("min_players"), c.whole_or_null(_field("maxplayers/@value")).alias("max_players"),
        F.when(neither, played).otherwise(lo).alias("min_play_time_minutes"), F.when(neither, played).otherwise(hi).alias("max_play_time_minutes"),
        F.lit(None).cast("double").alias("popularity"), c.gated(number("statistics/ratings/average/@value"), votes).alias("rating"), votes.alias("rating_count"),
        c.gated(number("statistics/ratings/averageweight/@value"), weights).alias("complexity"),
        values("boardgamedesigner").alias("designers"), values("boardgamepublisher").alias("publishers"), values("boardgamecategory").alias("categories"),
        F.transform(typed_links(F.col("links"), "boardgamemechanic"), lambda x: F.struct(F.concat(F.lit("bgg-"), x["id"]).alias("id"), x["value"].alias("name"), void.alias("category"), void.alias("description"))).alias("mechanics"),
        F.array(F.struct(F.lit(source).alias("source"), F.lit(source_type).alias("source_type"), F.col("request_url").alias("url"), ident.alias("source_identifier"), F.col("retrieved_at").alias("retrieved_at"), F.lit(None).cast("int").alias("page_number"))).alias("sources"),
    )
    inverted = F.coalesce(F.col("min_players") > F.col("max_players"), F.lit(False)) | F.coalesce(F.col("min_play_time_minutes") > F.col("max_play_time_minutes"), F.lit(False))
    reason = F.when(F.col("source_id").isNull(), "missing_id").when(F.col("title").isNull(), "missing_name").when(F.col("item_type") != base_type, "not_boardgame").when(inverted, "inverted_range")
    return rows.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "ok").when(reason == "not_boardgame", "skipped").otherwise("error"))


def catalog_rows(rows: DataFrame) -> DataFrame:
    """The catalog rows of items that are ok."""
    return rows.where("status = 'ok'").select("record_id", "item_pos", *[f.split()[0] for f in GAME_FIELDS.split(", ")])


def manifest(rows: DataFrame) -> DataFrame:
    """(status, reason, items): what a run's manifest counts."""
    return rows.groupBy("status", "reason").agg(F.count("*").alias("items"))
