"""Line files: JSON Lines with rejects, id lists, manifests, raw caches; and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structlens.sources.things import GAME_FIELDS


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): text lines with their number in the file, from 1, however files are split.

    Lines are numbered inside each split as they are read; splits are put in
    order of their offset with one row per split.
    """
    read = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("mark"), "value")
    blocks = read.groupBy("file", "block").agg(F.min("mark").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("start"))
    return read.join(starts, ["file", "block"]).select("file", (F.col("start") + F.col("mark") - F.col("first") + 1).alias("line_no"), "value")


def judged_games(lines: DataFrame) -> DataFrame:
    """lines (with a column value) and _v, the variant; g, the row; reason, why it is rejected, null for a game."""
    schema = T._parse_datatype_string(GAME_FIELDS)
    known = F.array(*[F.lit(f.name) for f in schema.fields])
    parsed = lines.select(
        "*",
        F.try_parse_json("value").alias("_v"),
        F.from_json("value", "map<string,string>").alias("_map"),
        F.from_json("value", T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("g"),
    )
    g = lambda name: F.col(f"g.{name}")
    over = lambda a, b: F.coalesce(g(a) > g(b), F.lit(False))
    reason = (
        F.when(F.col("_v").isNull(), "invalid_json")
        .when(~F.schema_of_variant("_v").startswith("OBJECT"), "not_an_object")
        .when(F.size(F.array_except(F.map_keys("_map"), known)) > 0, "unknown_key")
        .when(g("_corrupt").isNotNull(), "invalid_value")
        .when(F.coalesce(g("id"), F.lit("")) == "", "missing_id")
        .when(F.coalesce(g("title"), F.lit("")) == "", "missing_title")
        .when(g("rating_count") < 0, "negative_count")
        .when(over("min_players", "max_players") | over("min_play_time_minutes", "max_play_time_minutes"), "inverted_range")
    )
    return parsed.withColumn("reason", reason).drop("_map")


def read_games(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(games with file and line_no, rejects): blank lines are skipped, every other line is in exactly one.

    A line is rejected if it is no JSON, no object, has unknown keys, lacks an id
    or title, or breaks a rule of the row; rejects are (file, line_no, reason, raw_id).
    """
    judged = judged_games(numbered_lines(spark, path).where(F.trim("value") != ""))
    names = T._parse_datatype_string(GAME_FIELDS).fieldNames()
    games = judged.where(F.col("reason").isNull()).select("file", "line_no", *[F.col(f"g.{n}").alias(n) for n in names])
    raw_id = F.try_variant_get("_v", "$.id", "string")
    rejects = judged.where(F.col("reason").isNotNull()).select("file", "line_no", "reason", F.when(F.col("reason") != "invalid_json", raw_id).alias("raw_id"))
    return games, rejects


def read_id_list(spark: SparkSession, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """(id, place): first token of each line without its comment, first occurrence kept, sliced after that."""
    if offset < 0 or limit is not None and limit < 0:
        raise ValueError("offset and limit must be 0 or more")
    token = F.split_part(F.regexp_replace(F.trim(F.regexp_replace(F.split_part("value", F.lit("#"), F.lit(1)), r"\s+", " ")), "^ ", ""), F.lit(" "), F.lit(1))
    lines = numbered_lines(spark, path)
    sizes = lines.groupBy("file").agg(F.max("line_no").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    at = lines.join(sizes.select("file", F.coalesce(before, F.lit(0)).alias("_before")), "file").select((F.col("_before") + F.col("line_no")).alias("_at"), token.alias("id"))
    ids = numbered_by_place(at.where(F.col("id") != "").groupBy("id").agg(F.min("_at").alias("_at")), "_at", "place")
    here = F.col("place") >= offset
    return ids.where(here if limit is None else here & (F.col("place") < offset + limit)).select("id", "place")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def non_base_rows(manifest: DataFrame, base_type: str = "boardgame") -> DataFrame:
    """Items a manifest calls ok although their type is another."""
    ok = manifest.select(F.inline("ok"))
    return ok.where(F.col("item_type").isNotNull() & (F.col("item_type") != base_type))


#: Places numbered together by numbered_by_place.
PLACE_RUN = 1 << 16


def numbered_by_place(df: DataFrame, place: str, name: str) -> DataFrame:
    """Rows numbered from 0 in the order of an integer column without equal values, in runs of places rather than in one task."""
    run = F.floor(F.col(place) / PLACE_RUN).cast("bigint")
    marked = df.withColumn("_run", run)
    counts = marked.groupBy("_run").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))  # a row per run
    starts = counts.select("_run", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_run").orderBy(place)) - 1
    return marked.withColumn("_in", inside).join(starts, "_run").withColumn(name, F.col("_start") + F.col("_in")).drop("_run", "_in", "_start")


def missing_from_cache(wanted: DataFrame, cached: DataFrame, key: str, batch: int) -> DataFrame:
    """Wanted keys that the cache lacks, in order of `place`, with the number of the fetch batch each falls into."""
    gone = wanted.join(cached.select(key), key, "left_anti")
    return numbered_by_place(gone, "place", "_number").withColumn("batch", F.floor(F.col("_number") / batch).cast("int")).drop("_number")


def write_jsonl(df: DataFrame, path: str, order: list[str], leave_out: tuple[str, ...] = ()) -> None:
    """Compact JSON lines of all columns but those left out, in the given order, one folder of parts whose names keep the order."""
    df.orderBy(*order).select(F.to_json(F.struct(*[c for c in df.columns if c not in leave_out])).alias("value")).write.text(path)


def artifact_rows(df: DataFrame, kind: str, key: Column, content: Column, inputs: Column) -> DataFrame:
    """Rows for an append-only artifact table keyed by the SHA-256 of the content; inputs are the lineage."""
    return df.select(F.sha2(content, 256).alias("payload_id"), F.lit(kind).alias("kind"), key.alias("logical_key"), inputs.alias("inputs"), F.length(content).alias("characters"))
