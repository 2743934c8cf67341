"""A landing folder of JSON Lines as a stream: rows and rejects are appended, label counts kept up to date.

What a batch job over the same files would give is what the stream has given
once it has seen them; files count once, whatever restarts in between, by the
checkpoint of the stream and the batch number each write carries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from structlens.sources import files
from structlens.sources.things import GAME_FIELDS


def landing_lines(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New lines of the folder as they arrive."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).where(F.trim("value") != "")


def parse_lines(lines: DataFrame) -> DataFrame:
    """(value, g, reason, ok): g is the row, reason why the batch reader rejects the line, ok that it doesn't."""
    return files.judged_games(lines.select("value")).select("value", "g", "reason", F.col("reason").isNull().alias("ok"))


def keep_up(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each batch to out/games and out/rejects, one folder per batch, so that a repeated batch replaces itself."""
    names = [f.split()[0] for f in GAME_FIELDS.split(", ")]

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.where("ok").select([F.col(f"g.{n}").alias(n) for n in names]).write.mode("overwrite").parquet(f"{out}/games/batch={number}")
        batch.where("not ok").select("value", "reason").write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
        batch.unpersist()

    return parse_lines(lines).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def label_counts(lines: DataFrame) -> DataFrame:
    """Running occurrences per mechanic name, for complete or update output."""
    return parse_lines(lines).where("ok").select(F.explode("g.mechanics.name").alias("name")).groupBy("name").agg(F.count("*").alias("occurrences"))


def event_windows(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events and value per window and type; events later than `late` behind the newest are dropped by the watermark."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return stamped.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
