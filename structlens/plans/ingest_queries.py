"""Ingestion of raw thing documents into catalog rows, with statuses and reconciliation.

SQL cannot parse the documents, so these queries have no SQL counterpart; they
are tested against a tree parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structlens.operators import quality
from structlens.sources import files, things
from structlens.sources.tables import table


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return things.item_rows(table(spark, sf, "raw_artifacts"))


def thing_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The typed catalog row of every item that is ok."""
    return things.catalog_rows(_items(spark, sf))


def ingest_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status and reason of every item."""
    return _items(spark, sf).select("record_id", "item_pos", "source_id", "item_type", "status", "reason")


def ingest_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return things.manifest(_items(spark, sf))


def item_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A document for every item id of a batch document; of a repeated id the last item stands."""
    return things.item_documents(table(spark, sf, "raw_artifacts"))


def first_items(spark: SparkSession, sf: str) -> DataFrame:
    """The first item of every document that has one."""
    return things.first_items(table(spark, sf, "raw_artifacts"))


def thing_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """Anomaly flags of the freshly parsed rows."""
    rows = things.catalog_rows(_items(spark, sf)).withColumn("id", F.concat_ws("/", F.col("record_id").cast("string"), F.col("item_pos").cast("string"), "id"))
    return quality.anomaly_flags(rows, 2025)


def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog ids without a raw artifact, in corpus order, in fetch batches of 20."""
    wanted = table(spark, sf, "games").groupBy(F.regexp_replace("id", "^bgg-", "").alias("source_id")).agg(F.min("row_seq").alias("place"))
    cached = table(spark, sf, "raw_artifacts").select(F.col("source_identifier").alias("source_id")).distinct()
    return files.missing_from_cache(wanted, cached, "source_id", 20)


QUERIES = {f.__name__: f for f in (thing_rows, ingest_status, ingest_manifest, item_documents, first_items, thing_anomalies, cache_misses)}

SQL = {
    "cache_misses": """WITH wanted AS (SELECT regexp_replace(id, '^bgg-', '') AS source_id, min(row_seq) AS place FROM games GROUP BY 1),
      gone AS (SELECT * FROM wanted WHERE source_id NOT IN (SELECT source_identifier FROM raw_artifacts WHERE source_identifier IS NOT NULL))
      SELECT source_id, place, CAST((row_number() OVER (ORDER BY place) - 1) // 20 AS INTEGER) AS batch FROM gone""",
}
