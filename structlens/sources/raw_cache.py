"""Raw documents as they were received: an append-only table that keeps the first document of an id unless told to replace it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "source string, source_identifier string, retrieved_at timestamp, request_url string, content_type string, http_status int, body string"


class RawCache:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _all(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(RAW).parquet(self.folder) if there else self.spark.createDataFrame([], RAW)

    def load(self, ids: DataFrame | None = None) -> DataFrame:
        """The document that stands for each id: the one received last."""
        wanted = self._all() if ids is None else self._all().join(ids.select("source_identifier").distinct(), "source_identifier", "left_semi")
        names = [f.split()[0] for f in RAW.split(", ")]
        best = wanted.groupBy("source_identifier").agg(F.max(F.struct("retrieved_at", *[n for n in names if n != "retrieved_at"])).alias("_r"))
        return best.select(*[F.col(f"_r.{n}").alias(n) for n in names])

    def save(self, documents: DataFrame, overwrite: bool = False) -> int:
        """Add documents, of ids not yet there only unless overwrite; the number added."""
        rows = documents.select(*[f.split()[0] for f in RAW.split(", ")]).where(F.col("source_identifier").isNotNull())
        if not overwrite:
            rows = rows.dropDuplicates(["source_identifier"]).join(self._all().select("source_identifier"), "source_identifier", "left_anti")
        rows = rows.cache()
        added = rows.count()
        if added:
            rows.write.mode("append").parquet(self.folder)
        rows.unpersist()
        return added

    def missing(self, ids: DataFrame) -> DataFrame:
        return ids.join(self._all().select("source_identifier"), "source_identifier", "left_anti")
