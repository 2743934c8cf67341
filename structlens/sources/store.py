"""Content-addressed artifacts: payloads under their SHA-256, records of what was made from what, and keys that name them.

Both are append-only parquet tables in one folder. A payload is written once,
whatever puts it again; a record is written for every put. Records name the
payloads they were made from, so the table is the lineage graph. Records put at
once are written at once.
"""

from __future__ import annotations

import subprocess
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structlens.errors import TamperedError

#: Kinds of artifacts and the keys they are found under; {} stands for the entity (fixed names of this store).
LOGICAL_KEYS = {
    "raw": "raw/{}", "document": "document/{}", "dataset": "corpus/{}", "quality": "quality/{}", "claims": "claims/{}", "report": "report/{}", "robustness": "report/robustness/{}",
    "measurements": "measurements/{}", "examples": "examples/{}", "perspectives": "perspectives/{}", "perspective_distances": "perspectives/distances/{}", "representation": "representation/{}",
    "model": "model/{}", "prediction": "prediction/{}", "evaluation": "evaluation/{}", "probe": "evaluation/probe/{}", "intervention": "intervention/{}", "rollout": "rollout/{}", "novelty": "novelty/{}", "clusters": "clusters/{}",
    "manifest": "manifest/{}",
}

PAYLOADS = "payload_id string, media_type string, content string"
RECORDS = "record_id string, payload_id string, kind string, logical_key string, inputs array<string>, about array<string>, run_id string, created_at timestamp"


def logical_key(kind: str, entity: Column) -> Column:
    before, _, after = LOGICAL_KEYS[kind].partition("{}")
    return F.concat(F.lit(before), entity.cast("string"), F.lit(after))


def code_ref(folder: str | Path | None = None) -> dict | None:
    """The commit checked out in a folder and whether files differ from it; None without git."""
    def ask(*words: str) -> str:
        return subprocess.run(["git", *words], cwd=folder, check=True, capture_output=True, text=True).stdout.strip()

    try:
        return {"git_sha": ask("rev-parse", "HEAD"), "dirty": bool(ask("status", "--porcelain"))}
    except (OSError, subprocess.CalledProcessError):
        return None


class ArtifactStore:
    def __init__(self, spark: SparkSession, folder: str, run_id: str | None = None) -> None:
        self.spark, self.folder, self.run_id = spark, folder.rstrip("/"), run_id or uuid.uuid4().hex

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def payloads(self) -> DataFrame:
        return self._read("payloads", PAYLOADS)

    def records(self) -> DataFrame:
        return self._read("records", RECORDS)

    def put(self, df: DataFrame, kind: str, entity: Column, content: Column, inputs: Column | None = None, about: Column | None = None, media_type: str = "application/json", at: datetime | None = None) -> DataFrame:
        """Store one artifact per row and return (entity, payload_id) as written."""
        none = F.array().cast("array<string>")
        made = df.select(entity.cast("string").alias("entity"), content.alias("content"), (none if inputs is None else inputs).alias("inputs"), (none if about is None else about).alias("about")).withColumn("payload_id", F.sha2("content", 256))
        stamp = F.lit((at or datetime.now(timezone.utc)).replace(tzinfo=None)).cast("timestamp")
        key = logical_key(kind, F.col("entity"))
        rows = made.select(
            F.sha2(F.concat_ws("|", "payload_id", F.lit(kind), key, F.array_join("inputs", ","), F.array_join("about", ","), F.lit(self.run_id)), 256).alias("record_id"), "payload_id", F.lit(kind).alias("kind"), key.alias("logical_key"), "inputs", "about",
            F.lit(self.run_id).alias("run_id"), stamp.alias("created_at"),
        )
        fresh = made.select("payload_id", F.lit(media_type).alias("media_type"), "content").dropDuplicates(["payload_id"]).join(self.payloads().select("payload_id"), "payload_id", "left_anti")
        fresh.write.mode("append").parquet(f"{self.folder}/payloads")
        rows.write.mode("append").parquet(f"{self.folder}/records")
        return made.select("entity", "payload_id")

    def latest(self, kind: str) -> DataFrame:
        """(logical_key, payload_id, content) last put under each key of a kind."""
        last = self.records().where(F.col("kind") == kind).groupBy("logical_key").agg(F.max_by("payload_id", F.struct("created_at", "record_id")).alias("payload_id"))
        return last.join(self.payloads(), "payload_id")

    def lineage(self, payload_id: str, most: int = 50) -> DataFrame:
        """(payload_id, depth) of everything an artifact was made from, itself included at depth 0."""
        edges = self.records().select("payload_id", F.explode("inputs").alias("input")).distinct()
        seen = level = self.spark.createDataFrame([(payload_id, 0)], "payload_id string, depth int")
        for depth in range(1, most + 1):
            level = level.join(edges, "payload_id").select(F.col("input").alias("payload_id"), F.lit(depth).alias("depth")).distinct().join(seen.select("payload_id"), "payload_id", "left_anti")
            found = level.collect()  # one level of one artifact's ancestors
            if not found:
                break
            level = self.spark.createDataFrame(found, "payload_id string, depth int")
            seen = seen.unionByName(level)
        return seen

    def verify(self) -> int:
        """The number of payloads, all of which still have their id; TamperedError names some that have not."""
        wrong = self.payloads().where(F.sha2("content", 256) != F.col("payload_id")).select("payload_id").limit(5).collect()
        if wrong:
            raise TamperedError("content changed under " + ", ".join(r[0] for r in wrong))
        return self.payloads().count()
