"""Ingest runs: ids in, documents fetched where the cache lacks them, catalog rows, manifest and artifacts out.

Only fetching runs on the driver, because a source is asked politely and in
turn; parsing, judging, writing and storing are jobs over tables.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structlens.errors import NotFoundError, StructlensError
from structlens.operators import quality
from structlens.sources import dictionary, files, store, things
from structlens.sources.connector import Fetcher
from structlens.sources.raw_cache import RAW, RawCache
from structlens.storage import materialize


@dataclass(frozen=True)
class RunResult:
    """What a run left: games, records (source_id, status, reason, cached, item_type, game_id, title), counts, and where."""

    games: DataFrame
    records: DataFrame
    counts: dict[str, int]
    manifest_path: str | None
    jsonl_path: str | None


def prefetch(spark: SparkSession, cache: RawCache, fetcher: Fetcher, ids: list[str], force: bool = False, go_on: bool = True, batch: int = 200) -> tuple[set[str], dict[str, str]]:
    """(ids the cache had, reason per id that could not be fetched) after fetching what is missing, or everything if forced."""
    wanted = spark.createDataFrame([(i,) for i in ids], "source_identifier string")
    had = set() if force else set(ids) - {r[0] for r in cache.missing(wanted).collect()}
    errors: dict[str, str] = {}
    todo = [i for i in ids if i not in had]
    for at in range(0, len(todo), batch):
        some = todo[at : at + batch]
        try:
            found = fetcher.fetch(some)
        except StructlensError as failure:
            if not go_on:
                raise
            errors |= dict.fromkeys(some, str(failure))
            continue
        errors |= {i: "not_found" for i in some if i not in found}
        rows = [(d.source, d.source_identifier, d.retrieved_at, d.request_url, d.content_type, d.http_status, d.body) for d in found.values()]
        if rows:
            cache.save(spark.createDataFrame(rows, RAW), overwrite=force)
    if errors and not go_on:
        raise NotFoundError("no item " + ", ".join(sorted(errors)))
    return had, errors


def judged(spark: SparkSession, cache: RawCache, ids: list[str], had: set[str], errors: dict[str, str]) -> DataFrame:
    """One row per id asked for, in order: the first item of its document with status and catalog row, or the error."""
    asked = spark.createDataFrame([(i, n, i in had, errors.get(i)) for n, i in enumerate(ids)], "source_identifier string, place int, cached boolean, failed string")
    raw = cache.load(asked).join(asked.select("source_identifier", "place"), "source_identifier").withColumn("artifact_id", F.col("place").cast("bigint"))
    items = materialize(things.item_rows(raw), "items")
    first = items.where("item_pos = 1").withColumnRenamed("record_id", "_place")
    both = asked.join(first, F.col("place") == F.col("_place"), "left").join(raw.select("source_identifier", F.sha2("body", 256).alias("raw_id")), "source_identifier", "left")
    reason = F.coalesce("failed", F.when(F.col("raw_id").isNull(), "not_found").when(F.col("_place").isNull(), "no_item").otherwise(F.col("reason")))
    return both.withColumn("reason", reason).withColumn("status", F.when(F.col("failed").isNotNull() | F.col("_place").isNull(), "error").otherwise(F.col("status")))


def _game_columns() -> list[str]:
    return [f.split()[0] for f in dictionary.GAME_FIELDS.split(", ")]


def run(spark: SparkSession, out: str, fetcher: Fetcher, ids: list[str], force: bool = False, go_on: bool = True, corpus_id: str | None = None, corpus_version: str = "1", ids_sha256: str | None = None, source: str = "catalog", latest_year: int | None = None) -> RunResult:
    """Ingest ids: without go_on the first failure ends the run; with a corpus_id a manifest and a quality report are left too.

    out/raw is the cache, out/processed holds games.jsonl and a JSON file per
    game part, out/derived the manifest, out/artifacts the store. A run may be
    repeated: what is cached is not fetched again.
    """
    started = datetime.now(timezone.utc)
    ids = list(dict.fromkeys(ids))
    cache, artifacts = RawCache(spark, f"{out}/raw"), store.ArtifactStore(spark, f"{out}/artifacts", uuid.uuid4().hex)
    had, errors = prefetch(spark, cache, fetcher, ids, force, go_on)
    rows = materialize(judged(spark, cache, ids, had, errors), "judged")
    failed = rows.where("status = 'error'").select("source_identifier", "reason").limit(5).collect()
    if failed and not go_on:
        raise StructlensError("; ".join(f"{r[0]}: {r[1]}" for r in failed))
    ok = rows.where("status = 'ok'")
    games = ok.select("place", *_game_columns())
    raw = cache.load(spark.createDataFrame([(i,) for i in ids], "source_identifier string"))
    artifacts.put(raw, "raw", F.col("source_identifier"), F.col("body"), media_type="text/xml")
    document = F.to_json(F.struct(*_game_columns()), {"ignoreNullFields": "false"})
    artifacts.put(ok, "document", F.col("id"), document, F.array("raw_id"))
    jsonl = f"{out}/processed/games.jsonl"
    games.orderBy("place").select(F.to_json(F.struct(*_game_columns()), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(jsonl)
    ok.select(F.col("source_identifier").alias("source_id"), document.alias("value")).write.mode("overwrite").partitionBy("source_id").text(f"{out}/processed/games")
    records = rows.select("place", F.col("source_identifier").alias("source_id"), "status", "cached", "reason", "item_type", F.when(F.col("status") == "ok", F.col("id")).alias("game_id"), "title")
    by = {r["status"]: r["n"] for r in records.groupBy("status").agg(F.count("*").alias("n")).collect()}
    n_cached = sum(1 for i in ids if i in had)
    counts = {"requested": len(ids), "ok": by.get("ok", 0), "skipped": by.get("skipped", 0), "errors": by.get("error", 0), "cached": n_cached, "fetched": len(ids) - n_cached}
    manifest = None
    if corpus_id is not None:
        manifest = f"{out}/derived/{corpus_id}.manifest.json"
        group = lambda status: [{k: v for k, v in r.asDict().items() if v is not None and k != "place"} for r in records.where(F.col("status") == status).orderBy("place").collect()]
        body = {
            "corpus_id": corpus_id, "corpus_version": corpus_version, "source": source, "started_at": started.isoformat(), "finished_at": datetime.now(timezone.utc).isoformat(), "jsonl": jsonl, "ids_file_sha256": ids_sha256,
            "run_id": artifacts.run_id, "requested_ids": ids, "ok": group("ok"), "skipped": group("skipped"), "errors": group("error"), "counts": counts,
        }
        if (ref := store.code_ref(Path(__file__).parent)) is not None:
            body["code_ref"] = ref
        Path(manifest).parent.mkdir(parents=True, exist_ok=True)
        Path(manifest).write_text(json.dumps(body, indent=2) + "\n")
        lines = spark.read.text(jsonl).agg(F.array_join(F.collect_list("value"), "\n").alias("v"))  # the corpus is a frozen id list
        made = artifacts.put(lines, "dataset", F.lit(corpus_id), F.col("v"), F.lit(ok.select(F.sha2(document, 256)).rdd.map(lambda r: r[0]).collect()).cast("array<string>"))
        flags = quality.anomaly_flags(games.withColumnRenamed("place", "row_seq"), latest_year or started.year)
        report = flags.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*flags.columns)))).alias("v")).crossJoin(made.select("payload_id"))  # one row each
        artifacts.put(report, "quality", F.lit(corpus_id), F.col("v"), F.array("payload_id"), F.array("payload_id"))
    return RunResult(games, records, counts, manifest, jsonl)


def run_corpus(spark: SparkSession, out: str, fetcher: Fetcher, spec: dictionary.CorpusSpec, offset: int = 0, limit: int | None = None, force: bool = False) -> RunResult:
    """Ingest a slice of a corpus' id list, going on after errors."""
    ids = [r["id"] for r in files.read_id_list(spark, spec.ids_file, offset, limit).orderBy("place").collect()]
    return run(spark, out, fetcher, ids, force, True, spec.corpus_id, spec.version, spec.ids_sha256())
