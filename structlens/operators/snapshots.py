"""What changed between consecutive full snapshots of a table.

Every snapshot is laid out in key order inside hash buckets and cut into
content-defined chunks: a key whose own hash hits a boundary pattern opens a
chunk, so the same keys open chunks in every snapshot, and a row added or
removed disturbs the cut around itself only. Per chunk a 128-bit digest of its
rows is kept. Chunks whose digest equals the one the neighbouring snapshot has
under the same opening key are discarded; rows of the others are matched by key.

The rows cross the network twice, reduced to key and compared values: once to
let one row per snapshot and key stand (partially aggregated before the shuffle,
so a key delivered any number of times is no hot spot) and once into the
buckets. Chunking, digest comparison and the match by key all reuse the bucket
partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structlens.session import shuffle_width

#: Up to so many distinct snapshots, their order is sent to the executors as a literal table.
SNAPSHOT_BROADCAST_LIMIT = 10_000


def clean_key(column: str | Column) -> Column:
    """A key in lower case, without blanks, tabs, line ends or no-break spaces around it; empty is null."""
    text = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.regexp_replace(F.lower(text), r"^[\s\x{A0}]+|[\s\x{A0}]+$", ""), F.lit(""))


def missing_as_null(value: Column, kind: str) -> Column:
    return F.when(F.isnan(value), F.lit(None)).otherwise(value) if kind in ("double", "float") else value


def _neighbours(df: DataFrame, snapshot: str) -> DataFrame:
    """(snapshot, before_id, after_id) in ascending order of the snapshots present."""
    ids = df.select(F.col(snapshot).alias("_snap")).where(F.col("_snap").isNotNull()).distinct()
    w = Window.orderBy("_snap")  # one row per snapshot, not per record
    order = ids.select("_snap", F.lag("_snap").over(w).alias("_before"), F.lead("_snap").over(w).alias("_after"))
    found = order.limit(SNAPSHOT_BROADCAST_LIMIT + 1).collect()
    if len(found) > SNAPSHOT_BROADCAST_LIMIT:
        return order
    return F.broadcast(df.sparkSession.createDataFrame(found, order.schema))


def standing_rows(df: DataFrame, snapshot: str, key: Column, values: Mapping[str, Column], latest: Sequence[Column]) -> DataFrame:
    """One row per snapshot and key: the one greatest in `latest`, null being least.

    Rows equal in all of `latest` are separated by the values themselves, so the
    choice never depends on the order of delivery. Rows without snapshot or key
    belong to no record and are left out.
    """
    ordered = [c.alias(f"_o{i}") for i, c in enumerate(latest)]
    slim = df.select(F.col(snapshot).alias("_snap"), key.alias("_key"), F.struct(*ordered, *[c.alias(n) for n, c in values.items()]).alias("_row"))
    slim = slim.where(F.col("_snap").isNotNull() & F.col("_key").isNotNull())
    best = slim.groupBy("_snap", "_key").agg(F.max("_row").alias("_row"))
    return best.select("_snap", "_key", *[F.col(f"_row.{n}").alias(n) for n in values])


def _chunks(df: DataFrame, snapshot: str, key: Column, values: Mapping[str, Column], latest: Sequence[Column], mean_chunk: int, buckets: int | None) -> DataFrame:
    """One row per chunk with digest, rows and the comparison with both neighbours."""
    width = buckets or 4 * shuffle_width(df.sparkSession)
    rows = standing_rows(df, snapshot, key, values, latest)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(width))).repartition("_bucket")
    opens = F.pmod(F.xxhash64("_key", F.lit("chunk")), F.lit(mean_chunk)) == 0
    along = Window.partitionBy("_bucket", "_snap").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_chunk", F.last(F.when(opens, F.col("_key")), ignorenulls=True).over(along))
    names = list(values)
    content = [F.col("_key"), *[F.col(n) for n in names], *[F.col(n).isNull() for n in names]]
    chunks = rows.groupBy("_bucket", "_chunk", "_snap").agg(
        F.struct(
            F.bit_xor(F.xxhash64(*content)).alias("x"),
            F.bit_xor(F.xxhash64(F.lit("second"), *content)).alias("y"),
            F.count("*").alias("n"),
        ).alias("_digest"),
        F.collect_list(F.struct("_key", *names)).alias("_rows"),
    )
    chunks = chunks.join(_neighbours(df, snapshot), "_snap")
    beside = Window.partitionBy("_bucket", "_chunk").orderBy("_snap")
    same_before = (F.lag("_snap").over(beside) == F.col("_before")) & (F.lag("_digest").over(beside) == F.col("_digest"))
    same_after = (F.lead("_snap").over(beside) == F.col("_after")) & (F.lead("_digest").over(beside) == F.col("_digest"))
    return chunks.withColumn("_same_before", F.coalesce(same_before, F.lit(False))).withColumn("_same_after", F.coalesce(same_after, F.lit(False)))


def snapshot_changes(
    df: DataFrame,
    snapshot: str,
    key: Column,
    values: Mapping[str, Column],
    latest: Sequence[Column],
    mean_chunk: int = 64,
    buckets: int | None = None,
) -> DataFrame:
    """Rows added, removed or changed in each snapshot against the next lower one present.

    Returns (snapshot_id, key, change_kind, before, after): before and after are
    structs of `values`, null where the record is absent. The first snapshot has
    nothing to be compared with and yields no row.

    Defined cases: null equals null and NaN counts as null if the caller maps it
    so (missing_as_null); rows without snapshot or key are no records, though a
    snapshot with no other rows is present and empty; repeated
    rows and ties give one standing row; an empty table gives no row; other
    columns of df, whatever their names, are not read. mean_chunk and buckets
    shape the work, never the result.
    """
    chunks = _chunks(df, snapshot, key, values, latest, mean_chunk, buckets)
    names = list(values)
    roles = F.array_compact(
        F.array(
            F.when(F.col("_before").isNotNull() & ~F.col("_same_before"), F.struct(F.col("_snap").alias("at"), F.lit(True).alias("new"))),
            F.when(F.col("_after").isNotNull() & ~F.col("_same_after"), F.struct(F.col("_after").alias("at"), F.lit(False).alias("new"))),
        )
    )
    open_chunks = chunks.select("_bucket", "_rows", F.explode(roles).alias("_role"))
    rows = open_chunks.select("_bucket", F.col("_role.at").alias("snapshot_id"), F.col("_role.new").alias("_new"), F.inline("_rows"))
    held = F.struct(*names)
    matched = rows.groupBy("_bucket", "snapshot_id", "_key").agg(
        F.max(F.when(F.col("_new"), held)).alias("after"),
        F.max(F.when(~F.col("_new"), held)).alias("before"),
        F.bool_or("_new").alias("_in"),
        F.bool_or(~F.col("_new")).alias("_out"),
    )
    kind = (
        F.when(F.col("_in") & ~F.col("_out"), "added")
        .when(F.col("_out") & ~F.col("_in"), "removed")
        .when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    )
    return matched.select("snapshot_id", F.col("_key").alias("key"), kind.alias("change_kind"), "before", "after").where(F.col("change_kind").isNotNull())


def chunk_report(df: DataFrame, snapshot: str, key: Column, values: Mapping[str, Column], latest: Sequence[Column], mean_chunk: int = 64, buckets: int | None = None) -> DataFrame:
    """Per snapshot: chunks, rows, and how many of both the digest comparison set aside."""
    chunks = _chunks(df, snapshot, key, values, latest, mean_chunk, buckets).select("_snap", "_digest", "_same_before")
    same = F.col("_same_before")
    return chunks.groupBy(F.col("_snap").alias("snapshot_id")).agg(
        F.count("*").alias("chunks"),
        F.sum("_digest.n").alias("rows"),
        F.count_if(same).alias("chunks_set_aside"),
        F.coalesce(F.sum(F.when(same, F.col("_digest.n"))), F.lit(0)).alias("rows_set_aside"),
    )
