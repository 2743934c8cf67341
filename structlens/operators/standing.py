"""One row per key without moving the rows: only keys that come more than once are looked at closely.

Rows of a delivery mostly have a key of their own. Counting keys shuffles keys
alone; of the keys found more than once the standing row is chosen by its place
in the input, and every other row of such a key is dropped where it is read.
Wide columns (documents, label lists) never cross the network for it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structlens.storage import materialize

#: Up to so many repeated keys are sent to every executor (some tens of MB); beyond, the rows are joined by a shuffle.
BROADCAST_KEYS = 500_000


def places(df: DataFrame) -> list[Column]:
    """Columns that tell a stored row from every other: its file and its number there; none if df is not read from files."""
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return []
    found = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        df.select(*found)
    except AnalysisException:
        return []
    return found


def newest(df: DataFrame, key: Column, latest: Sequence[Column], columns: Mapping[str, Column]) -> DataFrame:
    """(_key, columns): of every key the row greatest in `latest`, null being least.

    Rows that tie in all of `latest` are told apart by their place in the input,
    or by the columns themselves if df is not read from files. A null key is a
    key like any other. An empty table gives no row.
    """
    place = places(df)
    at = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(latest)])
    named = [c.alias(n) for n, c in columns.items()]
    if not place:
        best = df.select(key.alias("_key"), F.struct(at.alias("_at"), *named).alias("_row")).groupBy("_key").agg(F.max("_row").alias("_row"))
        return best.select("_key", *[F.col(f"_row.{n}").alias(n) for n in columns])
    slim = df.select(key.alias("_key"), at.alias("_at"), F.struct(*[c.alias(f"_p{i}") for i, c in enumerate(place)]).alias("_place"), *named)
    repeated = materialize(slim.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_key").alias("_twice")), "repeated-keys")
    count = repeated.count()
    if not count:
        return slim.select("_key", *columns)
    sent = F.broadcast if count <= BROADCAST_KEYS else lambda x: x
    again = slim.select("_key", "_at", "_place").join(sent(repeated), F.col("_key").eqNullSafe(F.col("_twice")))
    best = again.groupBy("_twice").agg(F.max(F.struct("_at", "_place")).getField("_place").alias("_best"))
    marked = slim.join(sent(best), F.col("_key").eqNullSafe(F.col("_twice")), "left")
    return marked.where(F.col("_best").isNull() | (F.col("_best") == F.col("_place"))).select("_key", *columns)
