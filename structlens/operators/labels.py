"""Current catalog rows and the normalised label lists they carry."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structlens.operators.standing import newest


def current_rows(df: DataFrame, key: str, latest: str, columns: Mapping[str, Column]) -> DataFrame:
    """One row per key: the one with the greatest `latest`, null being least.

    Rows that tie are separated by the columns themselves. Partial maxima are
    taken before the shuffle, so a key repeated any number of times is no hot
    spot. A null key is no record and is left out.
    """
    slim = df.select(F.col(key).alias("_key"), F.struct(F.col(latest).alias("_at"), *[c.alias(n) for n, c in columns.items()]).alias("_row"))
    best = slim.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.max("_row").alias("_row"))
    return best.select(F.col("_key").alias(key), *[F.col(f"_row.{n}").alias(n) for n in columns])


def label_name(value: Column) -> Column:
    """Lower case; every run of blanks, tabs, no-break spaces, hyphens and underscores one blank, none at the ends; empty is null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(value), r"[\s\x{A0}_-]+", " ")), F.lit(""))


def label_list(values: Column, pick=lambda x: x, prefix: str = "") -> Column:
    """The labels of an array in its order, repeats kept; null arrays, null and empty names give nothing."""
    names = F.array_compact(F.transform(F.coalesce(values, F.array()), lambda x: label_name(pick(x))))
    return F.transform(names, lambda n: F.concat(F.lit(prefix), n)) if prefix else names


def game_labels(games: DataFrame) -> DataFrame:
    """(id, written): every label of a game's current row as kind:name, as often as it is written."""
    mechanics = label_list(F.col("mechanics.name"), prefix="mechanic:")
    categories = label_list(F.col("categories"), prefix="category:")
    current = newest(games, F.col("id"), [F.col("loaded_at")], {"written": F.concat(mechanics, categories)})
    return current.where(F.col("_key").isNotNull()).withColumnRenamed("_key", "id")
