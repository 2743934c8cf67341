"""Joins that the situation and event models need beyond plain equi-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key in the given order, which must be total for a defined result."""
    values = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in values])


def first_match(left: DataFrame, right: DataFrame, on: Sequence[str], or_null: str, order: str, take: Sequence[str]) -> DataFrame:
    """left with `take` of the first right row (by order) equal in `on` whose `or_null` is equal or null; null without a match.

    The alternative is split into two equi-joins, on all keys and on the keys
    without or_null, so neither side is compared row by row.
    """
    exact = first_by(right.where(F.col(or_null).isNotNull()).select(*on, or_null, order, *take), [*on, or_null], [order])
    loose = first_by(right.where(F.col(or_null).isNull()).select(*on, order, *take), on, [order])
    pack = lambda df, name, keys: df.select(*keys, F.struct(order, *take).alias(name))
    both = left.join(pack(exact, "_exact", [*on, or_null]), [*on, or_null], "left").join(pack(loose, "_loose", list(on)), list(on), "left")
    best = F.when(F.col("_exact").isNull(), F.col("_loose")).when(F.col("_loose").isNull(), F.col("_exact")).when(F.col(f"_exact.{order}") <= F.col(f"_loose.{order}"), F.col("_exact")).otherwise(F.col("_loose"))
    return both.withColumn("_best", best).select(*left.columns, *[F.col(f"_best.{c}").alias(c) for c in take])


def unordered_pairs(df: DataFrame, within: Sequence[str], item: str, take: Sequence[str]) -> DataFrame:
    """Pairs (item_a < item_b) of rows that share `within`, with both sides' `take`."""
    a = df.select(*within, F.col(item).alias(f"{item}_a"), *[F.col(c).alias(f"{c}_a") for c in take])
    b = df.select(*within, F.col(item).alias(f"{item}_b"), *[F.col(c).alias(f"{c}_b") for c in take])
    return a.join(b, list(within)).where(F.col(f"{item}_a") < F.col(f"{item}_b"))


def ordered_pairs(df: DataFrame, within: Sequence[str], item: str, take: Sequence[str]) -> DataFrame:
    """Pairs (item_a, item_b) of different rows that share `within`, both ways round."""
    a = df.select(*within, F.col(item).alias(f"{item}_a"), *[F.col(c).alias(f"{c}_a") for c in take])
    b = df.select(*within, F.col(item).alias(f"{item}_b"), *[F.col(c).alias(f"{c}_b") for c in take])
    return a.join(b, list(within)).where(F.col(f"{item}_a") != F.col(f"{item}_b"))


def numbered(df: DataFrame, within: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """Rows numbered from 0 inside each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1)


def require_all(left: DataFrame, right: DataFrame, on: Sequence[str], what: str) -> DataFrame:
    """left joined with right; a left row without partner stops the job."""
    marked = left.join(right.withColumn("_there", F.lit(True)), list(on), "left")
    guard = F.when(F.col("_there"), True).otherwise(F.raise_error(F.concat(F.lit(f"missing {what}: "), F.to_json(F.struct(*on)))).cast("boolean"))
    return marked.where(guard).drop("_there")
