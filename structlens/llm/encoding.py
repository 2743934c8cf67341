"""Numbering the items of set-valued records by rarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structlens.storage import materialize

#: Copies of the dictionary and salts of the occurrences, so that an item on most records is joined by several tasks.
SALTS = 8


def dictionary(records: DataFrame, items: str, keep: Column | None = None, name: str = "dictionary") -> DataFrame:
    """(item, records, number): numbers grow with the number of records an item is in, ties by the item.

    records must hold each item of a record once. The numbers are fixed by
    writing the table. keep restricts the items by a condition on `records`.
    """
    counts = records.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("records"))
    counts = counts.where(keep) if keep is not None else counts
    return materialize(counts.orderBy("records", "item").withColumn("number", F.monotonically_increasing_id()), name)


def encode(records: DataFrame, key: str, items: str, numbers: DataFrame) -> DataFrame:
    """(key, tokens): per record the ascending numbers of its items that the dictionary has; records without any are absent."""
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS))
    spread = records.select(key, F.explode(items).alias("item"), salt.alias("_salt"))
    copies = numbers.select("item", "number", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("_salt"))
    return spread.join(copies, ["item", "_salt"]).groupBy(key).agg(F.sort_array(F.collect_list("number")).alias("tokens"))
