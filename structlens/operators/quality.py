"""Integrity of a catalog: missingness, anomalies, provenance, duplicates, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structlens.functions.columns import number_or_null, rounded
from structlens.operators.stats import unpivot

SCALARS = ("id", "title", "release_year", "min_players", "max_players", "min_play_time_minutes", "max_play_time_minutes", "popularity", "rating", "rating_count", "complexity")
LISTS = ("designers", "publishers", "categories", "mechanics", "sources")
NUMBERS = ("release_year", "min_players", "max_players", "min_play_time_minutes", "max_play_time_minutes", "rating", "rating_count", "complexity")

#: Limits beyond which a value is flagged (fixed values).
YEAR_FLOOR, PLAYERS_OVER, MINUTES_OVER = 1800, 20, 480
RATING_SCALE, COMPLEXITY_SCALE = (1.0, 10.0), (1.0, 5.0)
PUBLISHERS_FROM, MECHANICS_FROM, CATEGORIES_FROM = 30, 15, 8
EXTREME_PLAYERS, EXTREME_SPAN, EXTREME_MINUTES = 12, 20, 300
TITLE_MARKERS = ("expansion", "accessory", "promo")


def missingness(catalog: DataFrame) -> DataFrame:
    """(field, kind, present, missing_null, empty_list, pct_missing_null, pct_empty_list) of all 16 fields, in one pass."""
    nulls = [F.count_if(F.col(f).isNull()).alias(f"n_{f}") for f in (*SCALARS, *LISTS)]
    empties = [F.count_if(F.size(f) == 0).alias(f"e_{f}") for f in LISTS]
    one = catalog.agg(F.count("*").alias("total"), *nulls, *empties)
    percent = lambda part: rounded(F.coalesce(F.try_divide(100.0 * part, F.col("total")), F.lit(0.0)))
    none_long, none_double = F.lit(None).cast("bigint"), F.lit(None).cast("double")

    def field(name: str, is_list: bool) -> Column:
        null, empty = F.col(f"n_{name}"), F.col(f"e_{name}") if is_list else none_long
        present = F.col("total") - null - (empty if is_list else 0)
        return F.struct(
            F.lit(name).alias("field"), F.lit("list" if is_list else "scalar").alias("kind"), present.alias("present"), null.alias("missing_null"), empty.alias("empty_list"),
            percent(null).alias("pct_missing_null"), (percent(empty) if is_list else none_double).alias("pct_empty_list"),
        )

    return one.select(F.inline(F.array(*[field(f, False) for f in SCALARS], *[field(f, True) for f in LISTS])))


def numeric_summaries(catalog: DataFrame) -> DataFrame:
    """(field, n, lowest, median, mean, highest, stdev) of eight numeric fields; NaN counts as null."""
    clean = catalog.select(*[(number_or_null(F.col(f)) if f in ("rating", "complexity") else F.col(f)).alias(f) for f in NUMBERS])
    long = unpivot(clean, [], NUMBERS, "field")
    return long.groupBy("field").agg(
        F.count("value").alias("n"), F.min("value").alias("lowest"), F.percentile("value", F.lit(0.5)).alias("median"), rounded(F.avg("value")).alias("mean"), F.max("value").alias("highest"),
        rounded(F.when(F.count("value") == 1, 0.0).otherwise(F.stddev_samp("value"))).alias("stdev"),
    )


def list_lengths(catalog: DataFrame) -> DataFrame:
    """(field, n, shortest, median, mean, longest) of the list fields; null lists have length 0."""
    sized = catalog.select(*[F.greatest(F.size(f), F.lit(0)).alias(f) for f in LISTS])
    long = unpivot(sized, [], LISTS, "field")
    return long.groupBy("field").agg(F.count("value").alias("n"), F.min("value").alias("shortest"), F.percentile("value", F.lit(0.5)).alias("median"), rounded(F.avg("value")).alias("mean"), F.max("value").alias("longest"))


def anomaly_flags(catalog: DataFrame, latest_year: int) -> DataFrame:
    """(id, flag_no, code): zero or more of 14 codes per record; flag_no keeps the order of the checks."""
    year, lo, hi, short, long, votes = (F.col(x) for x in ("release_year", "min_players", "max_players", "min_play_time_minutes", "max_play_time_minutes", "rating_count"))
    rating, weight = number_or_null(F.col("rating")), number_or_null(F.col("complexity"))
    few = votes.isNull() | (votes == 0)
    checks: list[tuple[str, Column]] = [("implausible_year", (year < YEAR_FLOOR) | (year > latest_year)), ("player_range_inverted", lo > hi), ("play_time_range_inverted", short > long)]
    for value in (lo, hi, short, long):
        checks += [("negative_value", value < 0), ("unexpected_zero", value == 0)]
    checks += [
        ("negative_value", votes < 0),
        ("large_player_count", hi > PLAYERS_OVER),
        ("long_play_time", long > MINUTES_OVER),
        ("rating_off_scale", ~rating.between(*RATING_SCALE)),
        ("complexity_off_scale", ~weight.between(*COMPLEXITY_SCALE)),
        ("rating_count_without_rating", rating.isNull() & ~few),
        ("rating_without_count", rating.isNotNull() & few),
        ("large_publisher_list", F.size("publishers") >= PUBLISHERS_FROM),
        ("large_mechanic_list", F.size("mechanics") >= MECHANICS_FROM),
        ("large_category_list", F.size("categories") >= CATEGORIES_FROM),
    ]
    flags = F.array_compact(F.array(*[F.when(condition, F.struct(F.lit(i).alias("flag_no"), F.lit(code).alias("code"))) for i, (code, condition) in enumerate(checks)]))
    return catalog.select("id", F.inline(flags))


def provenance_issues(catalog: DataFrame, source: str, source_type: str, url_part: str) -> DataFrame:
    """(id, issue): a source count other than one ends the checks of a record."""
    s = F.get("sources", F.lit(0))
    known = F.coalesce(s["source_identifier"], F.lit("")) != ""
    rules = [
        ("source", ~s["source"].eqNullSafe(F.lit(source))),
        ("source_type", ~s["source_type"].eqNullSafe(F.lit(source_type))),
        ("url", ~F.coalesce(F.contains(s["url"], F.lit(url_part)), F.lit(False))),
        ("missing_identifier", ~known),
        ("identifier_mismatch", known & (F.col("id") != F.concat(F.lit("bgg-"), s["source_identifier"]))),
        ("missing_retrieved_at", s["retrieved_at"].isNull()),
    ]
    single = F.array_compact(F.array(*[F.when(c, n) for n, c in rules]))
    issues = F.when(F.coalesce(F.size("sources"), F.lit(0)) == 1, single).otherwise(F.array(F.lit("source_count")))
    return catalog.select("id", F.explode(issues).alias("issue"))


def duplicates(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def repeated_labels(catalog: DataFrame) -> DataFrame:
    """(id, repeated): mechanic ids written more than once in a record, sorted and joined."""
    ids = catalog.select("id", F.explode(F.col("mechanics.id")).alias("label")).where(F.col("label").isNotNull())
    twice = ids.groupBy("id", "label").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return twice.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("repeated"))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys on one side only."""
    a, b = left.select(key).where(F.col(key).isNotNull()).distinct(), right.select(key).where(F.col(key).isNotNull()).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))


def extreme_rows(rows: DataFrame, players: int = EXTREME_PLAYERS, span: int = EXTREME_SPAN, minutes: int = EXTREME_MINUTES) -> DataFrame:
    """Rows at or beyond a limit, with the reasons joined by '; '."""
    limits = (("max_players", players), ("player_span", span), ("max_play_time_minutes", minutes))
    reason = F.concat_ws("; ", *[F.when(F.col(c) >= limit, F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c, limit in limits])
    return rows.withColumn("reason", reason).where(F.col("reason") != "")


def titles_with(catalog: DataFrame, markers: Sequence[str] = TITLE_MARKERS) -> DataFrame:
    return catalog.where(F.lower("title").rlike("|".join(markers))).select("id", "title")


def without_taxonomy(catalog: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return catalog.where(empty("categories") & empty("mechanics")).select("id", "title")


def integrity_report(delivered: DataFrame, catalog: DataFrame, source: str, source_type: str, url_part: str) -> DataFrame:
    """(check, records): how many records each integrity check points at."""
    checks = {
        "delivered_rows": delivered,
        "distinct_ids": catalog,
        "repeated_ids": duplicates(delivered, "id"),
        "repeated_titles": duplicates(catalog, "title"),
        "empty_taxonomy": without_taxonomy(catalog),
        "repeated_labels": repeated_labels(catalog),
        "expansion_like_titles": titles_with(catalog),
        "provenance_issues": provenance_issues(catalog, source, source_type, url_part),
    }
    parts = [df.agg(F.count("*").alias("records")).select(F.lit(name).alias("check"), "records") for name, df in checks.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
