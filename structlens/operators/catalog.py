"""Analytic rows of the current catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structlens.functions import columns as c
from structlens.operators.labels import current_rows

FIELDS = (
    "row_seq", "title", "release_year", "min_players", "max_players", "min_play_time_minutes", "max_play_time_minutes", "popularity", "rating", "rating_count", "complexity",
    "designers", "publishers", "categories", "mechanics", "sources",
)


def current_catalog(games: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """The latest row of every id with the fields asked for; row_seq, always there, is its place in corpus order.

    Only the fields asked for are read and shuffled. Rows that tie in loaded_at
    are told apart by row_seq.
    """
    kept = ("row_seq", *[f for f in fields if f != "row_seq"])
    return current_rows(games, "id", "loaded_at", {f: F.col(f) for f in kept})


def _derived() -> dict[str, tuple[tuple[str, ...], Column]]:
    """Analytic columns: what each needs and how it is made."""
    lo, hi, short, long = (F.col(x) for x in ("min_players", "max_players", "min_play_time_minutes", "max_play_time_minutes"))
    players, times = ("min_players", "max_players"), ("min_play_time_minutes", "max_play_time_minutes")
    return {
        "player_span": (players, hi - lo),
        "player_midpoint": (players, c.midpoint(lo, hi)),
        "profile": (players, c.interval_profile(lo, hi)),
        "play_time_span": (times, long - short),
        "time_kind": (times, c.interval_kind(short, long)),
        "play_time_midpoint": (times, c.midpoint(short, long)),
        "complexity": (("complexity",), c.number_or_null(F.col("complexity"))),
        "rating": (("rating",), c.number_or_null(F.col("rating"))),
        "era": (("release_year",), c.era(F.col("release_year"))),
        "mechanic_names": (("mechanics",), F.coalesce(F.col("mechanics.name"), F.array().cast("array<string>"))),
    }


def analytic_rows(catalog: DataFrame) -> DataFrame:
    """One row per entity: intervals, spans, midpoints, profile, kind, era and label names in order with repeats.

    Columns whose fields the catalog was not asked for are left out.
    """
    there = set(catalog.columns)
    made = {name: column for name, (needs, column) in _derived().items() if there.issuperset(needs)}
    plain = ("id", "row_seq", "title", "min_players", "max_players", "min_play_time_minutes", "max_play_time_minutes", "rating_count", "release_year")
    return catalog.select(*[x for x in plain if x in there], *[column.alias(name) for name, column in made.items()])
