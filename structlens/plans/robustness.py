"""The robustness report: whether the findings of a catalog hold under other representations, subsets and thresholds.

Every table is aggregated in Spark; only report-sized results reach the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structlens.functions import columns as c
from structlens.operators import catalog as cat
from structlens.operators import quality, stats
from structlens.plans import report
from structlens.storage import materialize

TIME = ("min_play_time_minutes", "max_play_time_minutes", "play_time_midpoint", "play_time_span")
PLAYERS = ("min_players", "max_players", "player_span", "player_midpoint")
COVERED = ("release_year", "min_players", "max_players", "min_play_time_minutes", "max_play_time_minutes", "complexity", "popularity", "mechanics", "rating")
BOXES = ("release_year", "complexity", "min_players", "max_players", "player_span", "min_play_time_minutes", "max_play_time_minutes", "play_time_span", "mechanics_per_game")
THRESHOLDS = (3, 5, 10, 20)
#: When a finding counts (fixed values): an association that persists, one worth a word, representations that differ, a shift worth a word, a notable lift.
PERSISTS, WORTH, DIFFERS, SHIFTS, NOTABLE = 0.5, 0.1, 0.15, 0.05, 1.5


def _records(df: DataFrame, order: list[str]) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def _grid(rows: DataFrame, names: tuple[str, ...], y: str = "complexity") -> list[dict]:
    return _records(stats.correlation_grid(rows, [(x, F.col(x), y, F.col(y)) for x in names]), ["x", "y"])


def extremes(rows: DataFrame) -> DataFrame:
    """Extreme records, most players first, then the widest range, then in corpus order."""
    return quality.extreme_rows(rows).orderBy(F.coalesce("max_players", F.lit(0)).desc(), F.coalesce("player_span", F.lit(0)).desc(), "row_seq")


def time_weight(rows: DataFrame) -> dict:
    logs = [(f"log_{x}", c.log_positive(F.col(x)), "complexity", F.col("complexity")) for x in TIME[:3]]
    long = stats.unpivot(rows.select("id", "complexity", *TIME), ["id", "complexity"], list(TIME), "grid", "x").withColumnRenamed("complexity", "y")
    dropped = long.join(quality.extreme_rows(rows).select("id", "reason").distinct(), "id")
    full = stats.spearman(long).select("grid", F.col("n").alias("n_full"), F.col("rho").alias("rho_full"))
    less = stats.spearman_without(long, dropped.where(F.col("x").isNotNull() & F.col("y").isNotNull())).select("grid", "x", "y", F.col("n").alias("n_without"), F.col("rho").alias("rho_without"))
    one_out = dropped.join(full, "grid").join(less, ["grid", "x", "y"], "left").select("id", "reason", F.col("grid").alias("x"), "rho_full", F.coalesce("rho_without", "rho_full").alias("rho_without"), "n_full", F.coalesce("n_without", "n_full").alias("n_without"))
    return {"correlations": _grid(rows, TIME), "log_correlations": _records(stats.correlation_grid(rows, logs), ["x"]), "leave_one_out": _records(one_out, ["id", "x", "reason"])}


def player_intervals(rows: DataFrame) -> dict:
    def subset(keep: DataFrame) -> dict:
        return {"n": keep.count(), "correlations": _grid(keep, ("max_players", "play_time_midpoint"))}

    return {
        "complexity": _grid(rows, PLAYERS),
        "play_time": [r for t in TIME[:3] for r in _grid(rows, PLAYERS, t)],
        "without_extreme_players": subset(rows.where(F.col("max_players") <= quality.EXTREME_PLAYERS)),
        "without_extreme_span": subset(rows.where(F.col("player_span") <= quality.EXTREME_SPAN)),
    }


def labels(rows: DataFrame) -> dict:
    counts = materialize(stats.label_occurrences(rows, "id", "row_seq", "mechanic_names").groupBy("name").agg(F.count("*").alias("occurrences")), "label-counts")
    lifts = stats.profile_lifts(rows, "id", "mechanic_names", "profile", [p for p in c.PROFILES if p != "unknown"], "unknown", min(THRESHOLDS))
    by = lifts.groupBy("name", "holders").agg(F.max("lift").alias("lift")).join(counts.select("name", "occurrences"), "name").withColumn("size", F.least("holders", "occurrences"))
    each = by.select("size", "lift", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("least")).where(F.col("size") >= F.col("least"))
    reached = counts.select("occurrences", F.explode(F.array(*[F.lit(t) for t in stats.THRESHOLDS])).alias("least"))
    return {
        "distinct": counts.count(),
        "once": counts.where("occurrences = 1").count(),
        "frequency_of_frequency": _records(counts.groupBy("occurrences").agg(F.count("*").alias("labels")), ["occurrences"]),
        "survival": _records(reached.groupBy("least").agg(F.count_if(F.col("occurrences") >= F.col("least")).alias("labels"), F.avg((F.col("occurrences") >= F.col("least")).cast("int")).alias("share")), ["least"]),
        "notable": _records(each.groupBy("least").agg(F.count("*").alias("compared"), F.count_if(F.col("lift") >= NOTABLE).alias("notable")), ["least"]),
        "top": [r.asDict() for r in stats.top_labels(rows, "id", "row_seq", "mechanic_names", report.LISTED).collect()],
    }


def composition(games: DataFrame, rows: DataFrame) -> dict:
    """Coverage, nine boxes, the extremes in order, and how many records lack labels, play time or weight."""
    measured = rows.withColumn("mechanics_per_game", F.size("mechanic_names")).withColumn("all", F.lit("all"))
    gap = {"mechanics": F.size("mechanic_names") == 0, "play_time": F.col("min_play_time_minutes").isNull() | F.col("max_play_time_minutes").isNull(), "complexity": F.col("complexity").isNull()}
    return {
        "coverage": [r for r in _records(quality.missingness(games), ["field"]) if r["field"] in COVERED],
        "boxes": [r for r in _records(stats.boxes_by_group(measured, "all", ["all"], list(BOXES)), ["measure", "all"]) if r["all"] == "overall"],
        "extremes": [r.asDict() for r in extremes(rows).select("id", "min_players", "max_players", "player_span", "min_play_time_minutes", "max_play_time_minutes", "complexity", "reason").collect()],
        "missing": rows.agg(*[F.count_if(when).alias(name) for name, when in gap.items()]).first().asDict(),
    }


def tables(games: DataFrame) -> dict:
    rows = materialize(cat.analytic_rows(games).withColumn("mechanic_names", F.array_compact("mechanic_names")), "robustness-rows")
    return {"time_weight": time_weight(rows), "player_intervals": player_intervals(rows), "labels": labels(rows), "composition": composition(games, rows)}


def build(games: DataFrame, corpus: str, inputs: list[str]) -> dict:
    body = {"version": report.VERSION, "kind": "robustness", "corpus": corpus, "n_games": games.count(), "inputs": sorted(set(inputs)), "tables": tables(games)}
    return {**body, "payload_id": hashlib.sha256(report.json_bytes(body)).hexdigest()}


def findings(t: dict) -> dict[str, list[str]]:
    """What holds, what depends on the representation, what is sparse, and what limits it all."""
    rho = {r["x"]: r["rho"] for r in t["time_weight"]["correlations"]}
    logs = {r["x"].removeprefix("log_"): r["rho"] for r in t["time_weight"]["log_correlations"]}
    players = {r["x"]: r["rho"] for r in t["player_intervals"]["complexity"]}
    subset = {r["x"]: r["rho"] for r in t["player_intervals"]["without_extreme_players"]["correlations"]}
    there = lambda *xs: all(x is not None for x in xs)
    holds, depends, sparse, limits = [], [], [], []
    three = [rho.get(x) for x in TIME[:3]]
    if there(*three) and min(three) >= PERSISTS:
        holds.append(f"Longer play times go with more weight by minimum, maximum and midpoint alike (rank correlation {min(three):.2f} to {max(three):.2f}).")
    most = players.get("max_players")
    if there(most) and abs(most) >= WORTH:
        holds.append(f"Most players and weight go {'together' if most > 0 else 'against each other'} weakly ({most:.2f}).")
    if t["labels"]["top"]:
        top = t["labels"]["top"][0]
        holds.append(f"{top['name']} is the most frequent label ({top['occurrences']} records); that is its frequency, not a relation to a profile.")
    span, middle = rho.get("play_time_span"), rho.get("play_time_midpoint")
    if there(span, middle) and abs(span - middle) >= DIFFERS:
        depends.append(f"The span of play times ({span:.2f}) tells something else than its midpoint ({middle:.2f}).")
    for x in ("max_play_time_minutes", "play_time_midpoint"):
        if there(rho.get(x), logs.get(x)) and abs(rho[x] - logs[x]) >= SHIFTS:
            depends.append(f"Logarithms move {x} from {rho[x]:.2f} to {logs[x]:.2f}.")
    if there(most, subset.get("max_players")) and abs(most - subset["max_players"]) >= SHIFTS:
        depends.append(f"Without extreme player counts most players against weight moves from {most:.2f} to {subset['max_players']:.2f}.")
    n, once = t["labels"]["distinct"], t["labels"]["once"]
    sparse.append(f"{once} of {n} labels ({100 * once / n if n else 0:.0f} %) are on one record only.")
    sparse += [f"From {r['least']} records on, {r['notable']} of {r['compared']} labels have a lift of {NOTABLE} or more in some profile." for r in t["labels"]["notable"]]
    limits.append("Listed ranges are what publishers state, not what was observed; a record has several labels, so shares of labels add up to more than one.")
    limits += [f"{count} records lack {name.replace('_', ' ')}." for name, count in t["composition"]["missing"].items() if count]
    return {"What holds": holds or ["Nothing met the bar."], "What depends on the representation": depends or ["No shift met the bar."], "What is sparse": sparse, "Limits": limits}


def markdown(made: dict) -> str:
    t = made["tables"]
    lines = [f"# {made['corpus']}: robustness", "", f"{made['n_games']} records; payload `{made['payload_id']}`."]
    for title, found in findings(t).items():
        lines += ["", f"## {title}", "", *[f"- {x}" for x in found]]
    lines += ["", "## Boxes", "", "| measure | n | missing | min | q1 | median | q3 | max |", "| --- | --- | --- | --- | --- | --- | --- | --- |"]
    lines += [f"| {r['measure']} | {r['n']} | {r['n_missing']} | " + " | ".join(report._shown(r[k]) for k in ("lowest", "q1", "median", "q3", "highest")) + " |" for r in t["composition"]["boxes"]]
    lines += ["", "## Without one extreme record", ""] + [f"- {r['id']} ({r['reason']}), {r['x']}: {report._shown(r['rho_full'])} to {report._shown(r['rho_without'])}" for r in t["time_weight"]["leave_one_out"]]
    return "\n".join(lines) + "\n"
