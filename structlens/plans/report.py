"""The descriptive and robustness report of a catalog: tables, envelope, Markdown and lineage.

Every table is aggregated in Spark; only report-sized results reach the driver.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structlens.functions import columns as c
from structlens.operators import catalog as cat
from structlens.operators import quality, stats

VERSION = "1.0"
#: Lines listed per table in the rendered findings, and the strength from which a correlation is called one.
LISTED, STRONG = 15, 0.5


def _records(df: DataFrame, order: list[str]) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def tables(games: DataFrame) -> dict[str, list[dict]]:
    """Named tables as lists of plain records, each in a fixed order."""
    rows = cat.analytic_rows(games).withColumn("mechanic_names", F.array_compact("mechanic_names")).cache()
    measures = ["player_span", "min_players", "max_players", "min_play_time_minutes", "max_play_time_minutes", "play_time_span", "play_time_midpoint", "complexity"]
    pairs = [(x, F.col(x), "complexity", F.col("complexity")) for x in ("play_time_midpoint", "min_play_time_minutes", "max_play_time_minutes", "max_players", "player_span")]
    pairs += [(f"log_{x}", c.log_positive(F.col(x)), "complexity", F.col("complexity")) for x in ("min_play_time_minutes", "max_play_time_minutes", "play_time_midpoint")]
    out = {
        "coverage": _records(quality.missingness(games), ["field"]),
        "profiles": _records(stats.counts_in_order(rows, {"profile": c.PROFILES}), ["profile"]),
        "eras": _records(stats.counts_in_order(rows, {"era": c.ERAS}), ["era"]),
        "time_kinds": _records(stats.counts_in_order(rows, {"profile": c.PROFILES, "time_kind": c.KINDS}), ["profile", "time_kind"]),
        "boxes": _records(stats.boxes_by_group(rows, "profile", c.PROFILES, measures), ["measure", "profile"]),
        "correlations": _records(stats.correlation_grid(rows, pairs), ["x", "y"]),
        "top_labels": [r.asDict() for r in stats.top_labels(rows, "id", "row_seq", "mechanic_names", LISTED).collect()],
        "extremes": _records(quality.extreme_rows(rows).groupBy("reason").agg(F.count("*").alias("n")), ["reason"]),
        "anomalies": _records(quality.anomaly_flags(games, 2100).groupBy("code").agg(F.count("*").alias("n")), ["code"]),
    }
    rows.unpersist()
    return out


def build(games: DataFrame, corpus: str, inputs: list[str]) -> dict:
    """The report with its envelope; payload_id is the SHA-256 of the sorted-key JSON of everything else."""
    body = {"version": VERSION, "corpus": corpus, "n_games": games.count(), "inputs": sorted(set(inputs)), "tables": tables(games)}
    return {**body, "payload_id": hashlib.sha256(json_bytes(body)).hexdigest()}


def json_bytes(report: dict) -> bytes:
    return (json.dumps(report, sort_keys=True, ensure_ascii=False, indent=1, default=str) + "\n").encode()


def _shown(x: object) -> str:
    return "–" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x)


def markdown(report: dict) -> str:
    """Findings as Markdown: counts, boxes over all, correlations with a word on their strength, top labels."""
    t = report["tables"]
    lines = [f"# {report['corpus']}", "", f"{report['n_games']} records; payload `{report['payload_id']}`.", "", "## Profiles", ""]
    lines += [f"- {r['profile']}: {r['n']}" for r in t["profiles"]]
    lines += ["", "## Boxes over all", "", "| measure | n | missing | min | q1 | median | q3 | max |", "| --- | --- | --- | --- | --- | --- | --- | --- |"]
    lines += [f"| {r['measure']} | {r['n']} | {r['n_missing']} | " + " | ".join(_shown(r[k]) for k in ("lowest", "q1", "median", "q3", "highest")) + " |" for r in t["boxes"] if r["profile"] == "overall"]
    lines += ["", "## Rank correlations", ""]
    for r in t["correlations"]:
        word = "too few pairs" if r["rho"] is None else "strong" if abs(r["rho"]) >= STRONG else "weak"
        lines.append(f"- {r['x']} with {r['y']}: {_shown(r['rho'])} (n={r['n']}, {word})")
    lines += ["", "## Labels", ""]
    lines += [f"- {r['name']}: {r['occurrences']}" for r in t["top_labels"]]
    lines += ["", "## Eras", ""] + [f"- {r['era']}: {r['n']}" for r in t["eras"]]
    lines += ["", "## Flags", ""] + [f"- {r['code']}: {r['n']}" for r in t["anomalies"]]
    return "\n".join(lines) + "\n"


def figures(report: dict, folder: str) -> list[str]:
    """PNG bar charts of profiles and eras if matplotlib is there; the tables are plot-ready without it."""
    try:
        from matplotlib import pyplot
    except ImportError:
        return []
    made = []
    for name, label in (("profiles", "profile"), ("eras", "era")):
        rows = report["tables"][name]
        figure, axes = pyplot.subplots()
        axes.bar([r[label] for r in rows], [r["n"] for r in rows])
        made.append(f"{folder}/{name}.png")
        figure.savefig(made[-1])
        pyplot.close(figure)
    return made
