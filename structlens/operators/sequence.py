"""Chains of transitions, prefixes of sequences, running and whole summaries."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def walk(edges: list[tuple[object, object, object]]) -> tuple[list[list[object]], list[tuple[object, str]]]:
    """(chains of edge ids, other edges with the reason) of (edge id, from, to) in list order.

    Chains start at edges into whose start nothing leads, then at what is left.
    A chain goes on while exactly one unused edge leaves its end; a fork ends
    it. A chain that would come back to one of its own points is no chain: the
    edge that closes it is a cycle, and its other edges went into the cycle.
    """
    reached = {b for _, _, b in edges}
    leaving: dict[object, list[tuple[object, object]]] = {}
    for e, a, b in edges:
        leaving.setdefault(a, []).append((e, b))
    used: set[object] = set()
    chains: list[list[object]] = []
    others: list[tuple[object, str]] = []
    for e, a, b in [x for x in edges if x[1] not in reached] + [x for x in edges if x[1] in reached]:
        if e in used:
            continue
        used.add(e)
        chain, seen, end, closes = [e], {a, b}, b, e if a == b else None
        while closes is None and len(free := [x for x in leaving.get(end, ()) if x[0] not in used]) == 1:
            following, target = free[0]
            used.add(following)
            if target in seen:
                closes = following
            else:
                chain.append(following)
                seen.add(target)
                end = target
        if closes is None:
            chains.append(chain)
        else:
            others += [(closes, "cycle"), *((x, "into a cycle") for x in chain if x != closes)]
    return chains, others


def chains(edges: DataFrame, group: str, edge: str, start: str, end: str, order: str) -> DataFrame:
    """(group, edge, chain, pos, skipped): every edge's chain and place in it; edges in no chain have the reason instead.

    Which edge follows depends on those already used, so a group, one
    situation's transitions, is walked in one go. Edges that each lead to the
    next (consecutive) need no walk: see successions.
    """
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        found, skipped = walk(list(zip(pdf[edge], pdf[start], pdf[end], strict=True)))
        rows = [(e, i, j, None) for i, chain in enumerate(found) for j, e in enumerate(chain)] + [(e, None, None, why) for e, why in skipped]
        out = pd.DataFrame(rows, columns=[edge, "chain", "pos", "skipped"]).astype({"chain": "Int32", "pos": "Int32"})
        out.insert(0, group, pdf[group].iloc[0])
        return out

    return edges.select(group, edge, start, end, order).groupBy(group).applyInPandas(one, f"{group} {kinds[group]}, {edge} {kinds[edge]}, chain int, pos int, skipped string")


def successions(edges: DataFrame, group: str, edge: str, order: str) -> DataFrame:
    """chains of edges each of which starts where the one before ends, at points that never come again: one chain per group, by place."""
    place = (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).cast("int")
    return edges.select(group, edge, F.lit(0).alias("chain"), place.alias("pos"), F.lit(None).cast("string").alias("skipped"))


def consecutive(events: DataFrame, group: str, event: str, order: Sequence[str]) -> DataFrame:
    """(group, edge, start, end, place): the edge from each event of a group to the next."""
    w = Window.partitionBy(group).orderBy(*order)
    linked = events.select(group, F.col(event).alias("start"), F.lead(event).over(w).alias("end"), F.row_number().over(w).alias("place"))
    return linked.where(F.col("end").isNotNull()).select(group, F.col("start").alias("edge"), "start", "end", "place")


def running_summary(events: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """Every event with first, last, mean, change and count of the values up to and with it."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first(value).over(w)
    return events.select("*", first.alias("first_value"), F.col(value).alias("last_value"), F.avg(value).over(w).alias("mean_value"), (F.col(value) - first).alias("change"), F.count("*").over(w).alias("n_seen"))


def whole_summary(events: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    at = F.struct(*order)
    first, last = F.min_by(value, at), F.max_by(value, at)
    return events.groupBy(group).agg(first.alias("first_value"), last.alias("last_value"), F.avg(value).alias("mean_value"), (last - first).alias("change"), F.count("*").alias("n_seen"))


def prefixes(steps: DataFrame, group: str, pos: str, value: str) -> DataFrame:
    """(group, pos, prefix): values up to and with each step; the step's target is never among them."""
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.select(group, pos, F.collect_list(value).over(w).alias("prefix"))


def reversed_steps(steps: DataFrame, group: str, pos: str, start: str, end: str) -> DataFrame:
    """Steps walked backwards: places counted from the end, start and end swapped."""
    w = Window.partitionBy(group).orderBy(F.desc(pos))
    return steps.withColumn("_p", F.row_number().over(w) - 1).withColumn("_s", F.col(end)).withColumn(end, F.col(start)).withColumn(start, F.col("_s")).withColumn(pos, F.col("_p")).drop("_p", "_s")


def bounded(steps: DataFrame, pos: str, most: int) -> DataFrame:
    return steps.where(F.col(pos) < most)
