"""Summaries by group, rank correlations, label prevalence and lift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structlens.functions.columns import rounded
from structlens.storage import materialize

#: Fewest complete pairs for a rank correlation; fewest records for a label to be compared; label counts looked at.
LEAST_PAIRS, LEAST_HOLDERS, THRESHOLDS = 8, 5, (1, 2, 3, 5, 10, 20)


def literal_rows(spark: SparkSession, **columns: Sequence[str]) -> DataFrame:
    """All combinations of a few literal values: the dimension that zero-fills a table."""
    df = spark.range(1).select()
    for name, values in columns.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df


def box(value: str) -> list[Column]:
    """n, missing, five numbers with inclusive quartiles, mean and sample deviation (0 for one value)."""
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("n_missing"), F.min(value).alias("lowest"), F.get(quartiles, F.lit(0)).alias("q1"),
        F.get(quartiles, F.lit(1)).alias("median"), F.get(quartiles, F.lit(2)).alias("q3"), F.max(value).alias("highest"), rounded(F.avg(value)).alias("mean"),
        rounded(F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value))).alias("stdev"),
    ]


def unpivot(df: DataFrame, keep: Sequence[str], measures: Sequence[str], name: str = "measure", value: str = "value") -> DataFrame:
    each = F.array(*[F.struct(F.lit(m).alias(name), F.col(m).cast("double").alias(value)) for m in measures])
    return df.select(*keep, F.inline(each))


def boxes_by_group(df: DataFrame, group: str, groups: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """A box per measure and group and per measure over all ('overall'), empty groups included."""
    long = unpivot(df, [group], measures)
    sets = long.groupingSets([["measure", group], ["measure"]], "measure", group).agg(F.grouping(group).alias("_all"), *box("value"))
    named = sets.select("measure", F.when(F.col("_all") == 1, "overall").otherwise(F.col(group)).alias(group), *[c for c in sets.columns if c not in ("measure", group, "_all")])
    frame = literal_rows(df.sparkSession, **{"measure": measures, group: [*groups, "overall"]})
    return frame.join(named, ["measure", group], "left").fillna(0, ["n", "n_missing"])


def counts_in_order(df: DataFrame, by: Mapping[str, Sequence[str]]) -> DataFrame:
    """Counts for every combination of listed values, 0 where there is none."""
    frame = literal_rows(df.sparkSession, **by)
    return frame.join(df.groupBy(*by).agg(F.count("*").alias("n")), list(by), "left").fillna(0, ["n"])


def _ranks(pairs: DataFrame, value: str, out: str) -> DataFrame:
    """Average rank of each value of a grid cell, from counts of equal values.

    Cumulative counts run over order-preserving bins and inside the bins, so a
    grid cell is never sorted in one task.
    """
    counts = pairs.groupBy("grid", value).agg(F.sum("n").alias("n"))
    binned = counts.withColumn("_bin", F.signum(value) * F.floor(F.ln(1 + F.abs(value)) * 64))
    bins = binned.groupBy("grid", "_bin").agg(F.sum("n").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("grid").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    starts = bins.select("grid", "_bin", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.sum("n").over(Window.partitionBy("grid", "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = binned.withColumn("_upto", inside).join(starts, ["grid", "_bin"])
    return placed.select("grid", value, (F.col("_start") + F.col("_upto") - (F.col("n") - 1) / 2.0).alias(out))


def spearman(long: DataFrame, least: int = LEAST_PAIRS) -> DataFrame:
    """(grid, n, rho) of rows (grid, x, y): Pearson of average ranks over complete pairs.

    rho is null below `least` pairs or where a side has no variance. Equal pairs
    are counted before anything is ranked, and ranks are centred exactly.
    """
    pairs = long.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("grid", "x", "y").agg(F.count("*").alias("n"))
    pairs = materialize(pairs, "pairs")  # counts, both rankings and the totals are taken from it
    ranked = pairs.join(_ranks(pairs, "x", "rx"), ["grid", "x"]).join(_ranks(pairs, "y", "ry"), ["grid", "y"])
    totals = pairs.groupBy("grid").agg(F.sum("n").alias("total"))
    centred = ranked.join(totals, "grid").select("grid", "n", "total", (F.col("rx") - (F.col("total") + 1) / 2.0).alias("a"), (F.col("ry") - (F.col("total") + 1) / 2.0).alias("b"))
    product = lambda x, y: F.sum(F.col("n") * F.col(x) * F.col(y))
    summed = centred.groupBy("grid").agg(F.max("total").alias("n"), product("a", "b").alias("ab"), product("a", "a").alias("aa"), product("b", "b").alias("bb"))
    rho = F.when(F.col("n") >= least, F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))))
    return summed.select("grid", "n", rho.alias("rho"))


def _above(df: DataFrame, value: str, weight: str, out: str) -> DataFrame:
    """(grid, value, out): the weight at greater values plus half of that at equal ones, per grid cell.

    The window runs over distinct values of a grid cell, not over records.
    """
    sums = df.groupBy("grid", value).agg(F.sum(weight).alias("_w"))
    beyond = F.sum("_w").over(Window.partitionBy("grid").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("grid", value, (F.coalesce(beyond, F.lit(0.0)) + F.col("_w") / 2.0).alias(out))


def _dominance(ranked: DataFrame, cases: DataFrame, bits: int) -> DataFrame:
    """(grid, x, y, dominated): records above a case in x and in y, those equal in x or in y counting half.

    Records are put under every prefix of their y-rank's bits; the ranks above a
    case's are the union of at most `bits` prefixes, in each of which records
    are counted along x. Nothing is compared pair by pair.
    """
    place = F.round(F.col("ry") - (F.col("ty") - 1) / 2.0).cast("bigint")
    levels = F.sequence(F.lit(-1), F.lit(bits - 1))
    shifted = lambda b: F.when(b < 0, F.col("place")).otherwise(F.floor(F.col("place") / F.pow(F.lit(2.0), b)).cast("bigint"))
    own = F.transform(levels, lambda b: F.struct(b.alias("level"), shifted(b).alias("node"), F.lit(1.0).alias("share")))
    records = ranked.withColumn("place", place).select("grid", "x", "n", F.inline(own)).groupBy("grid", "level", "node", "x").agg(F.sum("n").alias("n"))
    asked = F.filter(F.transform(levels, lambda b: F.struct(b.alias("level"), (shifted(b) + F.when(b < 0, 0).otherwise(1)).alias("node"), F.when(b < 0, 0.5).otherwise(1.0).alias("share"))), lambda s: (s["level"] < 0) | (s["node"] % 2 == 1))
    wanted = cases.withColumn("place", place).select("grid", "x", "y", F.inline(asked))
    both = records.select("grid", "level", "node", "x", "n", F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("share"))
    both = both.unionByName(wanted.select("grid", "level", "node", "x", F.lit(0).cast("bigint").alias("n"), "y", "share"))
    node = ["grid", "level", "node"]
    from_here = F.sum("n").over(Window.partitionBy(*node).orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    equal = F.sum("n").over(Window.partitionBy(*node, "x"))
    weighed = both.select("grid", "x", "y", "share", (from_here - equal / 2.0).alias("w")).where(F.col("share").isNotNull())
    return weighed.groupBy("grid", "x", "y").agg(F.sum(F.col("share") * F.col("w")).alias("dominated"))


def spearman_without(long: DataFrame, cases: DataFrame, least: int = LEAST_PAIRS) -> DataFrame:
    """(grid, x, y, n, rho): the rank correlation of (grid, x, y) rows without one record of the values (x, y), for each case.

    Taking a record out lowers every rank above it by one and every equal one by
    a half, so all sums follow from those over all records.
    """
    pairs = materialize(long.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("grid", "x", "y").agg(F.count("*").alias("n")), "pairs")
    ties = lambda v, out: pairs.groupBy("grid", v).agg(F.sum("n").alias(out))
    side = lambda v, r, t: _ranks(pairs, v, r).join(ties(v, t), ["grid", v])
    ranked = materialize(pairs.join(side("x", "rx", "tx"), ["grid", "x"]).join(side("y", "ry", "ty"), ["grid", "y"]), "ranked")
    cube = lambda t: (F.pow(t, F.lit(3.0)) - t) / 12.0
    totals = ranked.groupBy("grid").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("rx") * F.col("ry")).alias("xy"))
    for v, t, out in (("x", "tx", "ties_x"), ("y", "ty", "ties_y")):
        totals = totals.join(ties(v, t).groupBy("grid").agg(F.sum(cube(F.col(t))).alias(out)), "grid")
    most = totals.agg(F.max("total")).first()[0] or 1
    known = ranked.join(cases.select("grid", "x", "y").distinct(), ["grid", "x", "y"], "left_semi")
    weighed = ranked.select("grid", "x", "y", (F.col("n") * F.col("ry")).alias("wy"), (F.col("n") * F.col("rx")).alias("wx"))
    full = known.join(totals, "grid").join(_above(weighed, "x", "wy", "above_x"), ["grid", "x"]).join(_above(weighed, "y", "wx", "above_y"), ["grid", "y"]).join(_dominance(ranked, known, int(most).bit_length() + 1), ["grid", "x", "y"])
    rx, ry, m = F.col("rx"), F.col("ry"), F.col("total") - 1
    product = F.col("xy") - rx * ry - (F.col("above_x") - ry / 2) - (F.col("above_y") - rx / 2) + F.col("dominated") - 0.25 - m * F.pow(F.col("total") / 2.0, F.lit(2.0))
    spread = lambda t, all_ties: cube(m) - F.col(all_ties) + cube(F.col(t)) - cube(F.col(t) - 1)
    rho = F.when(m >= least, F.try_divide(product, F.sqrt(spread("tx", "ties_x") * spread("ty", "ties_y"))))
    return full.select("grid", "x", "y", m.alias("n"), rho.alias("rho"))


def correlation_grid(df: DataFrame, pairs: Sequence[tuple[str, Column, str, Column]], least: int = LEAST_PAIRS) -> DataFrame:
    """(x, y, n, missing_x, missing_y, rho) for each (name, column, name, column), every pair with its own complete cases."""
    each = F.array(*[F.struct(F.lit(f"{a}|{b}").alias("grid"), x.cast("double").alias("x"), y.cast("double").alias("y")) for a, x, b, y in pairs])
    long = df.select(F.inline(each))
    missing = long.groupBy("grid").agg(F.count_if(F.col("x").isNull()).alias("missing_x"), F.count_if(F.col("y").isNull()).alias("missing_y"))
    found = missing.join(spearman(long, least), "grid", "left")
    return found.select(F.split_part("grid", F.lit("|"), F.lit(1)).alias("x"), F.split_part("grid", F.lit("|"), F.lit(2)).alias("y"), F.coalesce("n", F.lit(0)).alias("n"), "missing_x", "missing_y", rounded(F.col("rho")).alias("rho"))


def label_occurrences(rows: DataFrame, key: str, order: str, labels: str) -> DataFrame:
    """(key, order, pos, name): every label written, with its place."""
    return rows.select(key, order, F.posexplode(labels).alias("pos", "name"))


def prevalence(rows: DataFrame, key: str, order: str, labels: str) -> DataFrame:
    """(name, occurrences, share, place): occurrences, not records; ties in order of first appearance."""
    total = rows.agg(F.count("*").alias("total"))
    counts = label_occurrences(rows, key, order, labels).groupBy("name").agg(F.count("*").alias("occurrences"), F.min(F.struct(order, "pos")).alias("_first"))
    ranked = counts.crossJoin(total)  # total is one row
    return ranked.select("name", "occurrences", rounded(F.col("occurrences") / F.col("total")).alias("share"), F.col(f"_first.{order}").alias("first_row"), F.col("_first.pos").alias("first_pos"))


def top_labels(rows: DataFrame, key: str, order: str, labels: str, k: int = 15) -> DataFrame:
    """The k labels most often written, ties by first appearance."""
    return prevalence(rows, key, order, labels).orderBy(F.desc("occurrences"), "first_row", "first_pos").limit(k).select("name", "occurrences", "share")


def profile_lifts(rows: DataFrame, key: str, labels: str, group: str, groups: Sequence[str], unknown: str, least: int) -> DataFrame:
    """(name, holders, group, in_group, share, baseline, lift) of labels with enough occurrences and enough holders of known group.

    Occurrences count every writing, holders every record once; the least is
    asked of both. lift is null where the baseline is 0.
    """
    written = rows.select(key, group, F.explode(labels).alias("name"))
    enough = written.groupBy("name").agg(F.count("*").alias("_o")).where(F.col("_o") >= least).select("name")
    holders = written.where(F.col(group) != unknown).select(key, group, "name").distinct()
    counted = holders.groupBy("name").agg(F.count("*").alias("holders"), *[F.count_if(F.col(group) == g).alias(g) for g in groups]).where(F.col("holders") >= least)
    known = rows.where(F.col(group) != unknown).agg(F.count("*").alias("_known"), *[F.count_if(F.col(group) == g).alias(f"_{g}") for g in groups])
    base = counted.join(enough, "name").crossJoin(known)  # known is one row
    each = F.array(*[F.struct(F.lit(g).alias("profile"), F.col(g).alias("in_group"), (F.col(f"_{g}") / F.col("_known")).alias("baseline")) for g in groups])
    long = base.select("name", "holders", F.inline(each)).withColumn("share", F.col("in_group") / F.col("holders"))
    return long.select("name", "holders", "profile", "in_group", rounded(F.col("share")).alias("share"), rounded(F.col("baseline")).alias("baseline"), rounded(F.try_divide("share", "baseline")).alias("lift"))
