"""Column-level quality profile of loads of text columns.

Values are generalised to character-class masks: a run of digits becomes 9, of
upper-case letters A, of other letters a, of blanks one blank; anything else
stays. What a column's values look like is mined from its loads: a mask is
dominant in a load if it holds at least a given share of the filled values, and
belongs to the column's form if it is dominant in half of the loads or more. The form of
a column of numbers is closed under a leading minus and, where fractions are in
it, under whole numbers. Values whose masks are not in the form are violations,
however many lines a broken load delivers them in.

Values are counted per load, mask and number before and during one shuffle after
the one that tells repeated lines; everything else works on these counts.

Defined cases: null and empty values are missing, as are values that are a
number equal to 0; lines equal in the line key count once (null key parts equal
each other); an empty table gives no row; a load without numbers on either side
has no drift; columns of the table other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structlens.operators.standing import newest
from structlens.storage import materialize

#: Order-preserving bins of the numbers of one load: so many per factor e of 1 + |number|.
BINS_PER_E = 64
#: Share of a load's filled values that makes a mask dominant there (numerator, denominator).
DOMINANT = (5, 100)
#: The mask of whole numbers and of numbers with a fraction, without their sign.
WHOLE, FRACTION = "9", "9.9"


@dataclass(frozen=True)
class ColumnRule:
    """A column and the range its numbers should lie in."""

    name: str
    low: float
    high: float


@dataclass(frozen=True)
class Form:
    """The dominant masks of a column, and which numbers they make room for."""

    masks: tuple[str, ...]

    @property
    def fraction(self) -> bool:
        return FRACTION in self.masks

    @property
    def whole(self) -> bool:
        return self.fraction or WHOLE in self.masks


def mask_of(value: Column) -> Column:
    """The character-class mask of a value."""
    masked = F.regexp_replace(value, "[0-9]+", "9")
    masked = F.regexp_replace(masked, r"\p{Lu}+", "A")
    masked = F.regexp_replace(masked, r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", "a")
    return F.regexp_replace(masked, r"[\s\x{A0}]+", " ")


def cells(df: DataFrame, feed: str, load: str, line: str, names: Sequence[str]) -> DataFrame:
    """One row per load line and column: its mask, and its number if the mask is one of a number's."""
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    key = F.struct(F.col(feed).alias("feed_id"), F.col(load).alias("load_id"), F.col(line).alias("_line"))
    lines = newest(df, key, [row], {"_row": row}).select("_key.feed_id", "_key.load_id", "_row")  # of lines sent twice with other content the greatest
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.trim(F.col(f"_row.c{i}"), F.lit(" \t")).alias("value")) for i, c in enumerate(names)])
    long = lines.select("feed_id", "load_id", F.inline(each)).withColumn("mask", mask_of(F.col("value")))
    bare = F.regexp_replace("mask", "^-", "")
    return long.withColumn("number", F.when(bare.isin(WHOLE, FRACTION), F.col("value").try_cast("double")))


def value_counts(df: DataFrame, feed: str, load: str, line: str, names: Sequence[str]) -> DataFrame:
    """(feed_id, load_id, column_name, text_mask, number, n, fractions): values of each number, how many of them written with a fraction; of other values each mask."""
    text = F.when(F.col("number").isNull(), F.col("mask")).alias("text_mask")
    counted = cells(df, feed, load, line, names).select("feed_id", "load_id", "column_name", text, "number", F.col("mask").endswith(FRACTION).alias("_f"))
    return counted.groupBy("feed_id", "load_id", "column_name", "text_mask", "number").agg(F.count("*").alias("n"), F.count_if(F.col("_f") & F.col("number").isNotNull()).alias("fractions"))


def mined_forms(masks: DataFrame, dominant: tuple[int, int] = DOMINANT) -> dict[str, Form]:
    """The form of every column, from (feed_id, load_id, column_name, mask, n) of unsigned masks.

    A form has at most two masks per dominant share, so the driver holds little whatever the data.
    """
    load = ["feed_id", "load_id", "column_name"]
    each = masks.where((F.col("mask") != "") & (F.col("n") > 0)).groupBy(*load, "mask").agg(F.sum("n").alias("n"))
    shares = each.select("*", F.sum("n").over(Window.partitionBy(*load)).alias("_all"), F.row_number().over(Window.partitionBy(*load).orderBy("mask")).alias("_k"))
    known = F.when(F.col("n") * dominant[1] >= F.col("_all") * dominant[0], F.col("mask"))
    votes = shares.groupBy("column_name", known.alias("mask")).agg(F.count("*").alias("loads"), F.count_if(F.col("_k") == 1).alias("_first"))
    votes = votes.select("column_name", "mask", "loads", F.sum("_first").over(Window.partitionBy("column_name")).alias("_of"))
    found: dict[str, list[str]] = {}
    for row in votes.where(F.col("mask").isNotNull() & (F.col("loads") * 2 >= F.col("_of"))).collect():
        found.setdefault(row["column_name"], []).append(row["mask"])
    return {column: Form(tuple(sorted(kept))) for column, kept in found.items()}


def counted_masks(counts: DataFrame) -> DataFrame:
    """(feed_id, load_id, column_name, mask, n) of value counts, masks without sign."""
    number = F.col("number").isNotNull()
    two = F.array(F.struct(F.when(number, WHOLE).otherwise(F.col("text_mask")).alias("mask"), (F.col("n") - F.col("fractions")).alias("n")), F.struct(F.lit(FRACTION).alias("mask"), F.col("fractions").alias("n")))
    return counts.select("feed_id", "load_id", "column_name", F.inline(two))


def conforming(counts: DataFrame, forms: Mapping[str, Form]) -> DataFrame:
    """value_counts with fits: how many of a row's values are numbers in their column's form."""
    whole, part = F.lit(False), F.lit(False)
    for column, form in forms.items():
        whole = F.when(F.col("column_name") == column, F.lit(form.whole)).otherwise(whole)
        part = F.when(F.col("column_name") == column, F.lit(form.fraction)).otherwise(part)
    fits = F.when(whole, F.col("n") - F.col("fractions")).otherwise(0) + F.when(part, F.col("fractions")).otherwise(0)
    return counts.withColumn("fits", F.when(F.col("number").isNotNull(), fits).otherwise(0).cast("bigint"))


def _outside(rules: Sequence[ColumnRule]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = F.when(F.col("column_name") == r.name, (F.col("number") < r.low) | (F.col("number") > r.high)).otherwise(out)
    return out


def load_profile(counts: DataFrame, rules: Sequence[ColumnRule]) -> DataFrame:
    """Per load and column, from conforming counts: rows, missing, values not of the form, numbers, different numbers, out of range, extremes; and the load before."""
    zero = F.col("number") == 0
    empty = F.col("number").isNull() & (F.coalesce("text_mask", F.lit("")) == "")
    total = lambda when, n="fits": F.coalesce(F.sum(F.when(when, F.col(n))), F.lit(0))
    is_number = (F.col("fits") > 0) & ~zero
    number = F.when(is_number, F.col("number"))
    base = counts.groupBy("feed_id", "load_id", "column_name").agg(
        F.sum("n").alias("rows"),
        (total(zero) + total(empty, "n")).alias("missing"),
        total(is_number).alias("numbers"),
        F.count_if(is_number).alias("distinct_numbers"),
        total(is_number & _outside(rules)).alias("outside"),
        F.min(number).alias("lowest"),
        F.max(number).alias("highest"),
    )
    base = base.withColumn("malformed", F.col("rows") - F.col("missing") - F.col("numbers"))
    w = Window.partitionBy("feed_id", "column_name").orderBy("load_id")
    lagged = [F.lag(c).over(w).alias(f"before_{c}") for c in ("load_id", "rows", "missing", "numbers", "distinct_numbers")]
    has_before = (F.row_number().over(w) > 1).alias("has_before")
    return base.select("*", *lagged, has_before, F.lead("load_id").over(w).alias("next_load_id"))


def _of_load(load: str = "load_id") -> Column:
    """A load's column as one key: structs compare null with null as equal."""
    return F.struct("feed_id", "column_name", F.col(load).alias("load_id"))


def drift(counts: DataFrame, profile: DataFrame) -> DataFrame:
    """(at, gap, gap_of): largest gap between the cumulative shares of a load and the one before, at = its struct (feed_id, column_name, load_id).

    The cumulative sums run in two levels, over order-preserving bins and inside
    each bin, so that no load's numbers are sorted in one task; numbers are
    partitioned by load and bin once, for both.
    """
    numbers = counts.where((F.col("fits") > 0) & (F.col("number") != 0)).select(_of_load().alias("_at"), "feed_id", "column_name", "load_id", "number", F.col("fits").alias("n"))
    where = profile.where(F.col("has_before") | F.col("next_load_id").isNotNull()).select(_of_load().alias("_of"), "has_before", "next_load_id")
    placed = numbers.join(where, F.col("_at") == F.col("_of"))
    zero = F.lit(0).cast("bigint")
    roles = F.array_compact(
        F.array(
            F.when(F.col("has_before"), F.struct(_of_load().alias("at"), F.col("n").alias("now"), zero.alias("old"))),
            F.when(F.col("next_load_id").isNotNull(), F.struct(_of_load("next_load_id").alias("at"), zero.alias("now"), F.col("n").alias("old"))),
        )
    )
    bin_of = (F.signum("number") * F.floor(F.ln(1 + F.abs("number")) * BINS_PER_E)).cast("bigint").alias("bin")
    points = placed.select("number", bin_of, F.inline(roles)).select(F.struct("at", "bin").alias("cell"), "number", "now", "old").repartition("cell")
    inside = Window.partitionBy("cell").orderBy("number")  # peers, the two loads' counts of one number, are summed together
    running = points.select("cell", F.sum("now").over(inside).alias("now"), F.sum("old").over(inside).alias("old"))
    bins = points.groupBy("cell").agg(F.sum("now").alias("bin_now"), F.sum("old").alias("bin_old")).select("cell.at", "cell.bin", "bin_now", "bin_old")
    whole, upto = Window.partitionBy("at"), Window.partitionBy("at").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.select(
        F.struct("at", "bin").alias("_cell"),
        F.coalesce(F.sum("bin_now").over(upto), F.lit(0)).alias("start_now"),
        F.coalesce(F.sum("bin_old").over(upto), F.lit(0)).alias("start_old"),
        F.sum("bin_now").over(whole).alias("all_now"),
        F.sum("bin_old").over(whole).alias("all_old"),
    ).where((F.col("all_now") > 0) & (F.col("all_old") > 0))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    joined = running.join(starts, F.col("cell") == F.col("_cell"))
    gap = F.abs((wide("start_now") + wide("now")) * wide("all_old") - (wide("start_old") + wide("old")) * wide("all_now"))
    return joined.groupBy("cell.at").agg(F.max(gap).alias("gap"), F.max(wide("all_now") * wide("all_old")).alias("gap_of"))


def profiled_counts(df: DataFrame, feed: str, load: str, line: str, rules: Sequence[ColumnRule]) -> DataFrame:
    """Value counts, written once for all that is taken from them, held against the forms mined from them."""
    counts = materialize(value_counts(df, feed, load, line, [r.name for r in rules]), "value-counts")
    return conforming(counts, mined_forms(counted_masks(counts)))


def load_issues(
    df: DataFrame,
    feed: str,
    load: str,
    line: str,
    rules: Sequence[ColumnRule],
    malformed_over: tuple[int, int] = (2, 100),
    outside_over: tuple[int, int] = (1, 100),
    missing_rise_over: tuple[int, int] = (1, 10),
    distinct_below: tuple[int, int] = (1, 2),
    drift_over: tuple[int, int] = (1, 4),
) -> DataFrame:
    """(feed_id, load_id, column_name, issue) with issue among pattern, range, distinct, drift, nulls.

    `pattern` stands for values outside the mined form of their column. Thresholds are fractions (numerator, denominator), compared in whole numbers.
    """
    counts = profiled_counts(df, feed, load, line, rules)
    profile = materialize(load_profile(counts, rules), "load-profile")  # a row per load and column
    gaps = drift(counts, profile)
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    filled = F.col("rows") - F.col("missing")
    rise = wide("missing") * wide("before_rows") - wide("before_missing") * wide("rows")
    checks = [
        ("pattern", F.col("malformed") * malformed_over[1] > filled * malformed_over[0]),
        ("range", F.col("outside") * outside_over[1] > F.col("numbers") * outside_over[0]),
        ("distinct", F.col("has_before") & (F.col("distinct_numbers") * distinct_below[1] < F.col("before_distinct_numbers") * distinct_below[0])),
        ("drift", F.col("gap") * drift_over[1] > F.col("gap_of") * drift_over[0]),
        ("nulls", F.col("has_before") & (rise * missing_rise_over[1] > wide("rows") * wide("before_rows") * missing_rise_over[0])),
    ]
    issues = F.array_compact(F.array(*[F.when(condition, name) for name, condition in checks]))
    return profile.withColumn("_at", _of_load()).join(gaps, F.col("_at") == F.col("at"), "left").select("feed_id", "load_id", "column_name", F.explode(issues).alias("issue"))


def mask_profile(df: DataFrame, feed: str, load: str, line: str, rules: Sequence[ColumnRule], dominant_share: tuple[int, int] = (2, 100)) -> DataFrame:
    """Per load and column: dominant masks' number, values under rare masks, and divergence from the load before.

    A mask is dominant in a column if it holds at least dominant_share of the
    column's filled values over all loads; the others are rare and their values
    are violations. The divergence is the total variation distance of the mask
    shares of two consecutive loads, null for a feed's first load.
    """
    zero = F.coalesce(F.col("number") == 0, F.lit(False)).alias("zero")
    every = cells(df, feed, load, line, [r.name for r in rules]).groupBy("feed_id", "load_id", "column_name", "mask", zero).agg(F.count("*").alias("n"))
    every = materialize(every, "mask-counts")
    forms = mined_forms(every.select("feed_id", "load_id", "column_name", F.regexp_replace("mask", "^-(?=9)", "").alias("mask"), "n"))
    missing = F.lit(False)
    for column, form in forms.items():
        fits = F.lit(form.whole) & ~F.col("mask").endswith(FRACTION) | F.lit(form.fraction) & F.col("mask").endswith(FRACTION)
        missing = missing | (F.col("column_name") == column) & F.col("zero") & fits
    counts = every.where((F.col("mask") != "") & ~missing).groupBy("feed_id", "load_id", "column_name", "mask").agg(F.sum("n").alias("n"))
    overall = counts.groupBy("column_name", "mask").agg(F.sum("n").alias("mask_n"))
    column_total = overall.groupBy(F.col("column_name").alias("_c")).agg(F.sum("mask_n").alias("column_n"))
    dominant = overall.join(column_total, F.col("column_name") == F.col("_c")).where(F.col("mask_n") * dominant_share[1] >= F.col("column_n") * dominant_share[0])
    dominant = dominant.select(F.col("column_name").alias("_dc"), F.col("mask").alias("_dm"))
    marked = counts.join(dominant, (F.col("column_name") == F.col("_dc")) & (F.col("mask") == F.col("_dm")), "left")
    loads = marked.groupBy("feed_id", "load_id", "column_name").agg(
        F.sum("n").alias("filled"),
        F.count("*").alias("masks"),
        F.count("_dm").alias("dominant_masks"),
        F.coalesce(F.sum(F.when(F.col("_dm").isNull(), F.col("n"))), F.lit(0)).alias("rare_values"),
        F.max_by("mask", F.struct("n", "mask")).alias("top_mask"),
    )
    w = Window.partitionBy("feed_id", "column_name").orderBy("load_id")
    loads = loads.select("*", F.lag("filled").over(w).alias("before_filled"), F.lead("load_id").over(w).alias("next_load_id"), F.lead("filled").over(w).alias("next_filled"))
    here = loads.select(F.col("feed_id").alias("_f"), F.col("load_id").alias("_l"), F.col("column_name").alias("_c"), F.col("filled").alias("_n"), "before_filled", "next_load_id")
    at = F.col("feed_id").eqNullSafe(F.col("_f")) & F.col("load_id").eqNullSafe(F.col("_l")) & (F.col("column_name") == F.col("_c"))
    share = F.col("n") / F.col("_n")
    roles = F.array_compact(
        F.array(
            F.when(F.col("before_filled").isNotNull(), F.struct(F.col("load_id").alias("at"), share.alias("change"))),
            F.when(F.col("next_load_id").isNotNull(), F.struct(F.col("next_load_id").alias("at"), (-share).alias("change"))),
        )
    )
    moved = counts.join(here, at).select("feed_id", "column_name", "mask", F.inline(roles)).groupBy("feed_id", "column_name", "mask", "at").agg(F.sum("change").alias("change"))
    distance = moved.groupBy(F.col("feed_id").alias("_f"), F.col("column_name").alias("_c"), F.col("at").alias("_l")).agg((F.sum(F.abs("change")) / 2).alias("divergence"))
    out = loads.drop("before_filled", "next_load_id", "next_filled").join(distance, at, "left")
    return out.select("feed_id", "load_id", "column_name", "filled", "masks", "dominant_masks", "rare_values", "top_mask", (F.floor(F.col("divergence") * 1e6 + 0.5) / 1e6).alias("divergence"))
