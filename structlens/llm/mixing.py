"""Mixing sources to target weights by a low-discrepancy schedule.

The slots 0, 1, 2, ... of the mix are given to sources by mapping golden-ratio
points, in fixed-point arithmetic, through the cumulative weights, so every
prefix of the mix is close to the targets. Each source's documents are shuffled
by hash and laid end to end; the r-th slot of a source takes the r-th block of
`block_tokens` tokens of that stream, which starts over with the first document
after the last. Blocks are equal: a document that crosses the end of one goes on
in the next, and a stream that starts over does so inside a block. The mix is as
long as the scarcest source allows within its repeats.

Sums along a source are taken in two levels, over hash buckets and inside each
bucket, and slots are ranked per source in two levels too, so that no source is
handled by one task. Slots find their source by a join on cells of the points,
and their block's pieces by a join on source and rank, keys of equal weight.
Figures per source stay in tables; the driver sees two sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from structlens.session import shuffle_width
from structlens.storage import materialize

#: Points of the schedule: slot i has point i * GOLDEN mod POINTS, GOLDEN being POINTS over the golden ratio, made odd, so that every point comes once.
POINTS = 1 << 42
GOLDEN = int(POINTS * (5**0.5 - 1) / 2) | 1
#: Bits of a point that name its cell, slots ranked together, tokens of a block.
CELL_BITS, SLOT_RUN, BLOCK_TOKENS = 12, 1 << 14, 256


def source_key(column: str) -> Column:
    return F.lower(F.regexp_replace(F.col(column), r"^[\s\x{A0}]+|[\s\x{A0}]+$", ""))


def point_of(slot: Column) -> Column:
    """slot * GOLDEN mod POINTS for slots below 2**60, in steps that stay within 64 bits."""
    digit = lambda k: F.shiftright(slot, 20 * k).bitwiseAND(F.lit((1 << 20) - 1))
    mod = lambda x, m: x.bitwiseAND(F.lit(m - 1))
    parts = [F.shiftleft(mod(digit(k) * F.lit(GOLDEN), POINTS >> 20 * k), 20 * k) for k in range(3)]
    return mod(parts[0] + parts[1] + parts[2], POINTS)


def planned_sources(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, share, repeats, total, low, high) of the sources in the mix: shares sum to 1, points from low to below high are the source's.

    Shares of listed sources without tokens are spread over the others in
    proportion. There is one row per source; their cumulative shares are taken in one go.
    """
    goals = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("share").alias("share"), F.max("repeats").cast("bigint").alias("repeats"))
    present = goals.join(totals, "source").where((F.col("share") > 0) & (F.col("repeats") > 0) & (F.col("total") > 0))
    every, upto = Window.partitionBy(), Window.orderBy("source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shares = present.withColumn("share", F.col("share") / F.sum("share").over(every))
    last = F.lead("source").over(Window.orderBy("source")).isNull()
    high = F.when(last, F.lit(POINTS)).otherwise(F.round(F.sum("share").over(upto) * float(POINTS)).cast("bigint"))
    edged = shares.withColumn("high", high)
    return edged.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("source")), F.lit(0).cast("bigint"))).select("source", "share", "repeats", "total", "low", "high")


def schedule(sources: DataFrame, slots: int, block: int) -> DataFrame:
    """(slot, source, rank): the slots with their sources, ranked per source from 0; slots beyond a source's repeats are left out."""
    spark = sources.sparkSession
    shift = POINTS.bit_length() - 1 - CELL_BITS
    parts = max(1, min(slots // SLOT_RUN + 1, 4 * shuffle_width(spark)))
    given = spark.range(0, slots, numPartitions=parts).select(F.col("id").alias("slot"), F.floor(F.col("id") / SLOT_RUN).cast("bigint").alias("run"), point_of(F.col("id")).alias("_point"))
    cells = sources.select("source", "low", "high", "repeats", "total", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("cell"))
    cells = cells.where(F.col("low") < F.col("high"))
    given = given.withColumn("cell", F.shiftright("_point", shift)).join(cells, "cell").where((F.col("_point") >= F.col("low")) & (F.col("_point") < F.col("high")))
    given = given.select("slot", "run", "source", (F.col("repeats") * F.col("total")).alias("_most"))
    counts = given.groupBy("source", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("source", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")).cast("bigint") - 1
    ranked = given.withColumn("_r", rank).join(offsets, ["source", "run"]).withColumn("rank", F.col("_r") + F.col("offset"))
    return ranked.where(F.col("rank") * block < F.col("_most")).select("slot", "source", "rank")


def pieces(documents: DataFrame, needed: DataFrame, block: int, buckets: int) -> DataFrame:
    """(source, rank, doc, use, start, tokens): the parts of documents in the first blocks of every source's stream.

    needed: (source, total, stop): tokens of one pass over the source, and tokens of its stream that are asked for.
    """
    mixed = documents.where(F.col("tokens") > 0).withColumn("order_key", F.xxhash64("doc", F.lit("mix"))).withColumn("bucket", F.shiftrightunsigned("order_key", 40) % buckets)
    sums = mixed.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    offsets = offsets.join(needed, "source")
    inside = Window.partitionBy("source", "bucket").orderBy("order_key", "doc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = mixed.withColumn("_end", F.sum("tokens").over(inside)).join(offsets, ["source", "bucket"])
    laid = laid.withColumn("_at", F.col("offset") + F.col("_end") - F.col("tokens")).where(F.col("_at") < F.col("stop"))
    whole = lambda x: F.floor(x).cast("bigint")
    uses = laid.withColumn("use", F.explode(F.sequence(F.lit(1).cast("bigint"), F.expr("(stop - _at - 1) div total + 1"))))
    placed = uses.withColumn("_from", F.col("_at") + (F.col("use") - 1) * F.col("total")).withColumn("_to", F.least(F.col("_from") + F.col("tokens"), F.col("stop")))
    cut = placed.withColumn("rank", F.explode(F.sequence(F.expr(f"_from div {block}L"), F.expr(f"(_to - 1) div {block}L"))))
    start = F.greatest(F.col("_from"), F.col("rank") * block)
    stop = F.least(F.col("_to"), (F.col("rank") + 1) * block)
    return cut.select("source", "rank", "doc", whole(F.col("use")).alias("use"), (start - F.col("_from")).alias("start"), (stop - start).alias("tokens"))


def mix(counted: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, source, doc, use, start, tokens) from counted (doc, source, tokens) and targets (source, share, repeats).

    The slots, in order, are the mix; the rows of one slot are one block: tokens
    `start` to `start + tokens` of each document. `use` counts a document's uses
    from 1 and never exceeds its source's repeats. Sources are compared trimmed
    and in lower case.

    Defined cases: documents of unlisted or null sources, documents without
    tokens, and sources with share or repeats 0, are not in the mix; listed
    sources without tokens yield their share to the others (share_report tells);
    a source listed twice adds its shares and takes the larger repeats; the last
    block of a source whose repeats are used up may be shorter; empty tables give
    no row; other columns are not read.
    """
    none = counted.select(F.lit(0).cast("bigint").alias("slot"), "source", "doc", F.lit(0).cast("bigint").alias("use"), F.lit(0).cast("bigint").alias("start"), "tokens").limit(0)
    totals = counted.where(F.col("source").isNotNull()).groupBy("source").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    sources = materialize(planned_sources(totals, targets), "mix-sources")
    longest = sources.agg(F.min(F.col("total") * F.col("repeats") / F.col("share"))).first()[0]
    if not longest:
        return none
    slots = max(1, int(longest // block_tokens))
    given = materialize(schedule(sources, slots, block_tokens), "mix-slots")
    asked = given.groupBy("source").agg((F.max("rank") + 1).alias("_slots"))
    needed = sources.join(asked, "source").select("source", "total", F.least(F.col("_slots") * block_tokens, F.col("total") * F.col("repeats")).alias("stop"))
    parts = pieces(counted.select("doc", "source", "tokens"), needed, block_tokens, 4 * shuffle_width(counted.sparkSession))
    return given.join(parts, ["source", "rank"]).select("slot", "source", "doc", "use", "start", "tokens")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, tokens, documents, uses, most_uses) of every listed source."""
    per_doc = mixed.groupBy("source", "doc").agg(F.sum("tokens").alias("tokens"), F.max("use").alias("uses"))
    reached = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.max("uses").alias("most_uses"))
    goals = targets.groupBy("source").agg(F.sum("share").alias("target_share"))
    both = goals.join(reached, "source", "left").fillna(0, ["tokens", "documents", "uses", "most_uses"])
    total = F.sum("tokens").over(Window.partitionBy())  # a row per source
    share = F.when(total > 0, F.col("tokens") / total).otherwise(0.0)
    return both.select("source", "target_share", share.alias("reached_share"), "tokens", "documents", "uses", "most_uses")


def counted_sources(counted: DataFrame) -> DataFrame:
    """Counts written once, as totals, sums and blocks are all taken from them."""
    return materialize(counted.select("doc", "source", "tokens"), "counted")
