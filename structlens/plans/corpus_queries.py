"""Corpus analytics over the current catalog rows: descriptive, robustness and integrity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structlens.functions import columns as c
from structlens.operators import catalog as cat
from structlens.operators import quality, stats
from structlens.sources.tables import table

SOURCE, SOURCE_TYPE, URL_PART = "bgg", "api", "/thing/"
LATEST_YEAR = 2025
MEASURES = ("player_span", "min_players", "max_players")
TIME_MEASURES = ("min_play_time_minutes", "max_play_time_minutes", "play_time_span", "play_time_midpoint")
KNOWN = ("two_only", "upto_four", "five_plus")


PLAYERS, TIMES = ("min_players", "max_players"), ("min_play_time_minutes", "max_play_time_minutes")


def _catalog(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    return cat.current_catalog(table(spark, sf, "games"), fields or cat.FIELDS)


def _rows(spark: SparkSession, sf: str, *fields: str) -> DataFrame:
    return cat.analytic_rows(_catalog(spark, sf, *fields))


def interval_profile_box(spark: SparkSession, sf: str) -> DataFrame:
    return stats.boxes_by_group(_rows(spark, sf, *PLAYERS), "profile", c.PROFILES, MEASURES)


def play_time_box(spark: SparkSession, sf: str) -> DataFrame:
    return stats.boxes_by_group(_rows(spark, sf, *PLAYERS, *TIMES), "profile", c.PROFILES, TIME_MEASURES)


def complexity_box(spark: SparkSession, sf: str) -> DataFrame:
    return stats.boxes_by_group(_rows(spark, sf, *PLAYERS, "complexity"), "profile", c.PROFILES, ["complexity"])


def interval_kind_by_profile(spark: SparkSession, sf: str) -> DataFrame:
    return stats.counts_in_order(_rows(spark, sf, *PLAYERS, *TIMES), {"profile": c.PROFILES, "time_kind": c.KINDS})


def era_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf, "release_year")
    counts = stats.counts_in_order(rows, {"era": c.ERAS})
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("era", "n", c.rounded(F.coalesce(F.try_divide("n", "total"), F.lit(0.0))).alias("share"))  # total is one row


def coverage_missingness(spark: SparkSession, sf: str) -> DataFrame:
    return quality.missingness(_catalog(spark, sf))


def numeric_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.numeric_summaries(_catalog(spark, sf, *quality.NUMBERS))


def list_length_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.list_lengths(_catalog(spark, sf, *quality.LISTS))


def label_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    return stats.prevalence(_rows(spark, sf, "mechanics"), "id", "row_seq", "mechanic_names").where(F.col("name").isNotNull())


def top_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = _named_rows(spark, sf)
    return stats.top_labels(rows, "id", "row_seq", "mechanic_names")


def _named_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf, *PLAYERS, "mechanics").withColumn("mechanic_names", F.array_compact("mechanic_names"))


def label_profile_lift(spark: SparkSession, sf: str) -> DataFrame:
    return stats.profile_lifts(_named_rows(spark, sf), "id", "mechanic_names", "profile", KNOWN, "unknown", stats.LEAST_HOLDERS)


def _label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _named_rows(spark, sf).select(F.explode("mechanic_names").alias("name")).groupBy("name").agg(F.count("*").alias("occurrences"))


def label_freq_of_freq(spark: SparkSession, sf: str) -> DataFrame:
    return _label_counts(spark, sf).groupBy("occurrences").agg(F.count("*").alias("labels"))


def label_threshold_survival(spark: SparkSession, sf: str) -> DataFrame:
    each = F.explode(F.array(*[F.lit(t) for t in stats.THRESHOLDS])).alias("least")
    reached = _label_counts(spark, sf).select("occurrences", each).groupBy("least").agg(F.count_if(F.col("occurrences") >= F.col("least")).alias("labels"), F.count("*").alias("all_labels"))
    return reached.select("least", "labels", c.rounded(F.col("labels") / F.col("all_labels")).alias("share"))


def notable_lifts(spark: SparkSession, sf: str) -> DataFrame:
    """Per least number of holders: labels compared, and those with a lift of 1.5 or more in some profile."""
    rows = _named_rows(spark, sf)
    lifts = stats.profile_lifts(rows, "id", "mechanic_names", "profile", KNOWN, "unknown", 3).groupBy("name", "holders").agg(F.max("lift").alias("lift"))
    both = lifts.join(_label_counts(spark, sf), "name").withColumn("size", F.least("holders", "occurrences"))
    steps = both.select("size", "lift", F.explode(F.array(*[F.lit(t) for t in (3, 5, 10, 20)])).alias("least")).where(F.col("size") >= F.col("least"))
    return steps.groupBy("least").agg(F.count("*").alias("compared"), F.count_if(F.col("lift") >= 1.5).alias("notable"))


_PLAYERS = ("min_players", "max_players", "player_span", "player_midpoint")
_TIMES = ("min_play_time_minutes", "max_play_time_minutes", "play_time_midpoint")


def _pairs() -> list[tuple[str, Column, str, Column]]:
    raw = lambda a, b: (a, F.col(a), b, F.col(b))
    out = [raw(x, "complexity") for x in (*TIME_MEASURES, *_PLAYERS)]
    out += [(f"log_{x}", c.log_positive(F.col(x)), "complexity", F.col("complexity")) for x in TIME_MEASURES]
    return out + [raw(p, t) for p in _PLAYERS for t in _TIMES]


def spearman_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return stats.correlation_grid(_rows(spark, sf, *PLAYERS, *TIMES, "complexity"), _pairs())


def spearman_subsets(spark: SparkSession, sf: str) -> DataFrame:
    """Two correlations without the extremes; a row exactly at a limit is kept, null is not."""
    rows = _rows(spark, sf, *PLAYERS, *TIMES, "complexity")
    pairs = [(x, F.col(x), "complexity", F.col("complexity")) for x in ("max_players", "play_time_midpoint")]
    parts = []
    for name, limit in (("max_players", quality.EXTREME_PLAYERS), ("player_span", quality.EXTREME_SPAN)):
        parts.append(stats.correlation_grid(rows.where(F.col(name) <= limit), pairs).withColumn("subset", F.lit(f"{name}<={limit}")))
    return parts[0].unionByName(parts[1])


def spearman_leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    """The time-weight correlations without each extreme record in turn."""
    rows = _rows(spark, sf, *PLAYERS, *TIMES, "complexity")
    long = stats.unpivot(rows.select("id", "complexity", *TIME_MEASURES), ["id", "complexity"], TIME_MEASURES, "grid", "x").withColumnRenamed("complexity", "y")
    dropped = long.join(quality.extreme_rows(rows).select("id", "reason"), "id")
    full = stats.spearman(long).select("grid", F.col("n").alias("n_full"), F.col("rho").alias("full"))
    without = stats.spearman_without(long, dropped.where(F.col("x").isNotNull() & F.col("y").isNotNull())).select("grid", "x", "y", F.col("n").alias("n_less"), F.col("rho").alias("less"))
    found = dropped.join(full, "grid").join(without, ["grid", "x", "y"], "left")
    kept = F.col("n_less").isNull()  # an incomplete record was never counted
    return found.select("id", "reason", F.col("grid").alias("x"), c.rounded(F.col("full")).alias("rho_full"), c.rounded(F.when(kept, F.col("full")).otherwise(F.col("less"))).alias("rho_without"), "n_full", F.when(kept, F.col("n_full")).otherwise(F.col("n_less")).alias("n_without"))


def extreme_flags(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["id", "min_players", "max_players", "player_span", "min_play_time_minutes", "max_play_time_minutes", "complexity", "reason"]
    return quality.extreme_rows(_rows(spark, sf, *PLAYERS, *TIMES, "complexity")).select(*columns)


def anomaly_flags(spark: SparkSession, sf: str) -> DataFrame:
    return quality.anomaly_flags(_catalog(spark, sf, *quality.NUMBERS, *quality.LISTS), LATEST_YEAR)


def provenance_issues(spark: SparkSession, sf: str) -> DataFrame:
    return quality.provenance_issues(_catalog(spark, sf, "sources"), SOURCE, SOURCE_TYPE, URL_PART)


def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Ids delivered more than once and titles shared by several records."""
    ids = quality.duplicates(table(spark, sf, "games"), "id").withColumn("field", F.lit("id"))
    return ids.unionByName(quality.duplicates(_catalog(spark, sf, "title"), "title").withColumn("field", F.lit("title")))


def repeated_labels(spark: SparkSession, sf: str) -> DataFrame:
    return quality.repeated_labels(_catalog(spark, sf, "mechanics"))


def reconcile_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog ids against the ids that documents refer to, both ways."""
    documents = table(spark, sf, "documents").select(F.col("game_id").alias("id"))
    return quality.reconcile(table(spark, sf, "games"), documents, "id")


def title_marker_filter(spark: SparkSession, sf: str) -> DataFrame:
    return quality.titles_with(_catalog(spark, sf, "title"), ("deluxe", "legacy", "2nd ed"))


def empty_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    return quality.without_taxonomy(_catalog(spark, sf, "title", "categories", "mechanics"))


def integrity_report(spark: SparkSession, sf: str) -> DataFrame:
    return quality.integrity_report(table(spark, sf, "games"), _catalog(spark, sf, "title", "categories", "mechanics", "sources"), SOURCE, SOURCE_TYPE, URL_PART)


def composition_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Records without labels, play time or complexity, each with what is missing."""
    gaps = F.array_compact(
        F.array(
            F.when(F.size("mechanic_names") == 0, "mechanics"),
            F.when(F.col("min_play_time_minutes").isNull() | F.col("max_play_time_minutes").isNull(), "play_time"),
            F.when(F.col("complexity").isNull(), "complexity"),
        )
    )
    return _rows(spark, sf, *TIMES, "mechanics", "complexity").select("id", F.explode(gaps).alias("missing"))


_NINE = ("release_year", "complexity", "min_players", "max_players", "player_span", "min_play_time_minutes", "max_play_time_minutes", "play_time_span", "mechanics_per_game")


def composition_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """The nine boxes of the composition audit, by profile and over all."""
    rows = _rows(spark, sf, *PLAYERS, *TIMES, "release_year", "complexity", "mechanics").withColumn("mechanics_per_game", F.greatest(F.size("mechanic_names"), F.lit(0)))
    return stats.boxes_by_group(rows, "profile", c.PROFILES, _NINE)


def extremes_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 most extreme records with their place: most players, then widest range, then corpus order."""
    rows = quality.extreme_rows(_rows(spark, sf, *PLAYERS, *TIMES))
    order = [F.coalesce("max_players", F.lit(0)).desc(), F.coalesce("player_span", F.lit(0)).desc(), F.col("row_seq")]
    top = rows.orderBy(*order).limit(50)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "id", "max_players", "player_span", "reason")  # 50 rows


def anomaly_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Per code the first 20 records in order of id."""
    flags = anomaly_flags(spark, sf).select("code", "id").distinct()
    first = flags.groupBy("code").agg(F.count("*").alias("records"), F.array_sort(F.collect_set("id")).alias("_i"))
    return first.select("code", "records", F.array_join(F.slice("_i", 1, 20), ",").alias("first_ids"))


def provenance_damaged(spark: SparkSession, sf: str) -> DataFrame:
    """The provenance rules over a catalog whose sources are damaged by row number, so that every rule has something to find."""
    nth, s = F.col("row_seq") % 11, F.col("sources")
    with_ = lambda name, value: F.transform(s, lambda x: x.withField(name, value))
    damaged = F.when(nth == 0, F.array_repeat(F.get(s, F.lit(0)), 2)).when(nth == 1, with_("source", F.lit("elsewhere"))).when(nth == 2, with_("source_type", F.lit(None).cast("string"))).when(nth == 3, with_("url", F.lit("x")))
    damaged = damaged.when(nth == 4, with_("source_identifier", F.lit(""))).when(nth == 5, with_("source_identifier", F.lit("0"))).when(nth == 6, with_("retrieved_at", F.lit(None).cast("timestamp")))
    return quality.provenance_issues(_catalog(spark, sf, "sources").withColumn("sources", damaged.otherwise(s)), SOURCE, SOURCE_TYPE, URL_PART)


def empty_taxonomy_damaged(spark: SparkSession, sf: str) -> DataFrame:
    """Records without any label, in a catalog that has lost categories of every second row and mechanics of every third."""
    games = _catalog(spark, sf, "title", "categories", "mechanics")
    lost = lambda name, n: F.when(F.col("row_seq") % n == 0, F.slice(name, 1, 0)).otherwise(F.col(name))
    return quality.without_taxonomy(games.withColumn("categories", lost("categories", 2)).withColumn("mechanics", lost("mechanics", 3)))


def idlist_dedup_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Users in order of first event, each once; the 11th to the 60th of them."""
    events = table(spark, sf, "events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return events.orderBy("first").offset(10).limit(50).select("user_id", F.col("first.event_id").alias("first_event_id"))


QUERIES = {
    f.__name__: f
    for f in (
        interval_profile_box, play_time_box, complexity_box, interval_kind_by_profile, era_counts, coverage_missingness, numeric_summary, list_length_summary, label_prevalence, top_labels,
        label_profile_lift, label_freq_of_freq, label_threshold_survival, notable_lifts, spearman_pairs, spearman_subsets, spearman_leave_one_out, extreme_flags, anomaly_flags, provenance_issues,
        duplicate_keys, repeated_labels, reconcile_keys, title_marker_filter, empty_taxonomy, composition_boxes, extremes_in_order, anomaly_examples, provenance_damaged, empty_taxonomy_damaged, integrity_report, composition_gaps, idlist_dedup_slice,
    )
}

_R6 = "floor(({}) * 1e6 + 0.5) / 1e6"

_ROWS = """
WITH catalog AS (SELECT * FROM games WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, row_seq DESC) = 1),
rows AS (
  SELECT id, row_seq, title, min_players, max_players, max_players - min_players AS player_span, (min_players + max_players) / 2.0::DOUBLE AS player_midpoint,
    CASE WHEN min_players IS NULL OR max_players IS NULL THEN 'unknown' WHEN min_players = 2 AND max_players = 2 THEN 'two_only' WHEN max_players >= 5 THEN 'five_plus' ELSE 'upto_four' END AS profile,
    min_play_time_minutes, max_play_time_minutes, max_play_time_minutes - min_play_time_minutes AS play_time_span,
    CASE WHEN min_play_time_minutes IS NULL OR max_play_time_minutes IS NULL THEN 'unknown' WHEN min_play_time_minutes = max_play_time_minutes THEN 'point' ELSE 'range' END AS time_kind,
    (min_play_time_minutes + max_play_time_minutes) / 2.0::DOUBLE AS play_time_midpoint,
    CASE WHEN isnan(complexity) THEN NULL ELSE complexity END AS complexity, CASE WHEN isnan(rating) THEN NULL ELSE rating END AS rating, rating_count, release_year,
    CASE WHEN release_year IS NULL THEN 'unknown' WHEN release_year < 1970 THEN 'pre_1970' WHEN release_year < 1995 THEN '1970_1994' WHEN release_year < 2010 THEN '1995_2009'
      WHEN release_year < 2017 THEN '2010_2016' ELSE '2017_plus' END AS era,
    mechanics, categories, publishers, designers, sources, popularity
  FROM catalog),
labels AS (SELECT id, row_seq, profile, pos, mechanics[pos].name AS name FROM (SELECT *, unnest(range(1, len(mechanics) + 1)) AS pos FROM rows))
"""


def _boxes(measures: tuple[str, ...] | list[str]) -> str:
    long = " UNION ALL ".join(f"SELECT '{m}' AS measure, profile, CAST({m} AS DOUBLE) AS v FROM rows" for m in measures)
    return f"""{_ROWS}, long AS ({long}), both_ AS (SELECT measure, profile, v FROM long UNION ALL SELECT measure, 'overall', v FROM long),
    boxes AS (SELECT measure, profile, count(v) AS n, count(*) - count(v) AS n_missing, min(v) AS lowest, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3,
      max(v) AS highest, {_R6.format("avg(v)")} AS mean, {_R6.format("CASE WHEN count(v) = 1 THEN 0 ELSE stddev_samp(v) END")} AS stdev FROM both_ GROUP BY 1, 2),
    frame AS (SELECT * FROM (SELECT unnest({list(measures)!r}) AS measure), (SELECT unnest(['two_only', 'upto_four', 'five_plus', 'unknown', 'overall']) AS profile))
    SELECT f.measure, f.profile, coalesce(n, 0) AS n, coalesce(n_missing, 0) AS n_missing, lowest, q1, median, q3, highest, mean, stdev FROM frame f LEFT JOIN boxes USING (measure, profile)"""


def _rho(source: str, keys: str) -> str:
    """Rank correlation per keys of source (keys, x, y), complete pairs only."""
    return f"""ranked AS (SELECT {keys}, rank() OVER (PARTITION BY {keys} ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0 AS ry FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL),
    rho AS (SELECT {keys}, count(*) AS n, CASE WHEN count(*) >= 8 THEN {_R6.format("covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0)")} END AS rho FROM ranked GROUP BY {keys})"""


_TIME_LIST = ("min_play_time_minutes", "max_play_time_minutes", "play_time_span", "play_time_midpoint")
_GRID = " UNION ALL ".join(
    [f"SELECT '{x}|complexity' AS grid, CAST({x} AS DOUBLE) AS x, complexity AS y FROM rows" for x in (*_TIME_LIST, *_PLAYERS)]
    + [f"SELECT 'log_{x}|complexity', CASE WHEN {x} > 0 THEN ln(CAST({x} AS DOUBLE)) END, complexity FROM rows" for x in _TIME_LIST]
    + [f"SELECT '{p}|{t}', CAST({p} AS DOUBLE), CAST({t} AS DOUBLE) FROM rows" for p in _PLAYERS for t in _TIMES]
)
_EXTREME = """extreme AS (SELECT *, concat_ws('; ', CASE WHEN max_players >= 12 THEN 'max_players=' || max_players END, CASE WHEN player_span >= 20 THEN 'player_span=' || player_span END,
  CASE WHEN max_play_time_minutes >= 300 THEN 'max_play_time_minutes=' || max_play_time_minutes END) AS reason FROM rows)"""
_FIELDS = [(f, "scalar") for f in quality.SCALARS] + [(f, "list") for f in quality.LISTS]
_LIFTS = f"""written AS (SELECT * FROM labels WHERE name IS NOT NULL), enough AS (SELECT name, count(*) AS o FROM written GROUP BY 1),
  holding AS (SELECT DISTINCT id, profile, name FROM written WHERE profile <> 'unknown'), held AS (SELECT name, count(*) AS holders FROM holding GROUP BY 1),
  known AS (SELECT profile, count(*) AS pn, sum(count(*)) OVER () AS kn FROM rows WHERE profile <> 'unknown' GROUP BY 1),
  frame AS (SELECT name, holders, o, profile FROM held JOIN enough USING (name), (SELECT unnest(['two_only', 'upto_four', 'five_plus']) AS profile)),
  cells AS (SELECT f.name, f.holders, f.o, f.profile, count(h.id) AS in_group FROM frame f LEFT JOIN holding h ON h.name = f.name AND h.profile = f.profile GROUP BY 1, 2, 3, 4),
  lifts AS (SELECT c.name, holders, o, c.profile, in_group, {_R6.format("in_group / holders")} AS share,
    {_R6.format("coalesce(pn, 0) / (SELECT max(kn) FROM known)")} AS baseline, {_R6.format("(in_group / holders) / nullif(coalesce(pn, 0) / (SELECT max(kn) FROM known), 0)")} AS lift
    FROM cells c LEFT JOIN known k ON k.profile = c.profile)"""

SQL = {
    "interval_profile_box": _boxes(MEASURES),
    "play_time_box": _boxes(TIME_MEASURES),
    "complexity_box": _boxes(["complexity"]),
    "interval_kind_by_profile": _ROWS
    + """SELECT profile, time_kind, count(id) AS n FROM (SELECT unnest(['two_only', 'upto_four', 'five_plus', 'unknown']) AS profile) CROSS JOIN (SELECT unnest(['point', 'range', 'unknown']) AS time_kind)
      LEFT JOIN rows USING (profile, time_kind) GROUP BY 1, 2""",
    "era_counts": _ROWS
    + f"""SELECT era, count(id) AS n, {_R6.format("count(id) / (SELECT count(*) FROM rows)")} AS share
      FROM (SELECT unnest(['pre_1970', '1970_1994', '1995_2009', '2010_2016', '2017_plus', 'unknown']) AS era) LEFT JOIN rows USING (era) GROUP BY 1""",
    "coverage_missingness": _ROWS
    + " UNION ALL ".join(
        f"""SELECT '{f}' AS field, '{k}' AS kind, count(*) - count(*) FILTER ({f} IS NULL{f" OR len({f}) = 0" if k == "list" else ""}) AS present, count(*) FILTER ({f} IS NULL) AS missing_null,
        {f"count(*) FILTER (len({f}) = 0)" if k == "list" else "CAST(NULL AS BIGINT)"} AS empty_list, {_R6.format(f"100.0 * count(*) FILTER ({f} IS NULL) / count(*)")} AS pct_missing_null,
        {_R6.format(f"100.0 * count(*) FILTER (len({f}) = 0) / count(*)") if k == "list" else "CAST(NULL AS DOUBLE)"} AS pct_empty_list FROM catalog"""
        for f, k in _FIELDS
    ),
    "numeric_summary": _ROWS
    + ", long AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({f} AS DOUBLE) AS v FROM rows" for f in quality.NUMBERS)
    + f""") SELECT field, count(v) AS n, min(v) AS lowest, quantile_cont(v, 0.5) AS median, {_R6.format("avg(v)")} AS mean, max(v) AS highest,
      {_R6.format("CASE WHEN count(v) = 1 THEN 0 ELSE stddev_samp(v) END")} AS stdev FROM long GROUP BY 1""",
    "list_length_summary": _ROWS
    + ", long AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, CAST(coalesce(len({f}), 0) AS DOUBLE) AS v FROM rows" for f in quality.LISTS)
    + f") SELECT field, count(v) AS n, min(v) AS shortest, quantile_cont(v, 0.5) AS median, {_R6.format('avg(v)')} AS mean, max(v) AS longest FROM long GROUP BY 1",
    "label_prevalence": _ROWS
    + f"""SELECT name, count(*) AS occurrences, {_R6.format("count(*) / (SELECT count(*) FROM rows)")} AS share, min((row_seq, pos - 1))[1] AS first_row, CAST(min((row_seq, pos - 1))[2] AS INTEGER) AS first_pos
      FROM labels WHERE name IS NOT NULL GROUP BY 1""",
    "top_labels": _ROWS
    + f"""SELECT name, count(*) AS occurrences, {_R6.format("count(*) / (SELECT count(*) FROM rows)")} AS share FROM labels WHERE name IS NOT NULL GROUP BY 1
      ORDER BY count(*) DESC, min((row_seq, pos)) LIMIT 15""",
    "label_profile_lift": _ROWS + f", {_LIFTS} SELECT name, holders, profile, in_group, share, baseline, lift FROM lifts WHERE holders >= 5 AND o >= 5",
    "label_freq_of_freq": _ROWS + "SELECT occurrences, count(*) AS labels FROM (SELECT name, count(*) AS occurrences FROM labels WHERE name IS NOT NULL GROUP BY 1) GROUP BY 1",
    "label_threshold_survival": _ROWS
    + f""", counts AS (SELECT name, count(*) AS o FROM labels WHERE name IS NOT NULL GROUP BY 1)
      SELECT CAST(least AS INTEGER) AS least, count(*) FILTER (o >= least) AS labels, {_R6.format("count(*) FILTER (o >= least) / count(*)")} AS share FROM counts, (SELECT unnest([1, 2, 3, 5, 10, 20]) AS least) GROUP BY 1""",
    "notable_lifts": _ROWS
    + f""", {_LIFTS}, best AS (SELECT name, least(holders, o) AS size, max(lift) AS lift FROM lifts GROUP BY 1, 2)
      SELECT CAST(t AS INTEGER) AS least, count(*) AS compared, count(*) FILTER (lift >= 1.5) AS notable FROM best, (SELECT unnest([3, 5, 10, 20]) AS t) WHERE size >= t GROUP BY 1""",
    "spearman_pairs": _ROWS
    + f""", grid AS ({_GRID}), {_rho("grid", "grid")}, missing AS (SELECT grid, count(*) FILTER (x IS NULL) AS missing_x, count(*) FILTER (y IS NULL) AS missing_y FROM grid GROUP BY 1)
      SELECT split_part(m.grid, '|', 1) AS x, split_part(m.grid, '|', 2) AS y, coalesce(n, 0) AS n, missing_x, missing_y, rho FROM missing m LEFT JOIN rho r ON r.grid = m.grid""",
    "spearman_subsets": _ROWS
    + f""", grid AS (
      {" UNION ALL ".join(f"SELECT '{s}<={lim}|{x}' AS grid, CAST({x} AS DOUBLE) AS x, complexity AS y FROM rows WHERE {s} <= {lim}" for s, lim in (("max_players", 12), ("player_span", 20)) for x in ("max_players", "play_time_midpoint"))}),
      {_rho("grid", "grid")}, missing AS (SELECT grid, count(*) FILTER (x IS NULL) AS missing_x, count(*) FILTER (y IS NULL) AS missing_y FROM grid GROUP BY 1)
      SELECT split_part(m.grid, '|', 2) AS x, 'complexity' AS y, coalesce(n, 0) AS n, missing_x, missing_y, rho, split_part(m.grid, '|', 1) AS subset FROM missing m LEFT JOIN rho r ON r.grid = m.grid""",
    "spearman_leave_one_out": _ROWS
    + f""", {_EXTREME}, long AS ({" UNION ALL ".join(f"SELECT id, '{x}' AS m, CAST({x} AS DOUBLE) AS x, complexity AS y FROM rows" for x in _TIME_LIST)}),
      gone AS (SELECT id AS gone_id, reason FROM extreme WHERE reason <> ''), cases AS (SELECT m, gone_id, x, y FROM long, gone WHERE id <> gone_id
        UNION ALL SELECT m, '', x, y FROM long), {_rho("cases", "m, gone_id")}
      SELECT g.gone_id AS id, g.reason, f.m AS x, f.rho AS rho_full, w.rho AS rho_without, f.n AS n_full, w.n AS n_without
      FROM gone g JOIN rho w ON w.gone_id = g.gone_id JOIN rho f ON f.m = w.m AND f.gone_id = ''""",
    "extreme_flags": _ROWS
    + f", {_EXTREME} SELECT id, min_players, max_players, player_span, min_play_time_minutes, max_play_time_minutes, complexity, reason FROM extreme WHERE reason <> ''",
    "anomaly_flags": _ROWS
    + ", few AS (SELECT *, rating_count IS NULL OR rating_count = 0 AS no_votes FROM rows) "
    + " UNION ALL ".join(
        f"SELECT id, CAST({i} AS INTEGER) AS flag_no, '{code}' AS code FROM few WHERE {condition}"
        for i, (code, condition) in enumerate(
            [
                ("implausible_year", f"release_year < 1800 OR release_year > {LATEST_YEAR}"),
                ("player_range_inverted", "min_players > max_players"),
                ("play_time_range_inverted", "min_play_time_minutes > max_play_time_minutes"),
                *[x for f in ("min_players", "max_players", "min_play_time_minutes", "max_play_time_minutes") for x in (("negative_value", f"{f} < 0"), ("unexpected_zero", f"{f} = 0"))],
                ("negative_value", "rating_count < 0"),
                ("large_player_count", "max_players > 20"),
                ("long_play_time", "max_play_time_minutes > 480"),
                ("rating_off_scale", "rating NOT BETWEEN 1 AND 10"),
                ("complexity_off_scale", "complexity NOT BETWEEN 1 AND 5"),
                ("rating_count_without_rating", "rating IS NULL AND NOT no_votes"),
                ("rating_without_count", "rating IS NOT NULL AND no_votes"),
                ("large_publisher_list", "len(publishers) >= 30"),
                ("large_mechanic_list", "len(mechanics) >= 15"),
                ("large_category_list", "len(categories) >= 8"),
            ]
        )
    ),
    "provenance_issues": _ROWS
    + ", one AS (SELECT id, coalesce(len(sources), 0) AS k, sources[1] AS s FROM rows) "
    + " UNION ALL ".join(
        [
            "SELECT id, 'source_count' AS issue FROM one WHERE k <> 1",
            f"SELECT id, 'source' FROM one WHERE k = 1 AND s.source IS DISTINCT FROM '{SOURCE}'",
            f"SELECT id, 'source_type' FROM one WHERE k = 1 AND s.source_type IS DISTINCT FROM '{SOURCE_TYPE}'",
            f"SELECT id, 'url' FROM one WHERE k = 1 AND NOT coalesce(contains(s.url, '{URL_PART}'), false)",
            "SELECT id, 'missing_identifier' FROM one WHERE k = 1 AND coalesce(s.source_identifier, '') = ''",
            "SELECT id, 'identifier_mismatch' FROM one WHERE k = 1 AND s.source_identifier <> '' AND id <> 'bgg-' || s.source_identifier",
            "SELECT id, 'missing_retrieved_at' FROM one WHERE k = 1 AND s.retrieved_at IS NULL",
        ]
    ),
    "duplicate_keys": _ROWS
    + """SELECT id AS value, count(*) AS n, 'id' AS field FROM games GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT title, count(*), 'title' FROM catalog GROUP BY 1 HAVING count(*) > 1""",
    "repeated_labels": _ROWS
    + """SELECT id, string_agg(label, ', ' ORDER BY label) AS repeated FROM (
      SELECT id, label FROM (SELECT id, unnest(mechanics).id AS label FROM rows) WHERE label IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1""",
    "reconcile_keys": """SELECT id, 'left_only' AS side FROM (SELECT id FROM games WHERE id IS NOT NULL EXCEPT SELECT game_id FROM documents)
      UNION ALL SELECT game_id, 'right_only' FROM (SELECT game_id FROM documents WHERE game_id IS NOT NULL EXCEPT SELECT id FROM games)""",
    "title_marker_filter": _ROWS + "SELECT id, title FROM catalog WHERE lower(title) LIKE '%deluxe%' OR lower(title) LIKE '%legacy%' OR lower(title) LIKE '%2nd ed%'",
    "empty_taxonomy": _ROWS + "SELECT id, title FROM catalog WHERE coalesce(len(categories), 0) = 0 AND coalesce(len(mechanics), 0) = 0",
    "composition_gaps": _ROWS
    + """SELECT id, 'mechanics' AS missing FROM rows WHERE coalesce(len(mechanics), 0) = 0
      UNION ALL SELECT id, 'play_time' FROM rows WHERE min_play_time_minutes IS NULL OR max_play_time_minutes IS NULL UNION ALL SELECT id, 'complexity' FROM rows WHERE complexity IS NULL""",
    "idlist_dedup_slice": """SELECT user_id, first[2] AS first_event_id FROM (SELECT user_id, min((ts, event_id)) AS first FROM events GROUP BY 1) ORDER BY first LIMIT 50 OFFSET 10""",
}
SQL |= {
    "composition_boxes": _boxes(list(_NINE)).replace("mechanics_per_game AS DOUBLE", "coalesce(len(mechanics), 0) AS DOUBLE"),
    "extremes_in_order": _ROWS
    + f""", {_EXTREME}, placed AS (SELECT *, row_number() OVER (ORDER BY coalesce(max_players, 0) DESC, coalesce(player_span, 0) DESC, row_seq) AS p FROM extreme WHERE reason <> '')
    SELECT CAST(p AS INTEGER) AS place, id, max_players, player_span, reason FROM placed WHERE p <= 50""",
    "anomaly_examples": f"""SELECT code, count(*) AS records, array_to_string(list_sort(list(id))[1:20], ',') AS first_ids FROM (SELECT DISTINCT code, id FROM ({SQL["anomaly_flags"]})) GROUP BY 1""",
    "provenance_damaged": _ROWS
    + ", one AS (SELECT id, CASE WHEN row_seq % 11 = 0 THEN 2 ELSE coalesce(len(sources), 0) END AS k, CASE WHEN row_seq % 11 = 1 THEN 'elsewhere' ELSE sources[1].source END AS source, "
    + "CASE WHEN row_seq % 11 <> 2 THEN sources[1].source_type END AS source_type, CASE WHEN row_seq % 11 = 3 THEN 'x' ELSE sources[1].url END AS url, "
    + "CASE row_seq % 11 WHEN 4 THEN '' WHEN 5 THEN '0' ELSE sources[1].source_identifier END AS ident, CASE WHEN row_seq % 11 <> 6 THEN sources[1].retrieved_at END AS at_ FROM rows) "
    + " UNION ALL ".join(
        [
            "SELECT id, 'source_count' AS issue FROM one WHERE k <> 1",
            f"SELECT id, 'source' FROM one WHERE k = 1 AND source IS DISTINCT FROM '{SOURCE}'",
            f"SELECT id, 'source_type' FROM one WHERE k = 1 AND source_type IS DISTINCT FROM '{SOURCE_TYPE}'",
            f"SELECT id, 'url' FROM one WHERE k = 1 AND NOT coalesce(contains(url, '{URL_PART}'), false)",
            "SELECT id, 'missing_identifier' FROM one WHERE k = 1 AND coalesce(ident, '') = ''",
            "SELECT id, 'identifier_mismatch' FROM one WHERE k = 1 AND coalesce(ident, '') <> '' AND id <> 'bgg-' || ident",
            "SELECT id, 'missing_retrieved_at' FROM one WHERE k = 1 AND at_ IS NULL",
        ]
    ),
    "empty_taxonomy_damaged": _ROWS
    + "SELECT id, title FROM catalog WHERE (row_seq % 2 = 0 OR coalesce(len(categories), 0) = 0) AND (row_seq % 3 = 0 OR coalesce(len(mechanics), 0) = 0)",
}
SQL["integrity_report"] = (
    SQL["provenance_issues"].split(", one AS")[0]
    + f""", issues AS (WITH one AS (SELECT id, coalesce(len(sources), 0) AS k, sources[1] AS s FROM rows) {SQL["provenance_issues"].split("FROM rows) ", 1)[1].split("FROM rows) ")[-1]})
    SELECT 'delivered_rows' AS "check", count(*) AS records FROM games UNION ALL SELECT 'distinct_ids', count(*) FROM catalog
    UNION ALL SELECT 'repeated_ids', count(*) FROM (SELECT id FROM games GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'repeated_titles', count(*) FROM (SELECT title FROM catalog GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'empty_taxonomy', count(*) FROM catalog WHERE coalesce(len(categories), 0) = 0 AND coalesce(len(mechanics), 0) = 0
    UNION ALL SELECT 'repeated_labels', count(DISTINCT id) FROM (SELECT id, label FROM (SELECT id, unnest(mechanics).id AS label FROM rows) WHERE label IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
    UNION ALL SELECT 'expansion_like_titles', count(*) FROM catalog WHERE regexp_matches(lower(title), 'expansion|accessory|promo')
    UNION ALL SELECT 'provenance_issues', count(*) FROM issues"""
)
