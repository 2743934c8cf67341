"""Queries of the general data-pipeline problems (p1, p2, p4) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structlens.operators import profile, shred, snapshots
from structlens.sources.tables import table


def _snapshot_arguments(spark: SparkSession, sf: str) -> tuple:
    df = table(spark, sf, "game_snapshots").select("snapshot_id", "id", "rating", "rating_count", "delivered_at", F.get("sources", F.lit(0)).getField("retrieved_at").alias("retrieved_at"))
    values = {"rating": snapshots.missing_as_null(F.col("rating"), "double"), "rating_count": F.col("rating_count")}
    return df, "snapshot_id", snapshots.clean_key("id"), values, [F.col("retrieved_at"), F.col("delivered_at")]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.snapshot_changes(*_snapshot_arguments(spark, sf)).select("snapshot_id", F.col("key").alias("game_id"), "change_kind")


def p1_change_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per snapshot and kind of change: records, and how far rating and its count moved in all."""
    changes = snapshots.snapshot_changes(*_snapshot_arguments(spark, sf))
    step = F.col("after.rating_count").cast("bigint") - F.col("before.rating_count").cast("bigint")
    return changes.groupBy("snapshot_id", "change_kind").agg(
        F.count("*").alias("records"),
        F.count_if(~F.col("before.rating").eqNullSafe(F.col("after.rating")) & (F.col("change_kind") == "changed")).alias("rating_changes"),
        F.coalesce(F.sum(step), F.lit(0)).alias("rating_count_step"),
    )


_P1_SQL = """
WITH slim AS (
  SELECT snapshot_id, nullif(regexp_replace(lower(id), '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g'), '') AS game_id,
         sources[1].retrieved_at AS retrieved_at, delivered_at,
         CASE WHEN isnan(rating) THEN NULL ELSE rating END AS rating, rating_count
  FROM game_snapshots WHERE snapshot_id IS NOT NULL),
standing AS (
  SELECT * FROM slim WHERE game_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_id, game_id ORDER BY retrieved_at DESC NULLS LAST,
    delivered_at DESC NULLS LAST, rating DESC NULLS LAST, rating_count DESC NULLS LAST) = 1),
ids AS (SELECT snapshot_id, lag(snapshot_id) OVER (ORDER BY snapshot_id) AS before_id FROM (SELECT DISTINCT snapshot_id FROM slim)),
now AS (SELECT s.*, i.before_id FROM standing s JOIN ids i USING (snapshot_id) WHERE i.before_id IS NOT NULL),
old AS (SELECT s.*, i.snapshot_id AS at FROM standing s JOIN ids i ON i.before_id = s.snapshot_id),
changes AS (
  SELECT coalesce(n.snapshot_id, o.at) AS snapshot_id, coalesce(n.game_id, o.game_id) AS game_id,
    CASE WHEN o.game_id IS NULL THEN 'added' WHEN n.game_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
    n.rating AS new_rating, o.rating AS old_rating, n.rating_count AS new_count, o.rating_count AS old_count
  FROM now n FULL JOIN old o ON n.snapshot_id = o.at AND n.game_id = o.game_id
  WHERE n.game_id IS NULL OR o.game_id IS NULL OR n.rating IS DISTINCT FROM o.rating OR n.rating_count IS DISTINCT FROM o.rating_count)
"""

LOAD_RULES = (
    profile.ColumnRule("release_year", 1800, 2030),
    profile.ColumnRule("complexity", 1, 5),
    profile.ColumnRule("min_play_time_minutes", 1, 1440),
)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return profile.load_issues(table(spark, sf, "game_loads"), "feed_id", "load_id", "row_seq", LOAD_RULES)


def p2_load_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The figures behind the issues, per load and column."""
    counts = profile.profiled_counts(table(spark, sf, "game_loads"), "feed_id", "load_id", "row_seq", LOAD_RULES)
    columns = ["feed_id", "load_id", "column_name", "rows", "missing", "malformed", "numbers", "distinct_numbers", "outside", "lowest", "highest"]
    return profile.load_profile(counts, LOAD_RULES).select(*columns)


def p2_mask_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.mask_profile(table(spark, sf, "game_loads"), "feed_id", "load_id", "row_seq", LOAD_RULES)


_P2_CELLS = """
WITH lines AS (SELECT feed_id, load_id, row_seq, max({'a': release_year, 'b': complexity, 'c': min_play_time_minutes}) AS r
  FROM game_loads GROUP BY 1, 2, 3),
cells AS (
  SELECT feed_id, load_id, column_name, value,
    CASE WHEN regexp_full_match(value, CASE WHEN column_name = 'complexity' THEN '-?[0-9]+([.][0-9]+)?' ELSE '-?[0-9]+' END) THEN CAST(value AS DOUBLE) END AS number
  FROM (
    SELECT feed_id, load_id, 'release_year' AS column_name, trim(r.a, ' ' || chr(9)) AS value FROM lines
    UNION ALL SELECT feed_id, load_id, 'complexity', trim(r.b, ' ' || chr(9)) FROM lines
    UNION ALL SELECT feed_id, load_id, 'min_play_time_minutes', trim(r.c, ' ' || chr(9)) FROM lines)),
stated AS (SELECT *, CASE WHEN value IS NULL OR value = '' OR number = 0 THEN 'missing' WHEN number IS NOT NULL THEN 'number' ELSE 'other' END AS state FROM cells),
profile AS (
  SELECT feed_id, load_id, column_name, count(*) AS rows, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'other') AS malformed,
    count(*) FILTER (state = 'number') AS numbers, count(DISTINCT number) FILTER (state = 'number') AS distinct_numbers,
    count(*) FILTER (state = 'number' AND (number < CASE column_name WHEN 'release_year' THEN 1800 ELSE 1 END
      OR number > CASE column_name WHEN 'release_year' THEN 2030 WHEN 'complexity' THEN 5 ELSE 1440 END)) AS outside,
    min(number) FILTER (state = 'number') AS lowest, max(number) FILTER (state = 'number') AS highest
  FROM stated GROUP BY 1, 2, 3)
"""

_P2_FOUND = (
    _P2_CELLS
    + """,
paired AS (
  SELECT *, lag(load_id) OVER w AS before_id, lag(rows) OVER w AS before_rows, lag(missing) OVER w AS before_missing, lag(distinct_numbers) OVER w AS before_distinct,
    lag(numbers) OVER w AS before_numbers
  FROM profile WINDOW w AS (PARTITION BY feed_id, column_name ORDER BY load_id)),
numbers AS (SELECT feed_id, column_name, load_id, number, count(*) AS n FROM stated WHERE state = 'number' GROUP BY ALL),
points AS (
  SELECT feed_id, column_name, at_load, number, sum(now) AS now, sum(old) AS old, any_value(all_now) AS all_now, any_value(all_old) AS all_old FROM (
    SELECT p.feed_id, p.column_name, p.load_id AS at_load, number, n AS now, 0 AS old, p.numbers AS all_now, p.before_numbers AS all_old
    FROM paired p JOIN numbers x ON x.feed_id = p.feed_id AND x.column_name = p.column_name AND x.load_id = p.load_id WHERE before_id IS NOT NULL
    UNION ALL
    SELECT p.feed_id, p.column_name, p.load_id, number, 0, n, p.numbers, p.before_numbers
    FROM paired p JOIN numbers x ON x.feed_id = p.feed_id AND x.column_name = p.column_name AND x.load_id = p.before_id) GROUP BY 1, 2, 3, 4),
sums AS (SELECT *, sum(now) OVER w AS cum_now, sum(old) OVER w AS cum_old FROM points WINDOW w AS (PARTITION BY feed_id, column_name, at_load ORDER BY number)),
drifted AS (SELECT DISTINCT feed_id, column_name, at_load FROM sums WHERE all_now > 0 AND all_old > 0
  AND 4 * abs(CAST(cum_now AS HUGEINT) * all_old - CAST(cum_old AS HUGEINT) * all_now) > CAST(all_now AS HUGEINT) * all_old)
SELECT feed_id, load_id, column_name, 'pattern' AS issue FROM paired WHERE malformed * 100 > (rows - missing) * 2
UNION ALL SELECT feed_id, load_id, column_name, 'range' FROM paired WHERE outside * 100 > numbers
UNION ALL SELECT feed_id, load_id, column_name, 'distinct' FROM paired WHERE before_id IS NOT NULL AND distinct_numbers * 2 < before_distinct
UNION ALL SELECT feed_id, at_load AS load_id, column_name, 'drift' FROM drifted
UNION ALL SELECT feed_id, load_id, column_name, 'nulls' FROM paired WHERE before_id IS NOT NULL AND (missing * before_rows - before_missing * rows) * 10 > rows * before_rows
"""
)

_P2_MASKS = (
    _P2_CELLS
    + """,
masked AS (SELECT feed_id, load_id, column_name,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '[0-9]+', '9', 'g'), '\\p{Lu}+', 'A', 'g'), '[\\p{Ll}\\p{Lt}\\p{Lm}\\p{Lo}]+', 'a', 'g'), '[\\s\\x{A0}]+', ' ', 'g') AS mask
  FROM stated WHERE state <> 'missing'),
counts AS (SELECT feed_id, load_id, column_name, mask, count(*) AS n FROM masked GROUP BY ALL),
overall AS (SELECT column_name, mask, sum(n) AS mask_n, sum(sum(n)) OVER (PARTITION BY column_name) AS column_n FROM counts GROUP BY 1, 2),
dominant AS (SELECT column_name, mask FROM overall WHERE mask_n * 100 >= column_n * 2),
loads AS (
  SELECT c.feed_id, c.load_id, c.column_name, CAST(sum(n) AS BIGINT) AS filled, count(*) AS masks, count(d.mask) AS dominant_masks,
    CAST(coalesce(sum(n) FILTER (d.mask IS NULL), 0) AS BIGINT) AS rare_values, max({'n': n, 'mask': c.mask}).mask AS top_mask
  FROM counts c LEFT JOIN dominant d ON d.column_name = c.column_name AND d.mask = c.mask GROUP BY 1, 2, 3),
chain AS (SELECT feed_id, load_id, column_name, filled, lag(load_id) OVER w AS before_id, lag(filled) OVER w AS before_filled
  FROM loads WINDOW w AS (PARTITION BY feed_id, column_name ORDER BY load_id)),
moved AS (
  SELECT feed_id, column_name, at_load, mask, sum(change) AS change FROM (
    SELECT h.feed_id, h.column_name, h.load_id AS at_load, mask, n / filled AS change FROM chain h JOIN counts c ON c.feed_id = h.feed_id AND c.column_name = h.column_name AND c.load_id = h.load_id WHERE before_id IS NOT NULL
    UNION ALL
    SELECT h.feed_id, h.column_name, h.load_id, mask, -n / before_filled FROM chain h JOIN counts c ON c.feed_id = h.feed_id AND c.column_name = h.column_name AND c.load_id = h.before_id) GROUP BY 1, 2, 3, 4),
distance AS (SELECT feed_id, column_name, at_load, sum(abs(change)) / 2 AS divergence FROM moved GROUP BY 1, 2, 3)
SELECT l.*, floor(divergence * 1e6 + 0.5) / 1e6 AS divergence
FROM loads l LEFT JOIN distance x ON x.feed_id = l.feed_id AND x.column_name = l.column_name AND x.at_load = l.load_id
"""
)

#: Repeated ancestors of a thing document; what else should repeat shows up in p4_unplaced and p4_ancestors, it is not lost.
REPEATED = (
    "items/item", "items/item/name", "items/item/link", "items/item/poll", "items/item/poll/results", "items/item/poll/results/result",
    "items/item/marketplacelistings/listing", "items/item/versions/item", "items/item/versions/item/name", "items/item/versions/item/link",
)


def _instances(spark: SparkSession, sf: str, *keep: str, whole: bool = False) -> DataFrame:
    return shred.instance_table(table(spark, sf, "raw_artifacts"), "artifact_id", "body", ["retrieved_at"], "items", REPEATED, None if whole else keep)


def _flat(spark: SparkSession, sf: str, anchor: str, positions: list[str], columns: dict[str, str]) -> DataFrame:
    return shred.pivot(_instances(spark, sf, anchor), anchor, positions, columns).withColumnRenamed("record_id", "artifact_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    anchors = ("items/item/link", "items/item/versions/item/link")
    nested = F.size("positions") == 3
    text = lambda path: shred.trimmed(F.try_element_at("fields", F.lit(path)))
    links = _instances(spark, sf, *anchors).where(F.col("anchor").isin(*anchors)).select(
        F.col("record_id").alias("artifact_id"),
        F.get("positions", F.lit(0)).alias("item_pos"),
        F.when(nested, F.get("positions", F.lit(1))).otherwise(0).alias("version_pos"),
        F.element_at("positions", -1).alias("link_pos"),
        text("@type").alias("link_kind"),
        text("@value").alias("link_value"),
    )
    return links.where((F.col("link_kind") != "") & (F.col("link_value") != ""))


def p4_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "items", [], {"terms_of_use": "@termsofuse"})


def p4_items(spark: SparkSession, sf: str) -> DataFrame:
    columns = {
        "item_type": "@type", "item_id": "@id", "description": "description/text()", "year": "yearpublished/@value", "min_players": "minplayers/@value", "max_players": "maxplayers/@value",
        "play_time": "playingtime/@value", "min_play_time": "minplaytime/@value", "max_play_time": "maxplaytime/@value", "ratings_page": "statistics/@page",
        "users_rated": "statistics/ratings/usersrated/@value", "average": "statistics/ratings/average/@value",
        "num_weights": "statistics/ratings/numweights/@value", "average_weight": "statistics/ratings/averageweight/@value",
    }
    return _flat(spark, sf, "items/item", ["item_pos"], columns)


def p4_names(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "items/item/name", ["item_pos", "name_pos"], {"name_type": "@type", "sort_index": "@sortindex", "name": "@value"})


def p4_polls(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "items/item/poll", ["item_pos", "poll_pos"], {"poll_name": "@name", "title": "@title", "total_votes": "@totalvotes"})


def p4_poll_results(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "items/item/poll/results", ["item_pos", "poll_pos", "results_pos"], {"num_players": "@numplayers"})


def p4_poll_votes(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "items/item/poll/results/result", ["item_pos", "poll_pos", "results_pos", "result_pos"], {"answer": "@value", "votes": "@numvotes"})


def p4_listings(spark: SparkSession, sf: str) -> DataFrame:
    columns = {"price": "price/@value", "currency": "price/@currency", "href": "link/@href", "title": "link/@title"}
    return _flat(spark, sf, "items/item/marketplacelistings/listing", ["item_pos", "listing_pos"], columns)


def p4_versions(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "items/item/versions/item", ["item_pos", "version_pos"], {"version_type": "@type", "version_id": "@id", "year": "yearpublished/@value"})


def p4_version_names(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf, "items/item/versions/item/name", ["item_pos", "version_pos", "name_pos"], {"name_type": "@type", "sort_index": "@sortindex", "name": "@value"})


def p4_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return shred.rejects(_instances(spark, sf)).withColumnRenamed("record_id", "artifact_id")


def p4_unplaced(spark: SparkSession, sf: str) -> DataFrame:
    """Values for which the declared ancestors have no place of their own; none on the given tables."""
    return shred.unplaced(_instances(spark, sf, whole=True)).withColumnRenamed("record_id", "artifact_id")


def p4_paths(spark: SparkSession, sf: str) -> DataFrame:
    return shred.path_summary(table(spark, sf, "raw_artifacts"), "artifact_id", "body", ["retrieved_at"])


def p4_reconciled(spark: SparkSession, sf: str) -> DataFrame:
    """Every path of the documents against all tables made of them: unaccounted is 0 throughout."""
    summary = shred.path_summary(table(spark, sf, "raw_artifacts"), "artifact_id", "body", ["retrieved_at"], "items")
    return shred.reconcile(summary, _instances(spark, sf, whole=True), "items")


def p4_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """The element paths that repeat under one parent, and whether a table is declared for them."""
    summary = shred.path_summary(table(spark, sf, "raw_artifacts"), "artifact_id", "body", ["retrieved_at"], "items")
    found = summary.where(shred.is_element(F.col("path")) & (F.col("most_in_parent") > 1))
    return found.select("path", "occurrences", "most_in_parent", F.col("path").isin(*REPEATED).alias("has_table"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_change_summary, p2_found, p2_load_profile, p2_mask_profile, p4_found, p4_documents, p4_items, p4_names, p4_polls, p4_poll_results, p4_poll_votes, p4_listings, p4_versions,
        p4_version_names, p4_rejects, p4_unplaced, p4_paths, p4_reconciled, p4_ancestors,
    )
}

SQL = {
    "p1_found": _P1_SQL + "SELECT snapshot_id, game_id, change_kind FROM changes",
    "p1_change_summary": _P1_SQL
    + """SELECT snapshot_id, change_kind, count(*) AS records,
      count(*) FILTER (change_kind = 'changed' AND new_rating IS DISTINCT FROM old_rating) AS rating_changes,
      CAST(coalesce(sum(CAST(new_count AS BIGINT) - CAST(old_count AS BIGINT)), 0) AS BIGINT) AS rating_count_step
    FROM changes GROUP BY 1, 2""",
    "p2_found": _P2_FOUND,
    "p2_load_profile": _P2_CELLS + "SELECT * FROM profile",
    "p2_mask_profile": _P2_MASKS,
}
