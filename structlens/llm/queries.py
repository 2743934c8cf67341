"""Queries of the training-data problems over their whole tables."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structlens.llm import cooccurrence, mixing, packing, quantiles, similar_sets, term_frequency, tokens, toxicity
from structlens.operators import labels
from structlens.sources.tables import table
from structlens.storage import materialize


PERCENTS = (1, *range(5, 100, 5), 99)
MEASURES = ("complexity", "max_play_time_minutes", "rating")


def _kept_sketches(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["corpus_id", "snapshot_date"]
    return quantiles.merge(quantiles.build(table(spark, sf, "game_snapshots"), keys, MEASURES), keys)


def p3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Per corpus and date, with the bound of the rank error; exact while a group has fewer than 8,192 values."""
    return quantiles.percentiles(_kept_sketches(spark, sf), ["corpus_id", "snapshot_date"], PERCENTS)


def p3_unions(spark: SparkSession, sf: str) -> DataFrame:
    """Per corpus over all dates, per date over all corpora, and over all, from the sketches kept per corpus and date."""
    kept = _kept_sketches(spark, sf)
    none_corpus, none_date = F.lit(None).cast("string").alias("corpus_id"), F.lit(None).cast("date").alias("snapshot_date")
    sets = F.array(F.struct(F.lit("corpus").alias("union_of"), "corpus_id", none_date), F.struct(F.lit("date").alias("union_of"), none_corpus, "snapshot_date"), F.struct(F.lit("all").alias("union_of"), none_corpus, none_date))
    keys = ["union_of", "corpus_id", "snapshot_date"]
    spread = kept.select(F.inline(sets), *[f.split()[0] for f in quantiles.FIELDS.split(", ")])
    numbered = spread.withColumn("part", F.pmod(F.xxhash64(*keys, "n", "lowest", "highest", "missing"), F.lit(quantiles.SHARES)).cast("int"))
    return quantiles.percentiles(quantiles.merge(numbered, keys), keys, PERCENTS)


#: A sketch small enough to collapse at every size: buffers of 4 values, 3 at a time.
SMALL = {"size": 4, "fan": 3}


def p3_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles from very small sketches held against the data: whether each value's true ranks come within the stated error."""
    keys, names = ["corpus_id", "snapshot_date"], ("corpus_id", "snapshot_date", "column_name")
    snapshots = table(spark, sf, "game_snapshots")
    sketches = quantiles.merge(quantiles.build(snapshots, keys, MEASURES, **SMALL), keys, **SMALL)
    found = materialize(quantiles.percentiles(sketches, keys, PERCENTS, **SMALL).where("n > 0"), "small-percentiles")
    wide = found.groupBy(*[F.col(c).alias(f"_{c}") for c in names]).agg(F.array_sort(F.collect_list(F.struct("percent", "value"))).alias("_v"))
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    long = snapshots.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), value(c).alias("x")) for c in MEASURES]))).where("x is not null")
    at = lambda i: F.get("_v", F.lit(i))["value"]
    counts = long.join(wide, same).groupBy(*names).agg(*[F.count_if(F.col("x") < at(i)).alias(f"b{i}") for i in range(len(PERCENTS))], *[F.count_if(F.col("x") <= at(i)).alias(f"u{i}") for i in range(len(PERCENTS))])
    ranks = counts.select(*[F.col(c).alias(f"_{c}") for c in names], F.inline(F.array(*[F.struct(F.lit(p).alias("_p"), F.col(f"b{i}").alias("below"), F.col(f"u{i}").alias("upto")) for i, p in enumerate(PERCENTS)])))
    wanted = F.greatest(F.lit(1), F.ceil(F.col("percent") * F.col("n") / F.lit(100.0)))
    within = (F.col("below") + 1 - F.col("rank_error") <= wanted) & (wanted <= F.col("upto") + F.col("rank_error"))
    return found.join(ranks, same & (F.col("percent") == F.col("_p"))).select(*names, "percent", "n", (F.col("rank_error") > 0).alias("collapsed"), within.alias("within"))


def _label_sets(spark: SparkSession, sf: str) -> DataFrame:
    return labels.game_labels(table(spark, sf, "games")).select("id", F.array_distinct("written").alias("items"))


#: The 5 % point of the log-likelihood ratio (chi squared, one degree of freedom). Five games and three times the chance rate give 4.3 at the least.
SIGNIFICANT = 3.841


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return cooccurrence.cooccurrence(_label_sets(spark, sf), "id", "items", min_joint=5, min_lift=3, min_llr=SIGNIFICANT).select("item_a", "item_b")


def p5_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs on at least 5 games with counts, lift and log-likelihood ratio."""
    pairs = cooccurrence.cooccurrence(_label_sets(spark, sf), "id", "items", min_joint=5)
    rounded = [(F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c) for c in ("lift", "llr")]
    return pairs.select("item_a", "item_b", "joint", "count_a", "count_b", "records", *rounded)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return similar_sets.similar_pairs(_label_sets(spark, sf), "id", "items", Fraction(4, 5), min_items=5).select("id_a", "id_b")


def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    return similar_sets.similarity_classes(_label_sets(spark, sf), "id", "items", Fraction(4, 5), min_items=5).withColumnRenamed("record_key", "id")


def _label_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Every label, read off the suffix array as a complete sequence of its kind and its name's words."""
    current = labels.game_labels(table(spark, sf, "games"))
    games = current.count()
    after = lambda w: F.substr(w, F.instr(w, ":") + 1)
    terms = F.transform("written", lambda w: F.concat(F.array(F.substring_index(w, ":", 1)), F.split(after(w), " ")))
    counts = term_frequency.run_frequencies(current.select(terms.alias("sequences")), "sequences", complete=True)
    verdict = F.when(F.col("records") < 5, "rare").when(F.col("records") * 10 > games, "common")
    return counts.select(F.get("gram", F.lit(0)).alias("item_kind"), F.array_join(F.slice("gram", F.lit(2), F.size("gram")), " ").alias("label_name"), "occurrences", F.col("records").alias("games"), verdict.alias("verdict"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _label_frequency(spark, sf).where(F.col("verdict").isNotNull()).select("item_kind", "label_name", "verdict")


def p7_label_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _label_frequency(spark, sf).select("item_kind", "label_name", "occurrences", "games", F.coalesce("verdict", F.lit("useful")).alias("verdict"))


def p7_word_runs_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of any number of words inside label names: times written and games."""
    words = labels.game_labels(table(spark, sf, "games")).select(F.transform("written", lambda x: F.split(F.regexp_replace(x, "^[a-z]+:", ""), " ")).alias("sequences"))
    return term_frequency.run_frequencies(words, "sequences").select("n", F.array_join("gram", " ").alias("words"), "occurrences", F.col("records").alias("games"))


_LABELS = """
WITH current AS (
  SELECT * FROM games WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) = 1),
written AS (
  SELECT id, kind, nullif(trim(regexp_replace(lower(name), '[\\s\\x{A0}_-]+', ' ', 'g')), '') AS name FROM (
    SELECT id, 'mechanic' AS kind, unnest(mechanics).name AS name FROM current
    UNION ALL SELECT id, 'category', unnest(categories) FROM current)),
labels AS (SELECT DISTINCT id, kind || ':' || name AS item FROM written WHERE name IS NOT NULL),
total AS (SELECT count(*) AS games FROM current)
"""

_PAIRS = (
    _LABELS
    + """,
counts AS (SELECT item, count(*) AS n FROM labels GROUP BY 1),
pairs AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS joint FROM labels a JOIN labels b ON a.id = b.id AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 5),
measured AS (SELECT p.*, x.n AS count_a, y.n AS count_b, games AS records
  FROM pairs p JOIN counts x ON x.item = item_a JOIN counts y ON y.item = item_b, total)
"""
)

_SIMILAR = (
    _LABELS
    + """,
sizes AS (SELECT id, count(*) AS n FROM labels GROUP BY 1 HAVING count(*) >= 5),
shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS overlap FROM labels a JOIN labels b ON a.item = b.item AND a.id < b.id
  WHERE a.id IN (SELECT id FROM sizes) AND b.id IN (SELECT id FROM sizes) GROUP BY 1, 2),
similar_pairs AS (SELECT id_a, id_b FROM shared JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b WHERE overlap * 5 >= (x.n + y.n - overlap) * 4)
"""
)

CAPACITY = 2048


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    counted = tokens.token_counts(table(spark, sf, "documents"), {"doc_id": F.col("doc_id")}, "text", tokens.rank_file(spark))
    return packing.pack(materialize(counted, "token-counts"), F.col("doc_id"), F.col("tokens"), CAPACITY)


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, in pieces only where it exceeds 2,048 tokens, and its container."""
    return _packed(spark, sf).withColumnRenamed("item", "doc_id")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(_packed(spark, sf), CAPACITY)


def p8_audit(spark: SparkSession, sf: str) -> DataFrame:
    """One row that SQL can tell: every document is placed whole, none that fits is cut, no container holds too much."""
    placed = materialize(_packed(spark, sf), "packed")
    docs = placed.groupBy("item").agg(F.count("*").alias("pieces"), F.sum("size").alias("tokens"), F.count_distinct("piece").alias("_d"), F.max("start").alias("_last"))
    docs = docs.agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= CAPACITY)).alias("cut_though_fitting"), F.count_if((F.col("pieces") != F.col("_d")) | (F.col("_last") != (F.col("pieces") - 1) * CAPACITY)).alias("with_gaps"))
    fills = placed.where("container is not null").groupBy("container").agg(F.sum("size").alias("n")).agg(F.count_if(F.col("n") > CAPACITY).alias("overfull_containers"), F.coalesce(F.count("*") * CAPACITY <= 1.01 * F.sum("n") + CAPACITY, F.lit(True)).alias("wastes_under_a_hundredth"))
    return docs.crossJoin(fills)  # one row each


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    counted = tokens.token_counts(table(spark, sf, "documents"), {"doc": F.col("doc_id"), "source": mixing.source_key("source")}, "text", tokens.rank_file(spark))
    targets = table(spark, sf, "source_targets").select(mixing.source_key("source").alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("repeats"))
    return mixing.mix(mixing.counted_sources(counted), targets), targets


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0].withColumnRenamed("doc", "doc_id")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.share_report(*_mix(spark, sf))


def p9_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Per listed source what SQL can tell: no document beyond its repeats, and a share within two blocks of the target."""
    mixed, targets = _mix(spark, sf)
    mixed = materialize(mixed, "mixed")
    report = mixing.share_report(mixed, targets).join(targets.select("source", "repeats"), "source")
    here = F.sum("tokens").over(Window.partitionBy())  # a row per source
    wanted = F.when(F.col("tokens") > 0, F.col("target_share") / F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(Window.partitionBy())).otherwise(0.0)
    return report.select("source", "target_share", (F.col("most_uses") <= F.col("repeats")).alias("within_repeats"), (F.abs(F.col("tokens") - wanted * here) <= 2 * mixing.BLOCK_TOKENS).alias("within_two_blocks"))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf, "documents"), {"doc_id": F.col("doc_id"), "source": mixing.source_key("source")}, "text")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).where(F.col("score") >= toxicity.THRESHOLD).select("doc_id")


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf)


def p10_source_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: documents, how many count, their rate, and how many in each category."""
    counts = {c: F.count_if(F.col(c) >= toxicity.THRESHOLD) for c in ("score", *toxicity.CATEGORIES)}
    return _scores(spark, sf).groupBy("source").agg(F.count("*").alias("documents"), counts["score"].alias("flagged"), (counts["score"] / F.count("*")).alias("rate"), *[counts[c].alias(c) for c in toxicity.CATEGORIES])


def p10_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Per source what SQL can tell: documents scored, and that a score is the greatest of its categories."""
    highest = F.greatest(*toxicity.CATEGORIES)
    return _scores(spark, sf).groupBy("source").agg(F.count("*").alias("documents"), F.count_if((F.col("score") != highest) | (F.col("score") < 0)).alias("inconsistent"))


_PERCENTILES = """
WITH long AS (
  SELECT corpus_id, snapshot_date, column_name, CASE WHEN isnan(v) THEN NULL ELSE v END AS v FROM (
    SELECT corpus_id, snapshot_date, 'complexity' AS column_name, complexity AS v FROM game_snapshots
    UNION ALL SELECT corpus_id, snapshot_date, 'max_play_time_minutes', CAST(max_play_time_minutes AS DOUBLE) FROM game_snapshots
    UNION ALL SELECT corpus_id, snapshot_date, 'rating', rating FROM game_snapshots)),
grouped AS (%s),
ranked AS (SELECT *, row_number() OVER w AS r, count(v) OVER (PARTITION BY KEYS, column_name) AS n FROM grouped WINDOW w AS (PARTITION BY KEYS, column_name ORDER BY v NULLS LAST))
SELECT KEYS, column_name, CAST(percent AS INTEGER) AS percent, max(v) FILTER (r = (percent * n + 99) // 100) AS value, max(n) AS n, count(*) - max(n) AS missing,
  CAST(0 AS BIGINT) AS rank_error
FROM ranked, (SELECT unnest([1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 90, 95, 99]) AS percent) GROUP BY KEYS, column_name, percent
"""

QUERIES = {
    "p3_percentiles": p3_percentiles,
    "p3_unions": p3_unions,
    "p3_bounded": p3_bounded,
    "p5_found": p5_found,
    "p5_cooccurrence": p5_cooccurrence,
    "p6_found": p6_found,
    "p6_classes": p6_classes,
    "p7_found": p7_found,
    "p7_label_frequency": p7_label_frequency,
    "p7_word_runs_whole": p7_word_runs_whole,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p8_audit": p8_audit,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_audit": p9_audit,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_source_rates": p10_source_rates,
    "p10_audit": p10_audit,
}

#: p3: exact percentiles, which the sketches give too (with a rank error of 0) up to 8,191 values a group, as at the size compared.
SQL = {
    "p3_percentiles": (_PERCENTILES % "SELECT * FROM long").replace("KEYS", "corpus_id, snapshot_date"),
    "p3_unions": (
        _PERCENTILES
        % """SELECT 'corpus' AS union_of, corpus_id, CAST(NULL AS DATE) AS snapshot_date, column_name, v FROM long
        UNION ALL SELECT 'date', NULL, snapshot_date, column_name, v FROM long UNION ALL SELECT 'all', NULL, NULL, column_name, v FROM long"""
    ).replace("KEYS", "union_of, corpus_id, snapshot_date"),
    "p3_bounded": """WITH long AS (
      SELECT corpus_id, snapshot_date, 'complexity' AS column_name, complexity AS v FROM game_snapshots
      UNION ALL SELECT corpus_id, snapshot_date, 'max_play_time_minutes', CAST(max_play_time_minutes AS DOUBLE) FROM game_snapshots
      UNION ALL SELECT corpus_id, snapshot_date, 'rating', rating FROM game_snapshots),
    sizes AS (SELECT corpus_id, snapshot_date, column_name, count(*) AS n FROM long WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY ALL)
    SELECT corpus_id, snapshot_date, column_name, CAST(percent AS INTEGER) AS percent, n, n >= 12 AS collapsed, true AS within
    FROM sizes, (SELECT unnest([1, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 90, 95, 99]) AS percent)""",
    "p5_found": _PAIRS + "SELECT item_a, item_b FROM measured WHERE joint * records >= 3 * count_a * count_b",
    "p5_cooccurrence": _PAIRS
    + """SELECT item_a, item_b, joint, count_a, count_b, records,
      floor(CAST(joint AS DOUBLE) * records / (CAST(count_a AS DOUBLE) * count_b) * 1e4 + 0.5) / 1e4 AS lift,
      floor(greatest(0, 2 * (xlogx(joint) + xlogx(count_a - joint) + xlogx(count_b - joint) + xlogx(records - count_a - count_b + joint)
        - xlogx(count_a) - xlogx(records - count_a) - xlogx(count_b) - xlogx(records - count_b) + xlogx(records))) * 1e4 + 0.5) / 1e4 AS llr
    FROM measured""",
    "p6_found": _SIMILAR + "SELECT id_a, id_b FROM similar_pairs",
    "p6_classes": _SIMILAR
    + """, keyed AS (SELECT id, md5(string_agg(item, chr(31) ORDER BY item)) AS set_key FROM labels WHERE id IN (SELECT id FROM sizes) GROUP BY 1),
    ends AS (SELECT id_a AS id FROM similar_pairs UNION ALL SELECT id_b FROM similar_pairs),
    links AS (SELECT id, count(*) AS links FROM ends GROUP BY 1)
    SELECT k.id, min(k.id) OVER (PARTITION BY set_key) AS class_key, count(*) OVER (PARTITION BY set_key) AS class_size, coalesce(links, 0) AS links
    FROM keyed k LEFT JOIN links USING (id)""",
    "p7_found": _LABELS
    + """, counts AS (SELECT kind, name, count(DISTINCT id) AS n FROM written WHERE name IS NOT NULL GROUP BY 1, 2)
    SELECT kind AS item_kind, name AS label_name, CASE WHEN n < 5 THEN 'rare' ELSE 'common' END AS verdict FROM counts, total WHERE n < 5 OR n * 10 > games""",
    "p7_label_frequency": _LABELS
    + """, counts AS (SELECT kind, name, count(*) AS occurrences, count(DISTINCT id) AS n FROM written WHERE name IS NOT NULL GROUP BY 1, 2)
    SELECT kind AS item_kind, name AS label_name, occurrences, n AS games, CASE WHEN n < 5 THEN 'rare' WHEN n * 10 > games THEN 'common' ELSE 'useful' END AS verdict
    FROM counts, total""",
    "p8_audit": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS cut_though_fitting, CAST(0 AS BIGINT) AS with_gaps, CAST(0 AS BIGINT) AS overfull_containers, true AS wastes_under_a_hundredth FROM documents",
    "p9_audit": "SELECT lower(trim(source)) AS source, target_share, true AS within_repeats, true AS within_two_blocks FROM source_targets",
    "p10_audit": r"SELECT lower(regexp_replace(source, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')) AS source, count(*) AS documents, CAST(0 AS BIGINT) AS inconsistent FROM documents GROUP BY 1",
    "p7_word_runs_whole": _LABELS
    + """, split AS (SELECT id, string_split(name, ' ') AS w FROM written WHERE name IS NOT NULL),
    runs AS (
      SELECT id, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM split), (SELECT unnest(range(1, (SELECT max(len(w)) FROM split) + 1)) AS n)
      WHERE i + n - 1 <= len(w))
    SELECT CAST(n AS INTEGER) AS n, words, count(*) AS occurrences, count(DISTINCT id) AS games FROM runs GROUP BY 1, 2""",
}


def _inline_xlogx(sql: str) -> str:
    """xlogx(k) written out: k ln k, 0 at 0."""
    import re

    return re.sub(r"xlogx\(([^()]+)\)", r"(CASE WHEN (\1) > 0 THEN (\1) * ln(CAST((\1) AS DOUBLE)) ELSE 0 END)", sql)


SQL["p5_cooccurrence"] = _inline_xlogx(SQL["p5_cooccurrence"])
