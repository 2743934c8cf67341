"""Structural, sequence, model and geometry operators over the star-schema, event and vector tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structlens.functions import columns as c
from structlens.operators import geometry, linear, relational, sequence
from structlens.sources.tables import table
from structlens.storage import materialize

r6 = c.rounded


def _even(x: Column) -> Column:
    """Six decimals, with exact halves (means of cents over powers of two) pushed up clear of the last bit's noise."""
    return F.floor(x * 1e6 + 0.5001) / 1e6


def _views(spark: SparkSession, sf: str, unit: str) -> DataFrame:
    """What each user met per hour or day: the observer's view (items, how many, how many known)."""
    e = table(spark, sf, "events").withColumn("state", F.date_trunc(unit, "ts").cast("timestamp_ntz"))
    return e.groupBy("state", "user_id").agg(F.array_sort(F.collect_set("event_type")).alias("items"), F.count("*").alias("n"), F.count_if(F.col("event_type") != "error").alias("known"), F.min_by("event_type", F.struct("ts", "event_id")).alias("first_item"))


def _set_classes(views: DataFrame) -> DataFrame:
    """(state, items, m): how many observers of a state have a view of equal items."""
    return views.groupBy("state", "items").agg(F.count("*").alias("m"))


def _class_pairs(spark: SparkSession, sf: str, unit: str) -> DataFrame:
    """Unordered pairs of observers of a state, counted per pair of item sets rather than one by one."""
    sets = _set_classes(_views(spark, sf, unit)).withColumn("key", F.array_join("items", "|"))
    across = relational.unordered_pairs(sets, ["state"], "key", ["items", "m"]).select("state", "items_a", "items_b", (F.col("m_a") * F.col("m_b")).alias("pairs"))
    inside = sets.where(F.col("m") > 1).select("state", F.col("items").alias("items_a"), F.col("items").alias("items_b"), F.expr("m * (m - 1) div 2").alias("pairs"))
    return across.unionByName(inside)


def _asymmetry(pairs: DataFrame) -> DataFrame:
    apart = F.sum(c.jaccard_distance(F.col("items_a"), F.col("items_b")) * F.col("pairs")) / F.sum("pairs")
    return pairs.groupBy("state").agg(F.sum("pairs").alias("pairs"), r6(apart).alias("asymmetry"))


def _directed_counts(pairs: DataFrame) -> DataFrame:
    n, shared = F.col("pairs"), F.size(F.array_intersect("items_a", "items_b"))
    one_sided = F.size("items_a") + F.size("items_b") - 2 * shared  # each ordered pair and its inverse: both sides count once
    differ = F.when(F.size("items_a") != F.size("items_b"), 2 * n).otherwise(0)
    return pairs.groupBy("state").agg((2 * F.sum("pairs")).alias("pairs"), F.sum(one_sided * n).alias("only_a"), F.sum(one_sided * n).alias("only_b"), F.sum(2 * shared * n).alias("shared"), F.sum(differ).alias("asymmetric_pairs"))


def known_set_asymmetry(spark: SparkSession, sf: str) -> DataFrame:
    """Mean Jaccard distance over pairs of observers of a state, an hour."""
    return _asymmetry(_class_pairs(spark, sf, "hour"))


def known_set_asymmetry_daily(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a day as the state, which also compares users who met on a day but in no hour."""
    return _asymmetry(_class_pairs(spark, sf, "day"))


def a_about_b_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Directed set counts over ordered pairs of observers, summed per state, an hour, and how many pairs differ from their inverse."""
    return _directed_counts(_class_pairs(spark, sf, "hour"))


def a_about_b_counts_daily(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a day as the state."""
    return _directed_counts(_class_pairs(spark, sf, "day"))


def info_gain_loss(spark: SparkSession, sf: str) -> DataFrame:
    """What a user's view gained and lost from one active day to the next."""
    before = F.lag("items").over(Window.partitionBy("user_id").orderBy("state"))
    steps = _views(spark, sf, "day").withColumn("before", before).where(F.col("before").isNotNull())
    return steps.select("user_id", "state", F.size(F.array_except("items", "before")).alias("gain"), F.size(F.array_except("before", "items")).alias("loss"))


def information_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Volume, visibility and hidden items of each view."""
    return _views(spark, sf, "day").select("state", "user_id", F.col("n").alias("volume"), r6(F.coalesce(F.try_divide("known", "n"), F.lit(0.0))).alias("visibility"), (F.col("n") - F.col("known")).alias("hidden"))


def hide_reveal_delta(spark: SparkSession, sf: str) -> DataFrame:
    """How visibility moves if a view's first item is hidden or revealed."""
    known = F.when(F.col("first_item") != "error", 1.0).otherwise(0.0)
    return _views(spark, sf, "day").select("state", "user_id", r6(-known / F.col("n")).alias("hide_delta"), r6((1.0 - known) / F.col("n")).alias("reveal_delta"))


def ownership_map(spark: SparkSession, sf: str) -> DataFrame:
    """Per user and item: how often held, and the value written last."""
    e = table(spark, sf, "events")
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


def available_options(spark: SparkSession, sf: str) -> DataFrame:
    """Legal, available, and legal but unavailable options per decision (an order's lines)."""
    legal, available = F.col("l_returnflag") != "R", F.col("l_linestatus") == "O"
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(legal).alias("legal"), F.count_if(legal & available).alias("available"), F.count_if(legal & ~available).alias("constrained"))


def first_match_join(spark: SparkSession, sf: str) -> DataFrame:
    """For every game and language: the first document of the game in that language or without one."""
    d = table(spark, sf, "documents").where(F.col("game_id").isNotNull()).select("game_id", "lang", "doc_id")
    wanted = d.where(F.col("lang").isNotNull()).select("game_id", "lang").distinct()
    return relational.first_match(wanted, d.withColumn("first_doc", F.col("doc_id")), ["game_id"], "lang", "doc_id", ["first_doc"])


def open_map_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """key=...|type=... tokens of an open map, with their number."""
    e = table(spark, sf, "events").select(F.try_parse_json("props").alias("v"))
    members = e.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("_p", "k", "x"))
    each = members.select("k", F.schema_of_variant("x").alias("t"))
    kind = F.when(F.col("t").startswith("OBJECT"), "dict").when(F.col("t").startswith("ARRAY"), "list").when(F.col("t") == "BIGINT", "int").when(F.col("t").rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
    kind = kind.when(F.col("t") == "STRING", "str").when(F.col("t") == "BOOLEAN", "bool").otherwise("NoneType")
    return each.groupBy(F.concat(F.lit("key="), F.col("k"), F.lit("|type="), kind).alias("token")).agg(F.count("*").alias("n"))


def token_hash_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Mean-pooled hash vectors of each user's event types, in long form."""
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    long = e.select("user_id", "n", F.posexplode(c.hash_vector(F.concat(F.lit("type="), F.col("event_type")), 8)).alias("idx", "x"))
    return long.groupBy("user_id", "idx").agg(r6(F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))


def bag_stats_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Pooled hash components 0 to 11 followed by four counts: n, types, largest value type, 0."""
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    pooled = e.select("user_id", "n", F.posexplode(c.hash_vector(F.concat(F.lit("type="), F.col("event_type")), 12)).alias("idx", "x"))
    pooled = pooled.groupBy("user_id", "idx").agg(r6(F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
    stats = e.groupBy("user_id").agg(F.sum("n").cast("double").alias("a"), F.count("*").cast("double").alias("b"), F.max("n").cast("double").alias("c"))
    counts = stats.select("user_id", F.posexplode(F.array("a", "b", "c", F.lit(0.0))).alias("idx", "x")).withColumn("idx", F.col("idx") + 12)
    return pooled.unionByName(counts)


def lineage_hash(spark: SparkSession, sf: str) -> DataFrame:
    """One id for all documents of a game: the id itself, or the digest of the sorted list."""
    d = table(spark, sf, "documents").where(F.col("game_id").isNotNull())
    return d.groupBy("game_id").agg(c.lineage_id(F.collect_set(F.col("doc_id").cast("string"))).alias("lineage_id"))


def trajectory_chain(spark: SparkSession, sf: str) -> DataFrame:
    edges = sequence.consecutive(table(spark, sf, "events"), "user_id", "event_id", ["ts", "event_id"])
    return sequence.successions(edges, "user_id", "edge", "place")


def prefix_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = sequence.running_summary(table(spark, sf, "events").select("user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"], "value")
    return e.select("user_id", "event_id", "first_value", "last_value", _even(F.col("mean_value")).alias("mean_value"), r6(F.col("change")).alias("change"), "n_seen")


def trajectory_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = sequence.whole_summary(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "value")
    return s.select("user_id", "first_value", "last_value", r6(F.col("mean_value")).alias("mean_value"), r6(F.col("change")).alias("change"), "n_seen")


def last_state_mse(spark: SparkSession, sf: str) -> DataFrame:
    """The error of predicting that the next value is the last one, per event type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("event_type", "value", F.lag("value").over(w).alias("before"))
    return e.where(F.col("before").isNotNull()).groupBy("event_type").agg(F.count("*").alias("n"), c.rounded(F.avg((F.col("value") - F.col("before")) ** 2), 4).alias("mse"))


def group_safe_split(spark: SparkSession, sf: str) -> DataFrame:
    g = linear.split_by_hash(table(spark, sf, "games").where(F.col("corpus_id").isNotNull()), "corpus_id", 7, 30)
    return g.groupBy("corpus_id", "side").agg(F.count("*").alias("n"))


def ridge_1d(spark: SparkSession, sf: str) -> DataFrame:
    """Price from quantity, per return flag; the intercept is penalised too."""
    sums = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").cast("double").alias("n"), F.sum("l_quantity").alias("sx"), F.sum(F.col("l_quantity") ** 2).alias("sxx"), F.sum("l_extendedprice").alias("sy"), F.sum(F.col("l_quantity") * F.col("l_extendedprice")).alias("sxy"))
    a, d = F.col("n") + linear.RIDGE, F.col("sxx") + linear.RIDGE
    det = a * d - F.col("sx") * F.col("sx")
    return sums.select("l_returnflag", c.rounded((d * F.col("sy") - F.col("sx") * F.col("sxy")) / det, 3).alias("intercept"), c.rounded((a * F.col("sxy") - F.col("sx") * F.col("sy")) / det, 3).alias("slope"))


def _embedding_columns(n: int, start: int = 0) -> list:
    return [F.get(F.col("embedding"), F.lit(start + i)).cast("double") for i in range(n)]


def ridge_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Components 4 to 7 of each vector from components 0 to 3: weights, in long form."""
    weights = linear.fit_ridge(table(spark, sf, "embeddings"), _embedding_columns(4), _embedding_columns(4, 4))
    rows = [(int(i), int(j), float(weights[i, j])) for i in range(weights.shape[0]) for j in range(weights.shape[1])]
    return spark.createDataFrame(rows, "feature int, target int, weight double")


def probe_rmse_vs_mean(spark: SparkSession, sf: str) -> DataFrame:
    """A one-feature ridge fitted on one side of a split by order against the train mean, on the other side."""
    lines = linear.split_by_hash(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice"), "l_orderkey", 3, 30)
    train = lines.where("side = 'train'")
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    weights = linear.fit_ridge(train, [x], [y])
    mean = train.agg(F.avg(y)).first()[0] or 0.0
    fitted = linear.predict([x], weights)[0]
    test = lines.where("side = 'test'")
    found = linear.errors(test, fitted, y).select("n", c.rounded(F.col("rmse"), 3).alias("rmse"), c.rounded(F.col("mae"), 3).alias("mae"))
    return found.crossJoin(linear.errors(test, F.lit(float(mean)), y).select(c.rounded(F.col("rmse"), 3).alias("mean_rmse")))  # one row each


def linear_rollout(spark: SparkSession, sf: str) -> DataFrame:
    """From a user's first value, three steps of z = 0.5 z + 0.25 x + 1 with the values that follow."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = table(spark, sf, "events").select("user_id", "value", place.alias("pos")).where(F.col("pos") <= 3)
    seen = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("v"))
    rolled = F.aggregate(F.slice("v", 2, 3), F.get("v", F.lit(0)), lambda z, x: z * 0.5 + x * 0.25 + 1.0)
    return seen.select("user_id", (F.size("v") - 1).alias("steps"), r6(rolled).alias("z"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def perspective_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Distances between all views of a state (vectors of a label)."""
    pairs = geometry.group_distances(_vectors(spark, sf), "label", "vec_id", "embedding")
    return pairs.select("label", "vec_id_a", "vec_id_b", r6(F.col("l2")).alias("l2"), r6(F.col("cosine")).alias("cosine"))


def group_region(spark: SparkSession, sf: str) -> DataFrame:
    """Per group: members, mean distance to the centroid, largest pairwise distance, norm of the centroid."""
    v = _vectors(spark, sf)
    centers = geometry.centroids(v, "label", "embedding")
    spread = v.join(centers, "label").groupBy("label").agg(F.max("members").alias("members"), F.avg(c.l2(F.col("embedding"), F.col("centroid"))).alias("dispersion"), F.max(F.sqrt(c.dot(F.col("centroid"), F.col("centroid")))).alias("norm"))
    widest = geometry.widest(v, "label", "vec_id", "embedding")
    return spread.join(widest, "label", "left").select("label", "members", r6(F.when(F.col("members") > 1, F.col("dispersion")).otherwise(0.0)).alias("dispersion"), r6(F.coalesce("widest", F.lit(0.0))).alias("range"), r6(F.col("norm")).alias("centroid_norm"))


def family_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with two feature families, each a present flag and columns padded with 0."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").groupBy("o_custkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    both = base.join(orders, "o_custkey", "left").join(lines, "o_custkey", "left")
    present = lambda x: F.col(x).isNotNull().cast("int")
    filled = lambda x: c.rounded(F.coalesce(F.col(x).cast("double"), F.lit(0.0)), 2)
    return both.select(F.col("o_custkey").alias("c_custkey"), present("orders").alias("order__present"), filled("orders").alias("orders"), filled("total").alias("total"), present("lines").alias("line__present"), filled("lines").alias("lines"), filled("quantity").alias("quantity"))


_SCALED = {"orders": "order__present", "total": "order__present", "lines": "line__present", "quantity": "line__present"}


def standardize_train(spark: SparkSession, sf: str) -> DataFrame:
    """Scaling fitted on the train side, zero-padded rows included; values of absent families stay 0."""
    rows = linear.split_by_hash(family_flatten(spark, sf), "c_custkey", 5, 30)
    fit = rows.where("side = 'train'").agg(*[F.avg(x).alias(f"m_{x}") for x in _SCALED], *[F.stddev_pop(x).alias(f"s_{x}") for x in _SCALED])
    scaled = lambda x: (F.col(x) - F.col(f"m_{x}")) / F.when(F.col(f"s_{x}") > 0, F.col(f"s_{x}")).otherwise(1.0)
    return rows.crossJoin(F.broadcast(fit)).select("c_custkey", "side", *[r6(F.when(F.col(p) == 1, scaled(x)).otherwise(0.0)).alias(x) for x, p in _SCALED.items()])  # fit is one row


def variance_projection(spark: SparkSession, sf: str) -> DataFrame:
    """The five components of largest variance."""
    return geometry.leading_components(geometry.moments(_vectors(spark, sf), "embedding"), 5).select("idx", r6(F.col("variance")).alias("variance"))


def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    return geometry.nearest(v, v, "vec_id", "embedding", 3).select("vec_id", "other", r6(F.col("distance")).alias("distance"), "rank")


def _asked(v: DataFrame) -> DataFrame:
    """The stated queries: every vector whose id is divisible by 50."""
    return v.where(F.col("vec_id") % 50 == 0)


def knn_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The neighbours of every 50th vector among all, through the cell index."""
    v = _vectors(spark, sf)
    index = geometry.CellIndex(v, "vec_id", "embedding")
    found = index.search(_asked(v), 10, index.probes_for(10))
    return found.select("vec_id", "other", r6(F.col("distance")).alias("distance"), "rank")


def knn_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The index held against the exact search: queries, and whether nine in ten true neighbours are found."""
    v = _vectors(spark, sf)
    index = geometry.CellIndex(v, "vec_id", "embedding")
    found = index.search(_asked(v), 10, index.probes_for(10))
    return geometry.recall(found, geometry.nearest(_asked(v), v, "vec_id", "embedding", 10), "vec_id").select("queries", (F.col("recall") >= 0.9).alias("nine_in_ten"))


def kmeans_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors, and those nearer to the mean of another cluster than to their own's by more than rounding."""
    found = materialize(geometry.kmeans(_vectors(spark, sf), "vec_id", "embedding", 5).select("vec_id", "embedding", "cluster"), "kmeans-found")
    means = [list(r["centroid"]) for r in geometry.centroids(found, "cluster", "embedding").orderBy("cluster").collect()]  # five rows
    near = geometry.assign(found, "vec_id", "embedding", means).withColumnRenamed("distance", "_least").drop("cluster", "embedding")
    own = F.get(F.array(*[F.array(*[F.lit(x) for x in m]) for m in means]), F.col("cluster"))
    both = found.join(near, "vec_id")
    return both.agg(F.count("*").alias("vectors"), F.count_if(c.l2(F.col("embedding"), own) > F.col("_least") + 1e-9).alias("misplaced"))


def ridge_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The normal equations at the fitted weights: whether every one of them holds to a millionth of a row."""
    v = table(spark, sf, "embeddings")
    x, y = _embedding_columns(4), _embedding_columns(4, 4)
    a, b = linear.gram(v, x, y)
    weights = linear.fit_ridge(v, x, y)
    off = abs((a + linear.RIDGE * np.eye(len(a))) @ weights - b).max()
    return v.agg(F.count("*").alias("rows"), (F.lit(float(off)) <= 1e-6 * F.count("*")).alias("equations_hold"))


def novelty_train_knn(spark: SparkSession, sf: str) -> DataFrame:
    v = linear.split_by_hash(_vectors(spark, sf), "vec_id", 11, 30)
    found = geometry.novelty(v, v.where("side = 'train'"), "vec_id", "embedding", [1, 3])
    return found.select("vec_id", "k", r6(F.col("novelty")).alias("novelty"))


def between_group_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    """Mean distance of group centroids to the centroid of all vectors."""
    v = _vectors(spark, sf)
    groups = geometry.centroids(v, "label", "embedding")
    whole = geometry.centroids(v.withColumn("all", F.lit(1)), "all", "embedding").select(F.col("centroid").alias("center"))
    return groups.crossJoin(F.broadcast(whole)).agg(F.count("*").alias("groups"), r6(F.avg(c.l2(F.col("centroid"), F.col("center")))).alias("dispersion"))  # whole is one row


def kmeans_assign_step(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector's cluster at the fixed start."""
    v = _vectors(spark, sf)
    found = geometry.assign(v, "vec_id", "embedding", geometry.starting_centers(v, "vec_id", "embedding", 5))
    return found.select("vec_id", "cluster", r6(F.col("distance")).alias("distance"))


def kmeans_full(spark: SparkSession, sf: str) -> DataFrame:
    return geometry.kmeans(_vectors(spark, sf), "vec_id", "embedding", 5).select("vec_id", "cluster", r6(F.col("distance")).alias("distance"))


QUERIES = {
    f.__name__: f
    for f in (
        known_set_asymmetry, known_set_asymmetry_daily, a_about_b_counts, a_about_b_counts_daily, info_gain_loss, information_measures, hide_reveal_delta, ownership_map, available_options, first_match_join, open_map_tokens, token_hash_vectors,
        bag_stats_concat, lineage_hash, trajectory_chain, prefix_summary, trajectory_summary, last_state_mse, group_safe_split, ridge_1d, ridge_multi, probe_rmse_vs_mean, linear_rollout,
        perspective_distances, group_region, family_flatten, standardize_train, variance_projection, knn_topk, knn_indexed, knn_index_recall, novelty_train_knn, between_group_dispersion, kmeans_assign_step, kmeans_full, kmeans_audit, ridge_audit,
    )
}

_R6 = "floor(({}) * 1e6 + 0.5) / 1e6"


def _round(x: str, places: int = 6) -> str:
    return f"floor(({x}) * 1e{places} + 0.5) / 1e{places}"


def _view_sql(unit: str) -> str:
    return f"""WITH seen AS (SELECT date_trunc('{unit}', ts) AS state, user_id, list_sort(list_distinct(list(event_type))) AS items, count(*) AS n, count(*) FILTER (event_type <> 'error') AS known,
      arg_min(event_type, (ts, event_id)) AS first_item FROM events GROUP BY 1, 2)"""


def _hash_sql(dim: int) -> str:
    return f"""WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
      pooled AS (SELECT user_id, CAST(i AS INTEGER) AS idx, {_round("sum((('0x' || substr(sha256('type=' || event_type), CAST(2 * i + 1 AS BIGINT), 2))::INTEGER / 127.5 - 1) * n) / sum(n)")} AS x
        FROM e, (SELECT unnest(range(0, {dim})) AS i) GROUP BY 1, 2)"""


def _side_sql(column: str, seed: int, percent: int) -> str:
    return f"CASE WHEN ('0x' || substr(sha256('{seed}|' || CAST({column} AS VARCHAR)), 1, 8))::BIGINT % 100 < {percent} THEN 'test' ELSE 'train' END"


_FAMILY = f"""flat AS (SELECT c_custkey, (o.n IS NOT NULL)::INTEGER AS order__present, {_round("coalesce(o.n, 0)::DOUBLE", 2)} AS orders, {_round("coalesce(total, 0)", 2)} AS total,
    (l.n IS NOT NULL)::INTEGER AS line__present, {_round("coalesce(l.n, 0)::DOUBLE", 2)} AS lines, {_round("coalesce(quantity, 0)", 2)} AS quantity
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) l ON l.o_custkey = c_custkey)"""

_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_PAIR_V = "FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id"
_CENTER = "m AS (SELECT label, i, avg(e[i]) AS x FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), center AS (SELECT label, list(x ORDER BY i) AS ce FROM m GROUP BY 1)"

SQL = {
    "known_set_asymmetry": _view_sql("hour")
    + f""" SELECT a.state, count(*) AS pairs, {_round("avg(1 - len(list_intersect(a.items, b.items)) / len(list_distinct(list_concat(a.items, b.items)))::DOUBLE)")} AS asymmetry
      FROM seen a JOIN seen b ON a.state = b.state AND a.user_id < b.user_id GROUP BY 1""",
    "a_about_b_counts": _view_sql("hour")
    + """, p AS (SELECT a.state, len(a.items) AS la, len(b.items) AS lb, len(list_intersect(a.items, b.items)) AS both_ FROM seen a JOIN seen b ON a.state = b.state AND a.user_id <> b.user_id)
      SELECT state, count(*) AS pairs, CAST(sum(la - both_) AS BIGINT) AS only_a, CAST(sum(lb - both_) AS BIGINT) AS only_b, CAST(sum(both_) AS BIGINT) AS shared, count(*) FILTER (la <> lb) AS asymmetric_pairs FROM p GROUP BY 1""",
    "info_gain_loss": _view_sql("day")
    + """, s AS (SELECT *, lag(items) OVER (PARTITION BY user_id ORDER BY state) AS before FROM seen)
      SELECT user_id, state, CAST(len(items) - len(list_intersect(items, before)) AS INTEGER) AS gain, CAST(len(before) - len(list_intersect(items, before)) AS INTEGER) AS loss FROM s WHERE before IS NOT NULL""",
    "information_measures": _view_sql("day") + f" SELECT state, user_id, n AS volume, {_round('known / n')} AS visibility, n - known AS hidden FROM seen",
    "hide_reveal_delta": _view_sql("day")
    + f""" SELECT state, user_id, {_round("-(first_item <> 'error')::INTEGER::DOUBLE / n")} AS hide_delta, {_round("(1 - (first_item <> 'error')::INTEGER)::DOUBLE / n")} AS reveal_delta FROM seen""",
    "ownership_map": "SELECT user_id, event_type, count(*) AS n, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1, 2",
    "available_options": """SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS legal, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS available,
      count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'O') AS constrained FROM lineitem GROUP BY 1""",
    "first_match_join": """SELECT w.game_id, w.lang, min(d.doc_id) AS first_doc FROM (SELECT DISTINCT game_id, lang FROM documents WHERE game_id IS NOT NULL AND lang IS NOT NULL) w
      LEFT JOIN documents d ON d.game_id = w.game_id AND (d.lang IS NULL OR d.lang = w.lang) GROUP BY 1, 2""",
    "open_map_tokens": """SELECT 'key=' || k || '|type=' || CASE json_type(props, '$.' || k) WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float'
      WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' ELSE 'NoneType' END AS token, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY 1""",
    "token_hash_vectors": _hash_sql(8) + " SELECT * FROM pooled",
    "bag_stats_concat": _hash_sql(12)
    + """, s AS (SELECT user_id, sum(n)::DOUBLE AS a, count(*)::DOUBLE AS b, max(n)::DOUBLE AS c FROM e GROUP BY 1)
      SELECT * FROM pooled UNION ALL SELECT user_id, 12, a FROM s UNION ALL SELECT user_id, 13, b FROM s UNION ALL SELECT user_id, 14, c FROM s UNION ALL SELECT user_id, 15, 0 FROM s""",
    "lineage_hash": """WITH g AS (SELECT game_id, list_sort(list_distinct(list(CAST(doc_id AS VARCHAR)))) AS ids FROM documents WHERE game_id IS NOT NULL GROUP BY 1)
      SELECT game_id, CASE WHEN len(ids) = 1 THEN ids[1] ELSE sha256('["' || array_to_string(ids, '","') || '"]') END AS lineage_id FROM g""",
    "trajectory_chain": """WITH e AS (SELECT user_id, event_id, row_number() OVER w AS r, lead(event_id) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      SELECT user_id, event_id AS edge, CAST(0 AS INTEGER) AS chain, CAST(r - 1 AS INTEGER) AS pos, CAST(NULL AS VARCHAR) AS skipped FROM e WHERE following IS NOT NULL""",
    "prefix_summary": f"""SELECT user_id, event_id, first(value) OVER w AS first_value, value AS last_value, floor(avg(value) OVER w * 1e6 + 0.5001) / 1e6 AS mean_value, {_round("value - first(value) OVER w")} AS change,
      count(*) OVER w AS n_seen FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "trajectory_summary": f"""SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value, {_round("avg(value)")} AS mean_value,
      {_round("arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))")} AS change, count(*) AS n_seen FROM events GROUP BY 1""",
    "last_state_mse": f"""SELECT event_type, count(*) AS n, {_round("avg((value - before) * (value - before))", 4)} AS mse
      FROM (SELECT event_type, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL GROUP BY 1""",
    "group_safe_split": f"SELECT corpus_id, {_side_sql('corpus_id', 7, 30)} AS side, count(*) AS n FROM games WHERE corpus_id IS NOT NULL GROUP BY 1, 2",
    "ridge_1d": f"""WITH s AS (SELECT l_returnflag, count(*)::DOUBLE + 1e-4 AS a, sum(l_quantity) AS sx, sum(l_quantity * l_quantity) + 1e-4 AS d, sum(l_extendedprice) AS sy, sum(l_quantity * l_extendedprice) AS sxy FROM lineitem GROUP BY 1)
      SELECT l_returnflag, {_round("(d * sy - sx * sxy) / (a * d - sx * sx)", 3)} AS intercept, {_round("(a * sxy - sx * sy) / (a * d - sx * sx)", 3)} AS slope FROM s""",
    "probe_rmse_vs_mean": f"""WITH l AS (SELECT l_quantity AS x, l_extendedprice AS y, {_side_sql("l_orderkey", 3, 30)} AS side FROM lineitem),
      s AS (SELECT count(*)::DOUBLE + 1e-4 AS a, sum(x) AS sx, sum(x * x) + 1e-4 AS d, sum(y) AS sy, sum(x * y) AS sxy, avg(y) AS mean FROM l WHERE side = 'train'),
      w AS (SELECT (d * sy - sx * sxy) / (a * d - sx * sx) AS b0, (a * sxy - sx * sy) / (a * d - sx * sx) AS b1, mean FROM s)
      SELECT count(*) AS n, {_round("sqrt(avg((b0 + b1 * x - y) * (b0 + b1 * x - y)))", 3)} AS rmse, {_round("avg(abs(b0 + b1 * x - y))", 3)} AS mae, {_round("sqrt(avg((mean - y) * (mean - y)))", 3)} AS mean_rmse FROM l, w WHERE side = 'test'""",
    "linear_rollout": f"""WITH s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1)
      SELECT user_id, CAST(least(len(v) - 1, 3) AS INTEGER) AS steps, {_round("list_reduce(v[1:4], lambda z, x: z * 0.5 + x * 0.25 + 1.0)")} AS z FROM s""",
    "perspective_distances": f"""WITH {_V} SELECT a.label, a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, {_round("list_distance(a.e, b.e)")} AS l2, {_round("1 - list_cosine_similarity(a.e, b.e)")} AS cosine {_PAIR_V}""",
    "group_region": f"""WITH {_V}, {_CENTER}, far AS (SELECT a.label, max(list_distance(a.e, b.e)) AS widest {_PAIR_V} GROUP BY 1)
      SELECT v.label, count(*) AS members, {_round("CASE WHEN count(*) > 1 THEN avg(list_distance(e, ce)) ELSE 0 END")} AS dispersion, {_round("coalesce(any_value(widest), 0)")} AS range,
        {_round("sqrt(any_value(list_inner_product(ce, ce)))")} AS centroid_norm FROM v JOIN center c ON c.label = v.label LEFT JOIN far f ON f.label = v.label GROUP BY 1""",
    "family_flatten": f"WITH {_FAMILY} SELECT * FROM flat",
    "standardize_train": f"""WITH {_FAMILY}, sided AS (SELECT *, {_side_sql("c_custkey", 5, 30)} AS side FROM flat),
      fit AS (SELECT {", ".join(f"avg({x}) AS m_{x}, stddev_pop({x}) AS s_{x}" for x in _SCALED)} FROM sided WHERE side = 'train')
      SELECT c_custkey, side, {", ".join(f"{_round(f'CASE WHEN {p} = 1 THEN ({x} - m_{x}) / CASE WHEN s_{x} > 0 THEN s_{x} ELSE 1 END ELSE 0 END')} AS {x}" for x, p in _SCALED.items())} FROM sided, fit""",
    "variance_projection": f"""WITH {_V} SELECT CAST(i - 1 AS INTEGER) AS idx, {_round("var_pop(e[i])")} AS variance FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY i ORDER BY var_pop(e[i]) DESC, i LIMIT 5""",
    "knn_topk": f"""WITH {_V}, d AS (SELECT a.vec_id, b.vec_id AS other, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id)
      SELECT vec_id, other, {_round("distance")} AS distance, CAST(r AS INTEGER) AS rank
      FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, other) AS r FROM d) WHERE r <= 3""",
    "novelty_train_knn": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, {_side_sql("vec_id", 11, 30)} AS side FROM embeddings),
      d AS (SELECT a.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS r, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id AND b.side = 'train')
      SELECT vec_id, CAST(k AS INTEGER) AS k, {_round("avg(distance)")} AS novelty FROM d, (SELECT unnest([1, 3]) AS k) WHERE r <= k GROUP BY 1, 2""",
    "between_group_dispersion": f"""WITH {_V}, {_CENTER}, w AS (SELECT list(x ORDER BY i) AS we FROM (SELECT i, avg(e[i]) AS x FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1))
      SELECT count(*) AS groups, {_round("avg(list_distance(ce, we))")} AS dispersion FROM center, w""",
    "kmeans_assign_step": f"""WITH {_V}, placed AS (SELECT e, row_number() OVER (ORDER BY vec_id) - 1 AS p, count(*) OVER () AS n FROM v),
      start AS (SELECT e AS ce, p // greatest(1, n // 5) AS cluster FROM placed WHERE p % greatest(1, n // 5) = 0 AND p // greatest(1, n // 5) < 5)
      SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, {_round("list_distance(e, ce)")} AS distance FROM v, start
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(e, ce), cluster) = 1""",
}
SQL |= {
    "knn_index_recall": "SELECT count(*) AS queries, true AS nine_in_ten FROM embeddings WHERE vec_id % 50 = 0",
    "kmeans_audit": "SELECT count(*) AS vectors, CAST(0 AS BIGINT) AS misplaced FROM embeddings",
    "ridge_audit": "SELECT count(*) AS rows, true AS equations_hold FROM embeddings",
}
SQL |= {f"{name}_daily": _view_sql("day") + SQL[name].removeprefix(_view_sql("hour")) for name in ("known_set_asymmetry", "a_about_b_counts")}
