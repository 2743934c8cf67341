"""Play situations as a star of child tables: views, 13 structural measures, bag encoders, perspectives, interventions.

Tables (keys first): situations(situation_id, game_id, interaction,
decision_timing, legal_action_types), states(situation_id, ord, state_id,
turn_number, active_player_id, phase, data JSON), observations(situation_id,
ord, observation_id, state_id, observer_id, information_space_id),
info_items(situation_id, information_space_id, ord, item_id, visibility, about,
known_to, payload JSON, content_known, holder_id), decision_spaces(situation_id,
ord, space_id, player_id, state_id, complete), decision_options(situation_id,
space_id, ord, legal, available), actions(situation_id, ord, action_id,
player_id, action_type, parameters JSON), transitions(situation_id, ord,
transition_id, from_state_id, to_state_id, action_ids), interpretations(
situation_id, label). `ord` is the place in the authored list: every "first" and
"last" is taken by it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structlens.functions import columns as c
from structlens.operators import relational
from structlens.session import shuffle_width

#: Parts of an action type's name that tell it is aimed at somebody (fixed values).
TARGETING = ("clue", "communicate", "give", "guess", "treat", "block")
DIM = 16


@dataclass(frozen=True)
class Situations:
    situations: DataFrame
    states: DataFrame
    observations: DataFrame
    info_items: DataFrame
    decision_spaces: DataFrame
    decision_options: DataFrame
    actions: DataFrame
    transitions: DataFrame
    interpretations: DataFrame


def first_spaces(s: Situations) -> DataFrame:
    """(situation_id, state_id, observer_id, information_space_id, copies, placed): the space of an observer's first observation at a state; see seen."""
    key = ["situation_id", "state_id", "observer_id"]
    first = s.observations.groupBy(*key).agg(F.min_by(F.struct("information_space_id"), F.struct("ord")).alias("_first"), F.count("*").alias("copies"), F.count("ord").alias("placed"))
    return first.select(*key, F.col("_first.information_space_id").alias("information_space_id"), "copies", "placed")


def seen(s: Situations) -> DataFrame:
    """(situation_id, state_id, observer_id, items, copies, placed): one row for all observations of an observer at a state.

    Items are those of the space of the first observation, whatever space the
    others name. copies counts the observations, placed those with an `ord`.
    """
    key = ["situation_id", "state_id", "observer_id"]
    entry = F.struct("ord", "item_id", "visibility", "about", F.coalesce(F.size("known_to"), F.lit(0)).alias("known_to_n"), "content_known", "holder_id", F.array_sort(F.coalesce(F.json_object_keys("payload"), F.array())).alias("payload_keys"))
    items = s.info_items.groupBy("situation_id", "information_space_id").agg(F.array_sort(F.collect_list(entry)).alias("items"))
    return first_spaces(s).join(items, ["situation_id", "information_space_id"], "left").select(*key, F.coalesce("items", F.array()).alias("items"), "copies", "placed")


def views(s: Situations) -> DataFrame:
    """Every observation with its items in order (see seen)."""
    key = ["situation_id", "state_id", "observer_id"]
    return s.observations.select("situation_id", "ord", "observation_id", "state_id", "observer_id").join(seen(s).select(*key, "items"), key)


def known(items: Column) -> Column:
    return F.filter(items, lambda i: i["content_known"])


def known_keys(items: Column) -> Column:
    """Distinct (about, holder) of the known items."""
    return F.array_distinct(F.transform(known(items), lambda i: F.struct(i["about"].alias("about"), i["holder_id"].alias("holder"))))


def known_ids(items: Column) -> Column:
    return F.array_distinct(F.transform(known(items), lambda i: i["item_id"]))


def visibility(items: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(known(items)), F.size(items)), F.lit(0.0))


def options(s: Situations) -> DataFrame:
    """Decision spaces with the number of available and of constrained options."""
    counted = s.decision_options.groupBy("situation_id", "space_id").agg(F.count_if(F.col("legal") & F.col("available")).alias("available"), F.count_if(F.col("legal") & ~F.col("available")).alias("constrained"), F.count("*").alias("options"))
    return s.decision_spaces.join(counted, ["situation_id", "space_id"], "left").fillna(0, ["available", "constrained", "options"])


def gain_loss(s: Situations, v: DataFrame | None = None) -> DataFrame:
    """(situation_id, transition_id, observer_id, gain, loss) where both states are observed."""
    held = (seen(s) if v is None else v).select("situation_id", "state_id", "observer_id", known_keys(F.col("items")).alias("k"))
    held = held if v is None else held.dropDuplicates(["situation_id", "state_id", "observer_id"])
    before = held.withColumnsRenamed({"state_id": "from_state_id", "k": "b"})
    after = held.withColumnsRenamed({"state_id": "to_state_id", "k": "a"})
    steps = s.transitions.select("situation_id", "transition_id", "from_state_id", "to_state_id").join(before, ["situation_id", "from_state_id"]).join(after, ["situation_id", "to_state_id", "observer_id"])
    return steps.select("situation_id", "transition_id", "observer_id", F.size(F.array_except("a", "b")).alias("gain"), F.size(F.array_except("b", "a")).alias("loss"))


def measures(s: Situations, skip_incomplete: bool = True, v: DataFrame | None = None) -> DataFrame:
    """(situation_id, metric, state_id, observer_id, scope_key, value, value_json): 13 metrics in long form. v: views(s), where they are written already."""
    ready, v = v, views(s) if v is None else v
    items = F.col("items")
    none = F.lit(None).cast("string")

    def long(df: DataFrame, metric: str, state: Column, observer: Column, key: Column, value: Column | None = None, text: Column | None = None) -> DataFrame:
        return df.select("situation_id", F.lit(metric).alias("metric"), state.alias("state_id"), observer.alias("observer_id"), key.alias("scope_key"), (F.lit(None) if value is None else value).cast("double").alias("value"), (none if text is None else text).alias("value_json"))

    state, observer = F.col("state_id"), F.col("observer_id")
    own_unknown = F.size(F.filter(items, lambda i: (i["holder_id"] == observer) & ((i["visibility"] == "unknown_to_self") | ~i["content_known"])))
    other_known = F.size(F.filter(items, lambda i: i["holder_id"].isNotNull() & (i["holder_id"] != observer) & (i["visibility"] == "other_private") & i["content_known"]))
    per_view = [
        ("information_volume", F.size(items)),
        ("information_visibility", visibility(items)),
        ("hidden_information", F.size(items) - F.size(known(items))),
        ("self_knowledge_asymmetry", F.when((own_unknown > 0) & (other_known > 0), own_unknown + other_known).otherwise(0)),
    ]
    each = v.select("situation_id", "state_id", "observer_id", "observation_id", F.inline(F.array(*[F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in per_view])))
    out = [each.select("situation_id", "metric", "state_id", "observer_id", F.col("observation_id").alias("scope_key"), "value", none.alias("value_json"))]

    asymmetry = set_distances(v.where(F.col("ord").isNotNull()).select("situation_id", "state_id", known_keys(items).alias("k"), F.lit(1).alias("n")), ["situation_id", "state_id"], "k", "n").withColumn("x", F.col("distance") / F.col("pairs"))
    out.append(long(asymmetry, "information_asymmetry", state, none, state, F.col("x")))

    each = v.select("situation_id", "state_id", "ord", F.explode(items).alias("i"))
    holders = each.groupBy("situation_id", "state_id", F.coalesce("i.holder_id", F.lit("")).alias("holder")).agg(F.count("*").alias("n"))
    holders = holders.groupBy("situation_id", "state_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("holder", "n")))).alias("by_holder"))
    sizes = each.groupBy("situation_id", "state_id", F.coalesce("i.about", "i.item_id").alias("about")).agg(F.max_by("i.known_to_n", F.struct("ord", "i.ord")).alias("n"))
    sizes = sizes.groupBy("situation_id", "state_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("about", "n")))).alias("known_to_sizes"))
    owned = s.states.select("situation_id", "state_id").join(holders, ["situation_id", "state_id"], "left").join(sizes, ["situation_id", "state_id"], "left")
    empty = F.create_map().cast("map<string,bigint>")
    body = F.to_json(F.struct(F.coalesce("by_holder", empty).alias("by_holder"), F.coalesce(F.size("by_holder"), F.lit(0)).alias("n_holders"), F.coalesce(F.col("known_to_sizes").cast("map<string,bigint>"), empty).alias("known_to_sizes")))
    out.append(long(owned, "information_ownership", state, none, state, text=body))

    moved = gain_loss(s, ready)
    out += [long(moved, f"information_{x}", none, observer, F.col("transition_id"), F.col(x)) for x in ("gain", "loss")]

    game = F.col("situation_id")
    out.append(long(s.situations, "legal_action_type_count", none, none, game, F.size("legal_action_types")))
    spaces = options(s)
    complete = spaces.where("complete") if skip_incomplete else spaces
    out.append(long(complete, "available_decision_count", state, F.col("player_id"), F.col("space_id"), F.col("available")))
    out.append(long(spaces, "decision_constraint", state, F.col("player_id"), F.col("space_id"), F.col("constrained")))
    active = s.states.where(F.col("active_player_id").isNotNull()).select("situation_id", F.col("active_player_id").alias("player_id"), "state_id")
    branching = relational.first_match(active, spaces, ["situation_id", "player_id"], "state_id", "ord", ["available", "complete"]).where(F.col("available").isNotNull())
    branching = branching.where("complete") if skip_incomplete else branching
    out.append(long(branching, "decision_branching_factor", state, F.col("player_id"), state, F.col("available")))
    labels = s.interpretations.groupBy("situation_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    aimed = F.filter("legal_action_types", lambda t: t.rlike("|".join(TARGETING)))
    text = F.to_json(F.struct("interaction", "decision_timing", aimed.alias("targeting_action_types"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels")))
    out.append(long(s.situations.join(labels, "situation_id", "left"), "structural_interaction", none, none, game, text=text))

    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def set_distances(df: DataFrame, within: Sequence[str], items: str, n: str) -> DataFrame:
    """(within, pairs, distance): number and summed Jaccard distance of the unordered pairs of sets, n rows to each; no row without a pair.

    Equal sets count once with their number, and of different ones only those
    that share an item are compared: all others are 1 apart. The work grows with
    the different sets of a group that hold the same item, not with its pairs.
    """
    within = list(within)
    classes = df.groupBy(*within, F.array_sort(items).alias("_s")).agg(F.sum(n).alias("_n")).where(F.col("_n") > 0)
    whole = classes.groupBy(*within).agg(F.sum("_n").alias("_n"), F.sum(F.expr("_n * (_n - 1) div 2")).alias("_equal"))
    shared = classes.select(*within, F.explode("_s").alias("_i"), F.struct(F.col("_s").alias("s"), F.col("_n").alias("n")).alias("_c")).groupBy(*within, "_i").agg(F.collect_list("_c").alias("_all")).where(F.size("_all") > 1)
    pairs = shared.select(*within, F.explode("_all").alias("_a"), "_all").select(*within, "_a", F.explode("_all").alias("_b")).where(F.col("_a.s") < F.col("_b.s"))
    pairs = pairs.groupBy(*within, "_a", "_b").agg(F.count("*").alias("_both"))
    alike = pairs.groupBy(*within).agg(F.sum(F.col("_a.n") * F.col("_b.n") * (F.col("_both") / (F.size("_a.s") + F.size("_b.s") - F.col("_both")))).alias("_alike"))
    same = [F.col(f"w.{x}").eqNullSafe(F.col(f"a.{x}")) for x in within]
    both = whole.alias("w").join(alike.alias("a"), same, "left").select(*[f"w.{x}" for x in within], F.expr("_n * (_n - 1) div 2").alias("pairs"), "_equal", F.coalesce("_alike", F.lit(0.0)).alias("_alike"))
    return both.where(F.col("pairs") > 0).select(*within, "pairs", (F.col("pairs") - F.col("_equal") - F.col("_alike")).alias("distance"))


def cosine_sums(df: DataFrame, within: Sequence[str], vector: str, n: str, dim: int = DIM) -> DataFrame:
    """(within, rows, distance): rows, n to each vector, and the summed cosine distance of their unordered pairs, 0 beside a zero vector.

    The cosines of all pairs add up to half of what the squared length of the
    summed unit vectors has over the summed squares, so no pair is formed.
    """
    add = lambda term: " + ".join(term.format(i=i) for i in range(dim))
    z = df.select(*within, F.col(n).alias("_n"), F.col(vector).alias("_z")).withColumn("_d", F.expr(f"nullif({add('get(_z, {i}) * get(_z, {i})')}, 0D)"))
    unit = z.selectExpr(*within, "_n", *[f"get(_z, {i}) / sqrt(_d) AS _u{i}" for i in range(dim)])
    squares, sums = add("_u{i} * _u{i}"), [F.expr(f"sum(_n * _u{i})").alias(f"_u{i}") for i in range(dim)]
    totals = unit.groupBy(*within).agg(F.sum("_n").alias("rows"), F.expr("coalesce(sum(CASE WHEN _u0 IS NOT NULL THEN _n END), 0)").alias("_m"), F.expr(f"sum(_n * ({squares}))").alias("_q"), *sums)
    return totals.select(*within, "rows", F.expr(f"coalesce((_m * (_m - 1) - (({squares}) - _q)) / 2, 0D)").alias("distance"))


def bag_vector(tokens: Column, stats: Sequence[Column], dim: int = DIM) -> Column:
    """Mean of the tokens' hash vectors, zero without tokens; the last components give way to the stats if there is room."""
    zero = F.array_repeat(F.lit(0.0), dim)
    total = lambda ts: F.aggregate(F.transform(ts, lambda t: c.hash_vector(t, dim)), zero, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    pooled = c.bound(tokens, lambda ts: F.transform(total(ts), lambda x: x / F.greatest(F.size(ts), F.lit(1))))
    return pooled if dim <= len(stats) else F.concat(F.slice(pooled, 1, dim - len(stats)), F.array(*[x.cast("double") for x in stats]))


def _typed_keys(df: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """(keys, pairs): the sorted (key, type name) of a JSON object's members."""
    parsed = df.select(*keys, F.try_parse_json(body).alias("_v"))
    members = parsed.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()).toDF("_p", "_k", "_x"))
    t = F.schema_of_variant("_x")
    kind = F.when(t.startswith("OBJECT"), "dict").when(t.startswith("ARRAY"), "list").when(t == "BIGINT", "int").when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float").when(t == "STRING", "str").when(t == "BOOLEAN", "bool").otherwise("NoneType")
    return members.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct(F.col("_k").alias("key"), kind.alias("type"))))).alias("pairs"))


def shown(x: Column) -> Column:
    """As text, null as None."""
    return F.coalesce(x.cast("string"), F.lit("None"))


def state_vectors(s: Situations, dim: int = DIM) -> DataFrame:
    key = ["situation_id", "state_id"]
    both = s.states.join(_typed_keys(s.states, key, "data"), key)
    on = lambda x: (F.coalesce(F.col(x), F.lit("")) != "").cast("int")
    head = F.array(F.concat(F.lit("phase="), shown(F.col("phase"))), F.concat(F.lit("turn="), shown(F.col("turn_number"))), F.concat(F.lit("active="), on("active_player_id").cast("string")))
    tokens = F.concat(head, F.transform("pairs", lambda p: F.concat(F.lit("key="), p["key"], F.lit("|type="), p["type"])))
    return both.select(*key, bag_vector(tokens, [F.size("pairs"), F.coalesce("turn_number", F.lit(0)), on("phase"), on("active_player_id")], dim).alias("z"))


def item_token(visibility: Column, content_known: Column, about: Column, holder_id: Column, payload_keys: Column) -> Column:
    return F.concat(F.lit("vis="), shown(visibility), F.lit("|known="), content_known.cast("int").cast("string"), F.lit("|about="), shown(about), F.lit("|holder="), shown(holder_id), F.lit("|keys="), F.array_join(payload_keys, ","))


def view_vector(items: Column, dim: int = DIM) -> Column:
    tokens = F.transform(items, lambda i: item_token(i["visibility"], i["content_known"], i["about"], i["holder_id"], i["payload_keys"]))
    n, k = F.size(items), F.size(known(items))
    return bag_vector(tokens, [n, k, n - k, F.size(F.filter(items, lambda i: i["visibility"] == "unknown_to_self"))], dim)


def view_vectors(s: Situations, dim: int = DIM) -> DataFrame:
    return views(s).select("situation_id", "ord", "observation_id", "state_id", "observer_id", "items", view_vector(F.col("items"), dim).alias("z"))


def _items_and_views(s: Situations, key: Sequence[str], member: Column | None) -> DataFrame:
    """Items (kind 0) that name a key, with their token, and observations (kind 1), with columns of their own."""
    col, kept = F.col, F.lit(True)
    payload_keys = F.sort_array(F.coalesce(F.json_object_keys("payload"), F.array()))
    token = item_token(col("visibility"), col("content_known"), col("about"), col("holder_id"), payload_keys)
    for x in key:
        kept = kept & col(x).isNotNull()  # null meets no view
    given = [] if member is None else [member.alias("member")]
    items = s.info_items.where(kept).select(*key, F.lit(0).alias("kind"), "ord", "item_id", token.alias("token"), F.coalesce("content_known", F.lit(False)).alias("known"), F.coalesce(col("visibility") == "unknown_to_self", F.lit(False)).alias("blind"), *given)
    views = s.observations.select(*dict.fromkeys([*key, "state_id"]), F.lit(1).alias("kind"), "observer_id", col("ord").alias("place"))
    return items.unionByName(views, allowMissingColumns=True)


def _observed(s: Situations, dim: int, member: Column | None = None, tasks: int | None = None, every: bool = False) -> DataFrame:
    """(situation_id, state_id, observer_id, place, n, n_known, same, same_known, known, z): a row per observation, those of a state together, those of an observer by `ord`.

    The items of a space and its observations meet in one sort and are summed as
    they stream by, so each item is hashed once and no list of items is formed.
    A task holds a space's items at a time. member: what `known` has of each
    known item instead of its id. tasks: over how many the states are dealt out;
    as many as their size asks for if not told. every: with a column of that
    name, as `known` but of all items.
    """
    key = ["situation_id", "information_space_id"]
    rows = _items_and_views(s, key, member).repartition(*key).sortWithinPartitions(*key, "kind", "ord", "item_id", "token").drop("ord")
    text = {x: rows.schema[x].dataType.simpleString() for x in ("situation_id", "state_id", "observer_id", "place", "item_id" if member is None else "member")}
    sets = ", ".join(f"{x} array<{text['item_id' if member is None else 'member']}>" for x in (("known", "every") if every else ("known",)))
    shape = f"situation_id {text['situation_id']}, state_id {text['state_id']}, observer_id {text['observer_id']}, place {text['place']}, n int, n_known int, same int, same_known int, {sets}, z array<double>"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_runs(batches, key):
            yield from summed_views(whole, key, dim, every)

    state = ["situation_id", "state_id"]
    return rows.mapInArrow(stream, shape).repartition(*([] if tasks is None else [tasks]), *state).sortWithinPartitions(*state, "observer_id", "place")


def view_summaries(s: Situations, dim: int = DIM) -> DataFrame:
    """(situation_id, state_id, observer_id, copies, placed, n, n_known, same, same_known, known, z): the rows of seen with figures of the items instead of items.

    n items, n_known of them known, known their different ids, z the view_vector;
    same is the number of items with the id of the first one that has an id, null
    without one, same_known how many of those are known. A task holds a state's
    views at a time.
    """
    rows = _observed(s, dim)
    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[4:])
    text = {x: rows.schema[x].dataType.simpleString() for x in ("situation_id", "state_id", "observer_id")}

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_runs(batches, ["situation_id", "state_id"]):
            first, copies, placed = first_views(whole)
            columns = {x: first.column(x) for x in first.column_names if x != "place"}
            head = {x: columns.pop(x) for x in text}
            yield from pa.table(head | {"copies": pa.array(copies), "placed": pa.array(placed)} | columns).to_batches()

    return rows.mapInArrow(stream, ", ".join(f"{x} {kind}" for x, kind in text.items()) + f", copies bigint, placed bigint, {rest}")


def first_views(batches: Sequence[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The first observation of each observer of whole states, how many there are of each, and how many of those have a place."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    starts = _run_starts(rows, ["situation_id", "state_id", "observer_id"])
    placed = np.add.reduceat(rows.column("place").is_valid().to_numpy().astype(np.int64), starts)
    return rows.take(pa.array(starts)).combine_chunks(), np.diff(np.r_[starts, rows.num_rows]), placed


#: Views that state_sums puts into one row.
PIECE = 4096


def state_sums(s: Situations, dim: int = DIM, piece: int = PIECE) -> DataFrame:
    """Sums over the views of a state and over their pairs, in one pass; no pair is formed. Rows of one state add up.

    (situation_id, copies, volume, visible, hidden, changed, hide, reveal): sums over all observations of the state; hide and reveal over the
    changed ones, that have an item to change (see intervention_summaries). (set_pairs, set_distance): the pairs of placed observations and
    their Jaccard distances by known ids, as in set_distances. (pairs, distance, shared, only): means over about's ordered pairs come from
    these sums; uneven: unordered pairs that differ in vector or number of known ids. total: the summed vectors. (observers, times, z): the
    views themselves, at most `piece` in a row. A task holds a state's views at a time.
    """
    rows = _observed(s, dim).where(F.col("state_id").isNotNull() & F.col("observer_id").isNotNull())
    text = {x: rows.schema[x].dataType.simpleString() for x in ("situation_id", "observer_id")}

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_runs(batches, ["situation_id", "state_id"]):
            yield from summed_states(whole, piece)

    return rows.mapInArrow(
        stream,
        f"situation_id {text['situation_id']}, copies bigint, volume bigint, visible double, hidden bigint, changed bigint, hide double, reveal double, set_pairs bigint, set_distance double, "
        f"pairs bigint, distance double, shared bigint, only bigint, uneven bigint, total array<double>, observers array<{text['observer_id']}>, times array<bigint>, z array<double>",
    )


def summed_states(batches: Sequence[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """The rows of state_sums of whole states."""
    views, copies, placed = first_views(batches)
    starts = _run_starts(views, ["situation_id", "state_id"])
    m = np.diff(np.r_[starts, views.num_rows])
    states, of = len(starts), np.repeat(np.arange(len(starts)), m)
    add = lambda x: np.add.reduceat(x, starts, axis=0)
    n, n_known, same, same_known = (views.column(x).fill_null(0).to_numpy().astype(np.int64) for x in ("n", "n_known", "same", "same_known"))
    changes = views.column("same").is_valid().to_numpy()
    some = np.maximum(n, 1)
    visible = n_known / some
    out: dict[str, np.ndarray] = {
        "copies": add(copies), "volume": add(n * copies), "visible": add(visible * copies), "hidden": add((n - n_known) * copies), "changed": add(copies * changes),
        "hide": add(((n_known - same_known) / some - visible) * copies * changes), "reveal": add(((n_known + same - same_known) / some - visible) * copies * changes),
    }

    lists = views.column("known").combine_chunks()
    lengths, ids = np.diff(lists.offsets.to_numpy()), _codes(lists.flatten()).astype(np.int64)
    out["set_pairs"], out["set_distance"] = _set_distances(of, lengths, ids, placed, states)

    z = views.column("z").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(of), -1) + 0.0  # null is NaN, -0 is 0
    squares = (z * z).sum(1)
    has = squares > 0
    unit = np.where(has[:, None], z, 0.0) / np.sqrt(np.where(has, squares, 1.0))[:, None]
    one, summed = add(has.astype(np.int64)), add(unit)
    out["pairs"] = m * (m - 1)
    out["distance"] = np.where(m > 1, one * (one - 1) - ((summed * summed).sum(1) - add((unit * unit).sum(1))), 0.0)
    _, held = np.unique(np.repeat(of, lengths) * (ids.max(initial=0) + 1) + ids, return_counts=True)
    at = _ // (ids.max(initial=0) + 1)
    out["shared"] = np.bincount(at, held * (held - 1), states).astype(np.int64)
    out["only"] = add(lengths.astype(np.int64)) * (m - 1) - out["shared"]
    whole = np.ascontiguousarray(np.c_[of, lengths, z]).view(f"V{8 * (z.shape[1] + 2)}")[:, 0]
    _, place, alike = np.unique(whole, return_index=True, return_counts=True)
    out["uneven"] = m * (m - 1) // 2 - np.bincount(of[place], alike * (alike - 1) // 2, states).astype(np.int64)

    lost = np.isnan(z)
    total, none = add(np.where(lost, 0.0, z) * copies[:, None]), add((~lost).astype(np.int64)) == 0
    cuts = np.concatenate([np.arange(a, a + k, piece) for a, k in zip(starts, m, strict=True)])
    own = np.searchsorted(cuts, starts)  # the piece of a state that has its sums; the others add nothing
    columns: dict[str, pa.Array] = {"situation_id": views.column("situation_id").combine_chunks().take(pa.array(cuts))}
    for name, x in out.items():
        each = np.zeros(len(cuts), x.dtype)
        each[own] = x
        columns[name] = pa.array(each)
    width = np.zeros(len(cuts), np.int32)
    width[own] = z.shape[1]
    columns["total"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(width)].astype(np.int32)), pa.array(total.ravel(), mask=none.ravel()))
    bounds = np.r_[cuts, len(of)].astype(np.int32)
    columns["observers"] = pa.ListArray.from_arrays(pa.array(bounds), views.column("observer_id").combine_chunks())
    columns["times"] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(copies))
    columns["z"] = pa.ListArray.from_arrays(pa.array(bounds * np.int32(z.shape[1])), pa.array(z.ravel(), mask=lost.ravel()))
    yield from pa.table(columns).to_batches()


def _set_distances(of: np.ndarray, lengths: np.ndarray, ids: np.ndarray, times: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray]:
    """set_distances of the sets of each state: of a state each, `lengths` ids, `times` rows. A set is compared with those that share an id, one set at a time."""
    row = np.repeat(np.arange(len(of)), lengths)
    inside = ids[np.lexsort((ids, row))]
    ends = np.r_[0, np.cumsum(lengths)] * inside.itemsize
    text = inside.tobytes()
    sets = np.array(pa.array([text[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.large_binary()).dictionary_encode().indices, np.int64)
    _, first, classes = np.unique(of * (len(of) + 1) + sets, return_index=True, return_inverse=True)
    weight = np.bincount(classes, times, len(first)).astype(np.int64)
    first, weight = first[weight > 0], weight[weight > 0]
    group, rows = of[first], np.bincount(of, times, states).astype(np.int64)
    pairs = rows * (rows - 1) // 2
    equal = np.bincount(group, weight * (weight - 1) // 2, states)
    # entries of the classes, by state and id
    size = lengths[first]
    entry = np.repeat(np.arange(len(first)), size)
    begin = np.r_[0, np.cumsum(lengths)][first]
    what = inside[np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())] if len(first) else inside[:0]
    slot = group[entry] * (ids.max(initial=0) + 1) + what
    order = np.argsort(slot, kind="stable")
    listed = entry[order]
    low, high = (np.searchsorted(slot[order], slot, side) for side in ("left", "right"))
    alike, at = np.zeros(states), np.r_[0, np.cumsum(size)]
    for a in range(len(first)):
        found = [listed[low[i] : high[i]] for i in range(at[a], at[a + 1])]
        others = np.concatenate(found) if found else listed[:0]
        others, both = np.unique(others[others > a], return_counts=True)
        alike[group[a]] += (weight[a] * weight[others] * (both / (size[a] + size[others] - both))).sum()
    return pairs, pairs - equal - alike


#: Pairs and shared members that paired_views puts into one batch.
PAIRS = 1 << 18


def key_text() -> Column:
    """(about, holder_id) of an item as one text, different for different ones, null among them; see known_keys."""
    about, holder = F.col("about").cast("string"), F.col("holder_id").cast("string")
    return F.concat(F.coalesce(F.concat(F.length(about).cast("string"), F.lit(":"), about), F.lit("")), F.lit("/"), F.coalesce(F.concat(F.lit("="), holder), F.lit("")))


def view_pairs(s: Situations, member: Column, dim: int = DIM, piece: int = PAIRS, ordered: bool = False) -> DataFrame:
    """(situation_id, state_id, observer_id_a, norm_a, n_a, observer_id_b, norm_b, n_b, product, both): every pair of observers (a < b) of a state.

    norm_ and product are those of the vectors, null and NaN beside a null in a vector; n_ is the number of different `member` of the known
    items, both of those that two views share. Products and shared members are worked out for a block of views at once, no view is
    copied per pair. A task holds a state's views at a time, and of its pairs those of a block. States are dealt out to all tasks of a shuffle
    as it is set, however small their views: the pairs are what takes time.
    Where the items tell a state_id, the one state whose views name their space, items and views are shuffled once, by state; else by space, and
    then the views by state. An observation may come several times.

    ordered: every pair both ways round, with `hidden`, the number of different `member` that items of the two have and that neither knows.
    """
    state, spaces, col = ["situation_id", "state_id"], ["situation_id", "state_id", "information_space_id"], F.col
    named = replace(s, observations=s.observations.where(col("situation_id").isNotNull() & col("state_id").isNotNull() & col("observer_id").isNotNull()))
    tasks, told = shuffle_width(s.observations.sparkSession), "state_id" in s.info_items.columns
    if told:
        rows = _items_and_views(named, spaces, member).repartition(tasks, *state).sortWithinPartitions(*spaces, "kind", "ord", "item_id", "token").drop("ord")
    else:
        rows = _observed(named, dim, member, tasks, ordered)
    text = {x: rows.schema[x].dataType.simpleString() for x in (*state, "observer_id")}

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_runs(batches, state):
            views = _by_observer(summed_views(whole, spaces, dim, ordered)) if told else whole
            yield from paired_views(views, piece, ordered) if views else ()

    side = ", ".join(f"observer_id_{x} array<{text['observer_id']}>, norm_{x} array<double>, n_{x} array<int>" for x in "ab")
    counts = ["both", "hidden"] if ordered else ["both"]
    blocks = rows.mapInArrow(stream, f"situation_id {text['situation_id']}, state_id {text['state_id']}, {side}, before int, product array<array<double>>, {', '.join(f'{x} array<array<int>>' for x in counts)}")
    a, b = ["observer_id_a", "norm_a", "n_a"], ["observer_id_b", "norm_b", "n_b"]
    focal = blocks.select(*state, *a, *b, "before", *counts, F.posexplode("product").alias("_i", "_row"))
    focal = focal.select(*state, *[F.get(x, col("_i")).alias(x) for x in a], *b, (col("before") + col("_i")).alias("_i"), *[F.get(x, col("_i")).alias(x) for x in counts], "_row")
    pairs = focal.select(*state, *a, *b, "_i", *counts, F.posexplode("_row").alias("_j", "product"))
    at = col("_j") if ordered else col("_i") + col("_j")
    pairs = pairs.where(col("_i") != col("_j")) if ordered else pairs
    return pairs.select(*state, *a, *[F.get(x, at).alias(x) for x in b], "product", *[F.get(x, col("_j")).alias(x) for x in counts])


def _by_observer(batches: Iterator[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """Views of whole states in the order of _observed."""
    found = list(batches)
    if not found:
        return []
    rows = pa.Table.from_batches(found)
    order = [(x, "ascending") for x in ("situation_id", "state_id", "observer_id", "place")]
    return rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start")).combine_chunks().to_batches()


def paired_views(batches: Sequence[pa.RecordBatch], piece: int, ordered: bool = False) -> Iterator[pa.RecordBatch]:
    """Blocks of the pairs of whole states: a row has some views of a state, all that come after the first of them, and a list for each with those after it.

    ordered: a row has some views, all of the state, `before`, how many of these come before the first of those, and a list for each with all, itself too.
    """
    views, _, _ = first_views(batches)
    m, starts = views.num_rows, _run_starts(views, ["situation_id", "state_id"])
    begins, ends = (np.repeat(x, np.diff(np.r_[starts, m])) for x in (starts, np.r_[starts[1:], m]))
    base = begins if ordered else np.arange(m) + 1  # the first view that each one meets
    z = views.column("z").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(m, -1)  # null is NaN
    norms = np.sqrt((z * z).sum(1))
    lengths, work, shared = _shared_members(views.column("known").combine_chunks(), ends, ordered)
    columns = {"observer_id": views.column("observer_id").combine_chunks(), "norm": pa.array(norms, mask=np.isnan(norms)), "n": pa.array(lengths.astype(np.int32))}
    if ordered:
        sizes, more, shared_all = _shared_members(views.column("every").combine_chunks(), ends, ordered)
        work, unknown = work + more, sizes - lengths
    pairs = ends - base
    work = np.cumsum(pairs + work)

    lo = 0
    while lo < m:
        hi = max(lo + 1, int(np.searchsorted(work, (work[lo - 1] if lo else 0) + piece, "right")))
        begin = np.r_[0, np.cumsum(pairs[lo:hi])]
        if begin[-1]:
            cuts = np.r_[lo, starts[(starts > lo) & (starts < hi)]]
            ranges = list(zip(cuts, np.r_[cuts[1:], hi], base[cuts], ends[cuts], strict=True))
            product = [z[x:y] @ z[begins[x] if ordered else x : end].T for x, y, _, end in ranges]
            product = np.concatenate([(p if ordered else p[np.arange(p.shape[1]) > np.arange(p.shape[0])[:, None]]).ravel() for p in product])
            place = begin[:-1] - base[lo:hi]
            lists = {"product": product, "both": shared(lo, hi, place, begin[-1])}
            others = np.concatenate([np.arange(x, end) for _, _, x, end in ranges])
            if ordered:
                a, b = np.repeat(np.arange(lo, hi), pairs[lo:hi]), np.arange(begin[-1]) - np.repeat(place, pairs[lo:hi])
                lists["hidden"] = (unknown[a] + unknown[b] + lists["both"] - shared_all(lo, hi, place, begin[-1])).astype(np.int32)
            rows, after = pa.array(np.r_[cuts, hi] - lo, pa.int32()), pa.array(np.r_[0, np.cumsum(ends[cuts] - base[cuts])], pa.int32())
            inner = pa.array(begin, pa.int32())
            out = {x: views.column(x).combine_chunks().take(pa.array(cuts)) for x in ("situation_id", "state_id")}
            out |= {f"{x}_a": pa.ListArray.from_arrays(rows, column.slice(lo, hi - lo)) for x, column in columns.items()}
            out |= {f"{x}_b": pa.ListArray.from_arrays(after, column.take(pa.array(others))) for x, column in columns.items()}
            out |= {"before": pa.array((cuts - begins[cuts] if ordered else cuts - cuts).astype(np.int32))}
            out |= {x: pa.ListArray.from_arrays(rows, pa.ListArray.from_arrays(inner, pa.array(each))) for x, each in lists.items()}
            yield from pa.table(out).to_batches()
        lo = hi


def _shared_members(lists: pa.ListArray, ends: np.ndarray, ordered: bool) -> tuple[np.ndarray, np.ndarray, Callable]:
    """Of views whose states end at `ends`: how many members each has, how many members of later views of the state (ordered: of all) are among them, and
    a function of (lo, hi, place, pairs) that counts what views lo to hi share with those: the pair of views a and b is at place[a - lo] + b."""
    m = len(ends)
    lengths, codes = np.diff(lists.offsets.to_numpy()), _codes(lists.flatten()).astype(np.int64)
    view = np.repeat(np.arange(m), lengths)
    slot = ends[view] * (codes.max(initial=0) + 1) + codes
    order = np.argsort(slot, kind="stable")
    view, slot = view[order], slot[order]
    first = np.searchsorted(slot, slot, "left") if ordered else np.arange(len(slot)) + 1
    times = np.searchsorted(slot, slot, "right") - first
    own, at = np.argsort(view, kind="stable"), np.r_[0, np.cumsum(lengths)]

    def shared(lo: int, hi: int, place: np.ndarray, pairs: int) -> np.ndarray:
        entry = own[at[lo] : at[hi]]
        n = times[entry]
        a = np.repeat(view[entry], n)
        b = view[np.repeat(first[entry] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return np.bincount(place[a - lo] + b, minlength=pairs).astype(np.int32)

    return lengths, np.bincount(view, times, m).astype(np.int64), shared


def _whole_runs(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[list[pa.RecordBatch]]:
    """The batches of sorted rows, cut so that all rows with the same key are in one list."""
    held: list[pa.RecordBatch] = []  # of the run that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(_run_starts(batch, key)[-1])
        goes_on = bool(held) and all(batch.column(x)[0] == held[-1].column(x)[held[-1].num_rows - 1] for x in key)
        if last == 0 and goes_on:
            held.append(batch)
            continue
        whole = [*held, batch.slice(0, last)] if last else held
        if whole:
            yield whole
        held = [batch.slice(last)]
    if held:
        yield held


def _run_starts(batch: pa.RecordBatch | pa.Table, key: Sequence[str]) -> np.ndarray:
    """Where rows begin that differ from the row before in the key."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for x in key:
        codes = _codes(batch.column(x))
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A number for each different value, null among them."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def summed_views(batches: Sequence[pa.RecordBatch], key: Sequence[str], dim: int, every: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows of _observed of whole spaces, whose items come before their observations."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    starts = _run_starts(rows, key)
    spaces = len(starts)
    of = np.repeat(np.arange(spaces), np.diff(np.r_[starts, rows.num_rows]))
    is_view = rows.column("kind").to_numpy() == 1
    item, at = rows.filter(pa.array(~is_view)), of[~is_view]
    count = lambda mask: np.bincount(at[mask], minlength=spaces)
    known, blind = (item.column(x).to_numpy().astype(bool) for x in ("known", "blind"))
    n, n_known, n_blind = np.bincount(at, minlength=spaces), count(known), count(blind)

    tokens = item.column("token").to_pylist()
    digests = np.frombuffer(b"".join(hashlib.sha256((x or "").encode()).digest() for x in tokens), np.uint8).reshape(-1, 32)
    width = dim if dim <= 4 else dim - 4  # see bag_vector
    z = [np.bincount(at, digests[:, i % 32] / 127.5 - 1.0, spaces) / np.maximum(n, 1) for i in range(width)]  # added up in the order of the items
    lost = np.bincount(at[item.column("token").is_null().to_numpy()], minlength=spaces) > 0
    z = np.stack([*z, *([] if dim <= 4 else [n, n_known, n - n_known, n_blind])], axis=1)

    ids = item.column("item_id")
    members = item.column("member") if "member" in item.column_names else ids
    codes = _codes(members)
    sets = {}
    for name, mask in {"known": known, **({"every": np.ones_like(known)} if every else {})}.items():
        each, place = np.unique(at[mask] * (len(codes) + 1) + codes[mask], return_index=True)
        bounds = np.searchsorted(each, np.arange(spaces + 1) * (len(codes) + 1)).astype(np.int32)
        sets[name] = pa.ListArray.from_arrays(pa.array(bounds), members.combine_chunks().filter(pa.array(mask)).take(pa.array(place)))
    codes = codes if members is ids else _codes(ids)
    named = np.flatnonzero(np.array([bool(x) for x in ids.to_pylist()], bool))
    having, place = np.unique(at[named], return_index=True)
    first = np.full(spaces, -1, np.int64)
    first[having] = codes[named[place]]
    alike = codes == first[at]

    view, of = rows.filter(pa.array(is_view)), of[is_view]
    if not len(of):
        return
    unnamed, flat = first[of] < 0, z[of].ravel()
    missing = np.zeros((len(of), z.shape[1]), bool)
    missing[:, :width] = lost[of][:, None]
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1, dtype=np.int32) * z.shape[1]), pa.array(flat, mask=missing.ravel()))
    number = lambda x, mask=None: pa.array(x[of].astype(np.int32), mask=mask)
    columns = {x: view.column(x).combine_chunks() for x in ("situation_id", "state_id", "observer_id", "place")}
    columns |= {"n": number(n), "n_known": number(n_known), "same": number(count(alike), unnamed), "same_known": number(count(alike & known), unnamed), **{x: each.take(pa.array(of)) for x, each in sets.items()}, "z": vectors}
    yield from pa.table(columns).to_batches()


def action_sets(s: Situations, dim: int = DIM) -> DataFrame:
    """(situation_id, transition_id, set_key, z): the action set of every transition with actions; a missing action stops the job."""
    return encoded_action_sets(s, s.transitions.where(F.size("action_ids") > 0), dim)


def encoded_action_sets(s: Situations, wanted: DataFrame, dim: int = DIM) -> DataFrame:
    """The same for any (situation_id, transition_id, action_ids)."""
    asked = wanted.select("situation_id", "transition_id", F.posexplode("action_ids").alias("pos", "action_id"))
    found = relational.require_all(asked, s.actions.select("situation_id", "action_id", "action_type", "parameters"), ["situation_id", "action_id"], "action")
    key = ["situation_id", "transition_id"]
    rows = found.select(*key, "pos", "action_id", "action_type", F.sort_array(F.coalesce(F.json_object_keys("parameters"), F.array())).alias("keys"))
    rows = rows.repartition(*key).sortWithinPartitions(*key, "pos", "action_id", "action_type", "keys").drop("pos")
    text = {x: rows.schema[x].dataType.simpleString() for x in key}

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_runs(batches, key):
            yield from summed_actions(whole, key, dim)

    return rows.mapInArrow(stream, f"situation_id {text['situation_id']}, transition_id {text['transition_id']}, set_key string, z array<double>")


def summed_actions(batches: Sequence[pa.RecordBatch], key: Sequence[str], dim: int) -> Iterator[pa.RecordBatch]:
    """The rows of encoded_action_sets of whole sets; a set's tokens are its types, its different keys and its size."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    starts = _run_starts(rows, key)
    sets, n = len(starts), np.diff(np.r_[starts, rows.num_rows])
    of = np.repeat(np.arange(sets), n)
    kinds, lists = rows.column("action_type").combine_chunks(), rows.column("keys").combine_chunks()
    flat, types = lists.flatten(), _codes(kinds).astype(np.int64)
    keys, owner = _codes(flat).astype(np.int64), np.repeat(of, np.diff(lists.offsets.to_numpy()))
    _, first = np.unique(owner * (keys.max(initial=0) + 1) + keys, return_index=True)
    first.sort()  # in the order in which they come
    tokens = [f"type={x}" if x is not None else None for x in kinds.to_pylist()] + [f"param_key={x}" if x is not None else None for x in flat.take(pa.array(first)).to_pylist()] + [f"n={x}" for x in n]
    at = np.r_[of, owner[first], np.arange(sets)]
    text = {x: i for i, x in enumerate(dict.fromkeys(tokens))}
    digests = np.frombuffer(b"".join(hashlib.sha256((x or "").encode()).digest() for x in text), np.uint8).reshape(-1, 32)[[text[x] for x in tokens]]
    width = dim if dim <= 4 else dim - 4  # see bag_vector
    count = np.bincount(at, minlength=sets)
    different = np.bincount(np.unique(of * (types.max() + 1) + types) // (types.max() + 1), minlength=sets)
    stats = [n, different, np.bincount(owner[first], minlength=sets), np.zeros(sets)]
    z = np.stack([*[np.bincount(at, digests[:, i % 32] / 127.5 - 1.0, sets) / count for i in range(width)], *([] if dim <= 4 else stats)], axis=1)  # added up in the order of the tokens
    missing = np.zeros(z.shape, bool)
    missing[np.unique(at[[x is None for x in tokens]]), :width] = True
    ids = rows.column("action_id").to_pylist()
    set_keys = ["\x1f".join(sorted(x for x in ids[a : a + k] if x is not None)) for a, k in zip(starts, n, strict=True)]
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(sets + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel(), mask=missing.ravel()))
    yield from pa.table({x: rows.column(x).combine_chunks().take(pa.array(starts)) for x in key} | {"set_key": pa.array(set_keys, pa.string()), "z": vectors}).to_batches()


def intervene(items: Column, item_id: Column, operation: str) -> Column:
    """Items with every item of the id hidden or revealed; 'identity' leaves them."""
    if operation == "identity":
        return items
    seen, content = ("hidden", False) if operation == "hide" else ("public", True)
    return F.transform(items, lambda i: F.when(i["item_id"] == item_id, i.withField("visibility", F.lit(seen)).withField("content_known", F.lit(content))).otherwise(i))


def intervention_summaries(s: Situations) -> DataFrame:
    """Per view with items: how visibility moves when its first item is hidden, revealed or left."""
    v = views(s).withColumn("first", F.get(F.filter("items", lambda i: F.coalesce(i["item_id"], F.lit("")) != ""), F.lit(0))["item_id"]).where(F.col("first").isNotNull())
    delta = lambda op: visibility(intervene(F.col("items"), F.col("first"), op)) - visibility(F.col("items"))
    return v.select("situation_id", "observation_id", F.col("first").alias("item_id"), delta("identity").alias("identity_delta"), delta("hide").alias("hide_delta"), delta("reveal").alias("reveal_delta"))


def about_vector(focal: Column, target: Column, za: Column, zb: Column) -> Column:
    """The 3 * dim + 5 numbers of one view about another, from the items and vectors of both."""
    ids = lambda items: F.array_distinct(F.transform(items, lambda i: i["item_id"]))
    ka, kb = known_ids(focal), known_ids(target)
    hidden = F.array_except(F.array_except(F.array_union(ids(focal), ids(target)), ka), kb)
    sizes = [F.size(x).cast("double") for x in (F.array_except(ka, kb), F.array_except(kb, ka), F.array_intersect(ka, kb), hidden)]
    return F.concat(za, zb, F.zip_with(za, zb, lambda x, y: x - y), F.array(F.coalesce(c.cosine_distance(za, zb), F.lit(0.0)), *sizes))


def perspectives(s: Situations, dim: int = DIM) -> DataFrame:
    """(situation_id, state_id, observer_id, z, norm, known, blind): every observer of a state once; blind are the ids never known."""
    ids = F.array_distinct(F.transform("items", lambda i: i["item_id"]))
    z = seen(s).select("situation_id", "state_id", "observer_id", view_vector(F.col("items"), dim).alias("z"), known_ids(F.col("items")).alias("known"), ids.alias("ids"))
    return z.select("situation_id", "state_id", "observer_id", "z", F.sqrt(c.dot(F.col("z"), F.col("z"))).alias("norm"), "known", F.array_except("ids", "known").alias("blind"))


def paired_cosine(dim: int) -> Column:
    """The cosine distance of z_a and z_b from their norms, 0 beside a zero vector; summed in the order of c.dot."""
    product = F.lit(0.0)
    for i in range(dim):
        product = product + F.get("z_a", F.lit(i)) * F.get("z_b", F.lit(i))
    return F.coalesce(1.0 - F.try_divide(product, F.col("norm_a") * F.col("norm_b")), F.lit(0.0))


def common(a: str, b: str) -> Column:
    """How many members two sets share."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.size(F.array_intersect(a, b)))


def about_counts(s: Situations, dim: int = DIM) -> DataFrame:
    """One observer about another at the same state: distance and set counts per ordered pair, with both vectors."""
    p = relational.ordered_pairs(perspectives(s, dim), ["situation_id", "state_id"], "observer_id", ["z", "norm", "known", "blind"])
    p = p.select(
        "situation_id", "state_id", "observer_id_a", "observer_id_b", "z_a", "z_b", paired_cosine(dim).alias("distance"), F.size("known_a").alias("_a"), F.size("known_b").alias("_b"), common("known_a", "known_b").alias("shared"),
        (F.size("blind_a") + F.size("blind_b") - common("blind_a", "known_b") - common("blind_b", "known_a") - common("blind_a", "blind_b")).alias("hidden_both"),
    )
    return p.select("situation_id", "state_id", "observer_id_a", "observer_id_b", "z_a", "z_b", "distance", (F.col("_a") - F.col("shared")).alias("only_a"), (F.col("_b") - F.col("shared")).alias("only_b"), "shared", "hidden_both")


def about_figures(s: Situations, dim: int = DIM) -> DataFrame:
    """about_counts without the vectors, its pairs listed in blocks (see view_pairs)."""
    p, col = view_pairs(s, F.col("item_id"), dim, ordered=True), F.col
    distance = F.coalesce(1.0 - F.try_divide("product", col("norm_a") * col("norm_b")), F.lit(0.0))
    only = [(col(f"n_{x}") - col("both")).alias(f"only_{x}") for x in "ab"]
    return p.select("situation_id", "state_id", "observer_id_a", "observer_id_b", distance.alias("distance"), *only, col("both").alias("shared"), col("hidden").alias("hidden_both"))


def about(s: Situations, dim: int = DIM) -> DataFrame:
    """One observer about another at the same state: 3·dim + 5 numbers per ordered pair, and the set counts."""
    extras = F.array(*[F.col(x).cast("double") for x in ("distance", "only_a", "only_b", "shared", "hidden_both")])
    return about_counts(s, dim).withColumn("vector", F.concat("z_a", "z_b", F.zip_with("z_a", "z_b", lambda x, y: x - y), extras)).drop("z_a", "z_b")


def asymmetric_counts(seen_once: DataFrame, dim: int = DIM) -> DataFrame:
    """What asymmetric_pairs tells of about, without its pairs: the two directions are equal where vectors are and as many ids are known."""
    col = F.col
    return unequal_pairs(seen_once.where(col("state_id").isNotNull() & col("observer_id").isNotNull()).select("situation_id", "state_id", view_vector(col("items"), dim).alias("z"), F.size(known_ids(col("items"))).alias("k")))


def unequal_pairs(z: DataFrame) -> DataFrame:
    """(situation_id, n_asymmetric): unordered pairs of rows (situation_id, state_id, z, k) of a state that differ in z or k.

    Vectors are told apart by 128 bits of hash.
    """
    state, col = ["situation_id", "state_id"], F.col
    equal = z.select(*state, "k", F.xxhash64("z").alias("d1"), F.xxhash64(F.lit(1), "z", F.lit("z")).alias("d2")).groupBy(*state, "k", "d1", "d2").agg(F.count("*").alias("n"))
    per_state = equal.groupBy(*state).agg(F.sum("n").alias("m"), F.sum(F.expr("n * (n - 1) div 2")).alias("same")).where(col("m") > 1)
    return per_state.groupBy("situation_id").agg(F.sum(F.expr("m * (m - 1) div 2 - same")).alias("n_asymmetric"))


def asymmetric_pairs(pairs: DataFrame) -> DataFrame:
    """(situation_id, n_asymmetric): unordered pairs whose two directions differ."""
    back = pairs.select("situation_id", "state_id", F.col("observer_id_b").alias("observer_id_a"), F.col("observer_id_a").alias("observer_id_b"), F.col("vector").alias("_back"))
    both = pairs.join(back, ["situation_id", "state_id", "observer_id_a", "observer_id_b"]).where(F.col("observer_id_a") < F.col("observer_id_b"))
    return both.groupBy("situation_id").agg(F.count_if(F.col("vector") != F.col("_back")).alias("n_asymmetric"))
