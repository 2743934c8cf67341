"""Nested XML records as related flat tables.

Each record is parsed as a stream into triples (path, ordinals, value): one for
every element, every attribute (path ends in /@name) and every element text
(path ends in /text()), with the position of each element of the path among its
siblings of the same name. A triple belongs to the deepest repeated ancestor on
its path; each instance of a repeated ancestor, and the root, becomes one row
whose key is the record and the positions of the repeated elements above, which
keeps parent and child linked. A row leaves the parser when its element ends, so
a record is never held as a whole beside its own text. Pivoting the rows of an
ancestor into columns happens in the JVM.

Which ancestors repeat is read off the data (path_summary, repeated_ancestors)
or declared. Nothing is dropped where a declaration falls short: a second value
at a path of one instance becomes a row of its own under UNPLACED.

Records delivered more than once are told by their ids; no text crosses the
network (see standing.newest).

Defined cases: null or empty records, records that are not well-formed and
records with another root give no rows in the tables and one in rejects();
absent attributes are null; of records with one id the latest stands, the last
in the input among equally late ones; an empty table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structlens.operators.standing import newest

#: Fields buffered before a batch goes back to the JVM, and characters parsed at a time.
BATCH_FIELDS, CHUNK = 100_000, 1 << 16
#: Anchors of rows that are no instance: records that could not be read, values that had no place.
REJECT, UNPLACED = "!", "+"

Triple = tuple[str, tuple[int, ...], str]
Emit = Callable[[str, tuple[int, ...], dict[str, str]], None]


def root_of(body: str | None) -> str:
    """The root element's name; ValueError without content, ExpatError if the record is not well-formed.

    This first pass has no handlers, so it runs inside the parser, and the second can hand on what it meets at once.
    """
    if body is None or not body.strip():
        raise ValueError("no content")
    parser = expat.ParserCreate()
    found: list[str] = []

    def first(name: str, _: dict) -> None:
        found.append(name)
        parser.StartElementHandler = None

    parser.StartElementHandler = first
    parser.Parse(body, True)
    return found[0]


def _chunks(parser, body: str) -> Iterator[None]:
    for at in range(0, len(body), CHUNK):
        parser.Parse(body[at : at + CHUNK], False)
        yield
    parser.Parse("", True)
    yield


def triples(body: str) -> Iterator[Triple]:
    """The (path, ordinals, value) triples of a well-formed document, as they are met; an element's own has value ''."""
    found: list[Triple] = []
    ordinals: list[int] = []
    paths: list[str] = []
    seen: list[dict[str, int]] = [{}]
    texts: list[list[str]] = []

    def start(name: str, attributes: list[str]) -> None:
        count = seen[-1][name] = seen[-1].get(name, 0) + 1
        path = f"{paths[-1]}/{name}" if paths else name
        ordinals.append(count)
        paths.append(path)
        seen.append({})
        texts.append([])
        at = tuple(ordinals)
        found.append((path, at, ""))
        for k in range(0, len(attributes), 2):
            found.append((f"{path}/@{attributes[k]}", at, attributes[k + 1]))

    def end(_: str) -> None:
        text = "".join(texts.pop()).strip()
        if text:
            found.append((f"{paths[-1]}/text()", tuple(ordinals), text))
        ordinals.pop(), paths.pop(), seen.pop()

    parser = expat.ParserCreate()
    parser.ordered_attributes = parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: texts[-1].append(data)
    for _ in _chunks(parser, body):
        yield from found
        found.clear()


class _Node:
    """A path met so far: whether instances of it are rows, and what its values are called in the row they belong to."""

    __slots__ = ("path", "relative", "is_row", "kept", "children", "names")

    def __init__(self, path: str, relative: str, is_row: bool, kept: bool) -> None:
        self.path, self.relative, self.is_row, self.kept = path, relative, is_row, kept
        self.children: dict[str, _Node] = {}
        self.names: dict[str, str] = {}

    def name(self, last: str) -> str:
        found = self.names.get(last)
        if found is None:
            found = self.names[last] = f"{self.relative}/{last}" if self.relative else last
        return found


class Shredder:
    """Groups the triples of one record after the other by repeated ancestor; paths learnt stay known between records."""

    def __init__(self, repeated: Sequence[str], keep: Sequence[str] | None = None) -> None:
        self.repeated = frozenset(repeated)
        self.keep = None if keep is None else frozenset(keep)
        self.roots: dict[str, _Node] = {}

    def _node(self, parent: _Node | None, name: str) -> _Node:
        path = f"{parent.path}/{name}" if parent else name
        is_row = parent is None or path in self.repeated
        kept = (self.keep is None or path in self.keep) if is_row else parent.kept
        return _Node(path, "" if is_row else parent.name(name), is_row, kept)

    def run(self, body: str, emit: Emit) -> None:
        """Calls emit(anchor, positions, fields) for every instance of a kept ancestor as it ends."""
        nodes: list[_Node] = []
        positions: list[tuple[int, ...]] = [()]
        rows: list[dict[str, str]] = []
        counts: list[dict[str, int] | None] = [None]
        texts: list[list[str] | None] = []
        roots, make = self.roots, self._node

        def put(row: dict[str, str], node: _Node, name: str, value: str) -> None:
            if name in row:
                emit(UNPLACED, positions[-1], {"path": f"{node.path}/{name.rsplit('/', 1)[-1]}" if value or name != node.relative else node.path, "value": value})
            else:
                row[name] = value

        def start(name: str, attributes: list[str]) -> None:
            if nodes:
                parent = nodes[-1]
                node = parent.children.get(name)
                if node is None:
                    node = parent.children[name] = make(parent, name)
            else:
                node = roots.get(name)
                if node is None:
                    node = roots[name] = make(None, name)
            if node.is_row:
                if nodes:
                    count = counts[-1]
                    if count is None:
                        count = counts[-1] = {}
                    n = count[name] = count.get(name, 0) + 1
                    positions.append((*positions[-1], n))
                else:
                    positions.append(())
                row: dict[str, str] = {}
                rows.append(row)
            else:
                row = rows[-1]
                if node.kept:
                    put(row, node, node.relative, "")
            nodes.append(node)
            counts.append(None)
            texts.append(None)
            if node.kept:
                for k in range(0, len(attributes), 2):
                    last = "@" + attributes[k]
                    full = node.names.get(last) or node.name(last)
                    if full in row:
                        put(row, node, full, attributes[k + 1])
                    else:
                        row[full] = attributes[k + 1]

        def end(_: str) -> None:
            node = nodes.pop()
            counts.pop()
            text = texts.pop()
            if text is not None and node.kept and (whole := "".join(text).strip()):
                put(rows[-1], node, node.name("text()"), whole)
            if node.is_row:
                row = rows.pop()
                if node.kept:
                    emit(node.path, positions[-1], row)
                positions.pop()

        def characters(data: str) -> None:
            if texts[-1] is not None:
                texts[-1].append(data)
            elif not data.isspace():
                texts[-1] = [data]

        parser = expat.ParserCreate()
        parser.ordered_attributes = parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler = start, end
        if self.keep is None or not self.keep <= _NO_TEXT:
            parser.CharacterDataHandler = characters
        for _ in _chunks(parser, body):
            pass


#: Nothing: asked for with no ancestor at all (rejects only), texts need not be gathered.
_NO_TEXT: frozenset[str] = frozenset()

_OUT = pa.schema([("record_id", pa.int64()), ("anchor", pa.string()), ("positions", pa.list_(pa.int32())), ("fields", pa.map_(pa.string(), pa.string()))])


class _Rows:
    """Rows on their way to the JVM, kept as flat columns."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.anchors: list[str] = []
        self.at: list[int] = []
        self.at_edges, self.field_edges = [0], [0]
        self.keys: list[str] = []
        self.values: list[str] = []

    def add(self, ident: int | None, anchor: str, positions: tuple[int, ...], fields: Mapping[str, str]) -> None:
        self.ids.append(ident)
        self.anchors.append(anchor)
        self.at.extend(positions)
        self.at_edges.append(len(self.at))
        self.keys.extend(fields.keys())
        self.values.extend(fields.values())
        self.field_edges.append(len(self.keys))

    def batch(self) -> pa.RecordBatch:
        positions = pa.ListArray.from_arrays(pa.array(self.at_edges, pa.int32()), pa.array(self.at, pa.int32()))
        fields = pa.MapArray.from_arrays(pa.array(self.field_edges, pa.int32()), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))
        out = pa.RecordBatch.from_arrays([pa.array(self.ids, pa.int64()), pa.array(self.anchors, pa.string()), positions, fields], schema=_OUT)
        self.clear()
        return out


def standing_records(df: DataFrame, record_id: str, body: str, latest: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """(record_id, body, carried columns) of the latest row of every record id."""
    best = newest(df, F.col(record_id), [F.col(c) for c in latest], {"body": F.col(body), **{c: F.col(c) for c in carry}})
    return best.withColumnRenamed("_key", "record_id")


def instance_table(df: DataFrame, record_id: str, body: str, latest: Sequence[str], root: str, repeated: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """(record_id, anchor, positions, fields): a row per instance of the root and of every repeated ancestor, or of the kept ones.

    Anchor REJECT has the records that could not be read, UNPLACED the values
    without a place (fields path and value, positions those of their instance).
    """
    repeated, keep = list(repeated), None if keep is None else list(keep)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, shredder = _Rows(), Shredder(repeated, keep)
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = text.as_py()
                try:
                    if root_of(content) != root:
                        raise ValueError("another root element")
                except (expat.ExpatError, ValueError) as failure:
                    rows.add(ident, REJECT, (), {"reason": "not well-formed" if isinstance(failure, expat.ExpatError) else str(failure)})
                    continue
                shredder.run(content, lambda anchor, at, fields, ident=ident: rows.add(ident, anchor, at, fields))
                if len(rows.keys) >= BATCH_FIELDS:
                    yield rows.batch()
        if rows.ids:
            yield rows.batch()

    records = standing_records(df, record_id, body, latest).select("record_id", "body")
    return records.mapInArrow(parse, "record_id bigint, anchor string, positions array<int>, fields map<string,string>")


def pivot(table: DataFrame, anchor: str, positions: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """One flat table: the instances of an anchor, its positions named, its relative paths as trimmed columns."""
    keys = [F.get("positions", F.lit(i)).alias(name) for i, name in enumerate(positions)]
    return table.where(F.col("anchor") == anchor).select("record_id", *keys, *[trimmed(F.try_element_at("fields", F.lit(path))).alias(name) for name, path in columns.items()])


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")


def rejects(table: DataFrame) -> DataFrame:
    return table.where(F.col("anchor") == REJECT).select("record_id", F.try_element_at("fields", F.lit("reason")).alias("reason"))


def unplaced(table: DataFrame) -> DataFrame:
    """(record_id, positions, path, value): what no column of its instance could take."""
    return table.where(F.col("anchor") == UNPLACED).select("record_id", "positions", F.try_element_at("fields", F.lit("path")).alias("path"), F.try_element_at("fields", F.lit("value")).alias("value"))


def path_summary(df: DataFrame, record_id: str, body: str, latest: Sequence[str], root: str | None = None) -> DataFrame:
    """Every path of the well-formed records (with that root): records it is in, times it occurs, most under one parent.

    Counts are combined per batch before they are shuffled.
    """
    out_type = pa.schema([("path", pa.string()), ("records", pa.int64()), ("occurrences", pa.int64()), ("most_in_parent", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[str, list[int]] = {}
            for text in batch.column(0):
                content = text.as_py()
                try:
                    if root_of(content) != root and root is not None:
                        continue
                except (expat.ExpatError, ValueError):
                    continue
                here: set[str] = set()
                for path, ordinals, _ in triples(content):
                    row = total.setdefault(path, [0, 0, 0])
                    row[0] += path not in here
                    row[1] += 1
                    row[2] = max(row[2], ordinals[-1])
                    here.add(path)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), *[pa.array([r[k] for r in total.values()], pa.int64()) for k in range(3)]], schema=out_type)

    parts = standing_records(df, record_id, body, latest).select("body").mapInArrow(count, "path string, records bigint, occurrences bigint, most_in_parent bigint")
    return parts.groupBy("path").agg(F.sum("records").alias("records"), F.sum("occurrences").alias("occurrences"), F.max("most_in_parent").alias("most_in_parent"))


def is_element(path: Column) -> Column:
    """Whether a path ends in an element, not in an attribute or a text."""
    last = F.substring_index(path, "/", -1)
    return ~last.startswith("@") & (last != "text()")


def repeated_ancestors(summary: DataFrame) -> list[str]:
    """The element paths that occur more than once under one parent: one table each. Paths are few, however many the records."""
    found = summary.where(is_element(F.col("path")) & (F.col("most_in_parent") > 1)).select("path").collect()
    return sorted(r["path"] for r in found)


def reconcile(summary: DataFrame, table: DataFrame, root: str) -> DataFrame:
    """(path, occurrences, placed, unplaced, unaccounted): every path of the records against the tables made of them."""
    field = table.where(~F.col("anchor").isin(REJECT, UNPLACED)).select("anchor", F.explode(F.array_append(F.map_keys("fields"), F.lit(""))).alias("relative"))
    placed = field.groupBy(F.when(F.col("relative") == "", F.col("anchor")).otherwise(F.concat_ws("/", "anchor", "relative")).alias("_p")).agg(F.count("*").alias("placed"))
    left = unplaced(table).groupBy(F.col("path").alias("_u")).agg(F.count("*").alias("unplaced"))
    both = summary.where((F.col("path") == root) | F.col("path").startswith(root + "/")).join(placed, F.col("path") == F.col("_p"), "full").join(left, F.coalesce("path", "_p") == F.col("_u"), "full")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return both.select(F.coalesce("path", "_p", "_u").alias("path"), count("occurrences").alias("occurrences"), count("placed").alias("placed"), count("unplaced").alias("unplaced"), (count("occurrences") - count("placed") - count("unplaced")).alias("unaccounted"))
