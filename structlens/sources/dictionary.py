"""The data dictionary of catalog rows, claims about them, and the registry of corpora."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from structlens.errors import SchemaDriftError
from structlens.sources.things import GAME_FIELDS


@dataclass(frozen=True)
class FieldSpec:
    model: str
    name: str
    kind: str
    nullable: bool
    missing: str
    source_path: str | None


#: Where fields of a row come from, and what a missing one becomes.
_ORIGIN = {
    "id": ("item/@id", "the item is an error"), "title": ("name[@type=primary]/@value", "the item is an error"), "release_year": ("yearpublished/@value", "0 is null"),
    "min_players": ("minplayers/@value", "0 is null"), "max_players": ("maxplayers/@value", "0 is null"), "min_play_time_minutes": ("minplaytime/@value", "0 is null, then playingtime if both are"),
    "max_play_time_minutes": ("maxplaytime/@value", "0 is null, then playingtime if both are"), "popularity": (None, "always null"), "rating": ("statistics/ratings/average/@value", "null without ratings"),
    "rating_count": ("statistics/ratings/usersrated/@value", "0 stays 0"), "complexity": ("statistics/ratings/averageweight/@value", "null without weights"), "designers": ("link[@type=boardgamedesigner]/@value", "empty list"),
    "publishers": ("link[@type=boardgamepublisher]/@value", "empty list"), "categories": ("link[@type=boardgamecategory]/@value", "empty list"), "mechanics": ("link[@type=boardgamemechanic]", "empty list"), "sources": (None, "one entry when ingested"),
}


def field_specs() -> list[FieldSpec]:
    """Every field of a row and of the structs in it."""
    out: list[FieldSpec] = []
    for f in T._parse_datatype_string(GAME_FIELDS).fields:
        path, missing = _ORIGIN[f.name]
        is_list = isinstance(f.dataType, T.ArrayType)
        out.append(FieldSpec("game", f.name, f.dataType.simpleString(), f.name not in ("id", "title") and not is_list, missing, path))
        if is_list and isinstance(f.dataType.elementType, T.StructType):
            out += [FieldSpec(f.name[:-1], g.name, g.dataType.simpleString(), True, "null", None) for g in f.dataType.elementType.fields]
    return out


def drift(df: DataFrame, model: str = "game") -> tuple[list[str], list[str]]:
    """(fields the columns lack, columns the dictionary lacks)."""
    known = {s.name for s in field_specs() if s.model == model}
    return sorted(known - set(df.columns)), sorted(set(df.columns) - known)


def require_no_drift(df: DataFrame, model: str = "game") -> DataFrame:
    missing, extra = drift(df, model)
    if missing or extra:
        raise SchemaDriftError(f"{model}: missing {missing}, extra {extra}")
    return df


def json_schema() -> dict:
    """JSON Schema of a catalog row."""
    plain = {"string": "string", "integer": "integer", "double": "number", "timestamp": "string"}

    def of(kind: T.DataType, nullable: bool) -> dict:
        if isinstance(kind, T.ArrayType):
            return {"type": "array", "items": of(kind.elementType, False)}
        if isinstance(kind, T.StructType):
            return {"type": "object", "additionalProperties": False, "properties": {f.name: of(f.dataType, True) for f in kind.fields}}
        name = plain[kind.typeName()]
        return {"type": [name, "null"] if nullable else name}

    specs = {s.name: s for s in field_specs() if s.model == "game"}
    schema = T._parse_datatype_string(GAME_FIELDS)
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "additionalProperties": False, "required": ["id", "title"], "properties": {f.name: of(f.dataType, specs[f.name].nullable) for f in schema.fields}}


def claims(interpretations: DataFrame, subject: Column, excerpt: Column, pointer: Column | None = None, layer: str = "inferred") -> DataFrame:
    """Interpretations (label, description, extractor) as claims about a stored subject, each with its evidence."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    statement = F.when(text("description").isNotNull(), F.concat_ws(": ", "label", "description")).otherwise(F.col("label"))
    place = F.lit(None).cast("string") if pointer is None else pointer
    evidence = F.array(F.struct(subject.alias("payload_id"), place.alias("pointer"), excerpt.alias("excerpt"), F.col("extractor").alias("method")))
    return interpretations.select(statement.alias("statement"), F.lit(layer).alias("layer"), F.concat(F.lit("extractor:"), text("extractor")).alias("confidence_policy"), subject.alias("subject_payload_id"), evidence.alias("evidence"))


@dataclass(frozen=True)
class CorpusSpec:
    corpus_id: str
    version: str
    ids_file: str

    def ids_sha256(self) -> str:
        return hashlib.sha256(Path(self.ids_file).read_bytes()).hexdigest()


class CorpusRegistry:
    """Corpora by id; a corpus is a frozen list of ids in a file."""

    def __init__(self) -> None:
        self._known: dict[str, CorpusSpec] = {}

    def register(self, corpus_id: str, version: str, ids_file: str) -> CorpusSpec:
        if corpus_id in self._known:
            raise ValueError(f"corpus {corpus_id!r} is there already")
        self._known[corpus_id] = CorpusSpec(corpus_id, version, ids_file)
        return self._known[corpus_id]

    def register_folder(self, folder: str, version: str = "1") -> list[str]:
        """Every *.txt of a folder, named by the file."""
        return [self.register(path.stem, version, str(path)).corpus_id for path in sorted(Path(folder).glob("*.txt"))]

    def __getitem__(self, corpus_id: str) -> CorpusSpec:
        if corpus_id not in self._known:
            raise ValueError(f"no corpus {corpus_id!r}; there are: {', '.join(sorted(self._known)) or 'none'}")
        return self._known[corpus_id]
