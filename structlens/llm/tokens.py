"""Token counts of whole texts with a public byte-pair vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structlens.storage import spread

#: The split pattern published with the 50k byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Session setting and default of the rank file's place.
SETTING, DEFAULT = "structlens.tokenizer.ranks", "/opt/tokenizers/byte_bpe_50k.tiktoken"


def rank_file(spark: SparkSession) -> str:
    return spark.conf.get(SETTING, DEFAULT)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer, loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, keep: dict[str, Column], text: str, path: str) -> DataFrame:
    """The kept columns and tokens BIGINT of each row's whole text; null and empty texts have 0 tokens."""
    slim = spread(df.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("_text")))
    names = list(keep)
    width = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(width)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(width)], pa.array(sizes, pa.int64())], names=[*names, "tokens"])

    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text")
    return slim.mapInArrow(count, f"{typed}, tokens bigint")
