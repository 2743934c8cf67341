"""Scalar derivations as Column builders; null in, null out unless stated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PROFILES = ("two_only", "upto_four", "five_plus", "unknown")
KINDS = ("point", "range", "unknown")
ERAS = ("pre_1970", "1970_1994", "1995_2009", "2010_2016", "2017_plus", "unknown")


def interval_profile(low: Column, high: Column) -> Column:
    """unknown if a bound is null, two_only for (2, 2), five_plus from a high of 5 on, else upto_four; in this order."""
    return F.when(low.isNull() | high.isNull(), "unknown").when((low == 2) & (high == 2), "two_only").when(high >= 5, "five_plus").otherwise("upto_four")


def interval_kind(low: Column, high: Column) -> Column:
    return F.when(low.isNull() | high.isNull(), "unknown").when(low == high, "point").otherwise("range")


def midpoint(low: Column, high: Column) -> Column:
    return (low + high) / F.lit(2.0)


def era(year: Column) -> Column:
    return F.when(year.isNull(), "unknown").when(year < 1970, "pre_1970").when(year < 1995, "1970_1994").when(year < 2010, "1995_2009").when(year < 2017, "2010_2016").otherwise("2017_plus")


def log_positive(x: Column) -> Column:
    """Natural logarithm, null at 0 and below."""
    return F.when(x > 0, F.ln(x))


def number_or_null(x: Column) -> Column:
    """NaN as null."""
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def whole_or_null(text: Column, keep_zero: bool = False) -> Column:
    """Text as INT; blank and unreadable text is null, and 0 too unless kept."""
    value = F.trim(text).try_cast("int")
    return value if keep_zero else F.nullif(value, F.lit(0))


def gated(value: Column, votes: Column) -> Column:
    """value where there are votes, else null."""
    return F.when(votes > 0, value)


def rounded(x: Column, places: int = 6) -> Column:
    """Half up, by the same arithmetic in every engine."""
    scale = 10.0**places
    return F.floor(x * scale + 0.5) / scale


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_vector(token: Column, dim: int) -> Column:
    """Component i is byte i mod 32 of the token's SHA-256, mapped from 0..255 to -1..1."""
    places = [i % 32 for i in range(dim)]
    # seven bytes are the most that a positive BIGINT holds
    sevens = lambda digest: F.array(*[F.conv(F.substr(digest, F.lit(14 * k + 1), F.lit(14)), 16, 10).cast("bigint") for k in range(max(places) // 7 + 1)])
    byte = lambda words, i: F.shiftright(F.get(words, F.lit(i // 7)), 8 * (min(6, 31 - i // 7 * 7) - i % 7)).bitwiseAND(F.lit(255))
    return bound(bound(F.sha2(token, 256), sevens), lambda words: F.array(*[byte(words, i).cast("double") / 127.5 - 1.0 for i in places]))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos, null where a vector is zero."""
    return 1.0 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def jaccard_distance(a: Column, b: Column) -> Column:
    """0 for two empty sets."""
    united = F.size(F.array_union(a, b))
    return F.when(united == 0, 0.0).otherwise(1.0 - F.size(F.array_intersect(a, b)) / united.cast("double"))


def lineage_id(ids: Column) -> Column:
    """One id stands for itself, several for the SHA-256 of their sorted distinct JSON list."""
    distinct = F.array_sort(F.array_distinct(ids))
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).when(F.size(distinct) > 1, F.sha2(F.to_json(distinct), 256))
