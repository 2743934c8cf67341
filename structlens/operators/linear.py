"""Ridge models from one aggregate pass, prediction as column arithmetic, evaluation, group-safe splits."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RIDGE, PIVOT_FLOOR = 1e-4, 1e-12


#: Up to so many sums are taken as column expressions; wider models are summed as matrices inside the tasks.
MOST_EXPRESSIONS = 64


def gram(df: DataFrame, features: Sequence[Column], targets: Sequence[Column]) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'Y with a leading intercept column, summed in one pass; only (p+1)(p+q) numbers reach the driver. Nulls count for nothing."""
    x = [F.lit(1.0), *[f.cast("double") for f in features]]
    y = [t.cast("double") for t in targets]
    p, q = len(x), len(y)
    if p * (p + q) > MOST_EXPRESSIONS:
        return _wide_gram(df, x, y)
    sums = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)] + [F.sum(x[i] * y[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(q)]
    row = df.agg(*sums).first()
    a, b = np.zeros((p, p)), np.zeros((p, q))
    for i in range(p):
        for j in range(i, p):
            a[i, j] = a[j, i] = row[f"g{i}_{j}"] or 0.0
        for j in range(q):
            b[i, j] = row[f"h{i}_{j}"] or 0.0
    return a, b


def _wide_gram(df: DataFrame, x: Sequence[Column], y: Sequence[Column]) -> tuple[np.ndarray, np.ndarray]:
    """The same by a matrix product per batch, a matrix per task, and a sum per cell of it."""
    p, q = len(x), len(y)
    zero = F.lit(0.0)
    rows = df.select(F.array(*[F.coalesce(c, zero) for c in (*x, *y)]).alias("r"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((p, p + q))
        for batch in batches:
            m = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p + q)
            total += m[:, :p].T @ m
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["m"])

    cells = rows.mapInArrow(products, "m array<double>").select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(p * (p + q))
    for i, v in cells.collect():  # p (p + q) rows
        out[i] = v
    out = out.reshape(p, p + q)
    return out[:, :p], out[:, p:]


def fit_ridge(df: DataFrame, features: Sequence[Column], targets: Sequence[Column], penalty: float = RIDGE) -> np.ndarray:
    """Weights (1 + p, q), the intercept first and penalised like the rest."""
    a, b = gram(df, features, targets)
    a = a + penalty * np.eye(len(a))
    if np.abs(np.linalg.eigvalsh(a)).min() < PIVOT_FLOOR:
        raise ValueError("the normal equations are singular")
    return np.linalg.solve(a, b)


def predict(features: Sequence[Column], weights: np.ndarray) -> list[Column]:
    """One column per target; null features count as 0."""
    out = []
    for w in weights.T:
        total = F.lit(float(w[0]))
        for f, c in zip(features, w[1:], strict=True):
            total = total + F.coalesce(f.cast("double"), F.lit(0.0)) * float(c)
        out.append(total)
    return out


def predict_array(features: Column, weights: np.ndarray) -> Column:
    """All targets of an array of features as an array; null features count as 0."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in w]) for w in weights.T])
    x = F.concat(F.array(F.lit(1.0)), F.transform(features, lambda v: F.coalesce(v.cast("double"), F.lit(0.0))))
    return F.transform(rows, lambda w: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v))


def errors(df: DataFrame, predicted: Column, actual: Column, by: Sequence[str] = ()) -> DataFrame:
    """n, dropped, rmse, mae over rows where both are there."""
    gap = predicted - actual
    return df.groupBy(*by).agg(F.count(gap).alias("n"), F.count_if(gap.isNull()).alias("dropped"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"))


def split_groups(groups: Sequence[str], seed: int, test_size: float) -> tuple[list[str], list[str]]:
    """(train, test) of whole groups: sorted, shuffled by the seed, the first max(1, round(n·test_size)) are test."""
    ordered = sorted(set(groups))
    shuffled = ordered[:]
    random.Random(seed).shuffle(shuffled)
    test = set(shuffled[: max(1, round(len(ordered) * test_size))])
    return [g for g in ordered if g not in test], [g for g in ordered if g in test]


def split_by_hash(df: DataFrame, group: str, seed: int, percent_test: int) -> DataFrame:
    """df with side 'train' or 'test', whole groups on one side, decided from the group alone wherever the row is.

    For groups too many to be listed on the driver.
    """
    digest = F.conv(F.substr(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")), 256), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    return df.withColumn("side", F.when(digest % 100 < percent_test, "test").otherwise("train"))
