"""Per-dimension sums of vector tables.

Each task reduces its rows to one partial row per (group, dimension), so the shuffle carries
groups x dimensions x tasks rows and never the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.functions.vectors import matrix

_PARTIAL = "cluster bigint, dim bigint, n double, s double, m2 double, low double, high double"


def _merge(a: tuple, b: tuple) -> tuple:
    """Combine count, sum, centred squares, minimum and maximum of two row sets."""
    n = a[0] + b[0]
    gap = b[1] / b[0] - a[1] / a[0]
    return n, a[1] + b[1], a[2] + b[2] + gap * gap * a[0] * b[0] / n, np.minimum(a[3], b[3]), np.maximum(a[4], b[4])


def dimension_moments(df: DataFrame, vector: str = "v", by: str | None = None, weight: str | None = None) -> DataFrame:
    """``[cluster,] dim, n, total, centre, m2, variance (sample), low, high``; ``dim`` starts at 1.

    ``by`` is an integer column. ``weight`` multiplies a row (rows of weight 0 are left out).
    """
    columns = [F.col(vector).alias("v"), (F.col(by) if by else F.lit(0)).cast("bigint").alias("g")]
    columns.append((F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values, groups = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            weights = batch.column(2).to_numpy(zero_copy_only=False)
            for g in np.unique(groups):
                pick = (groups == g) & (weights > 0)
                if not pick.any():
                    continue
                x, w = values[pick], weights[pick]
                n, s = w.sum(), w @ x
                part = (n, s, w @ (x - s / n) ** 2, x.min(axis=0), x.max(axis=0))
                found[int(g)] = _merge(found[int(g)], part) if int(g) in found else part
        for g, (n, s, m2, low, high) in found.items():
            d = len(s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(d, g)), pa.array(np.arange(1, d + 1)), pa.array(np.full(d, n)), pa.array(s), pa.array(m2), pa.array(low), pa.array(high)],
                names=["cluster", "dim", "n", "s", "m2", "low", "high"])

    parts = df.select(*columns).mapInArrow(partials, _PARTIAL)
    keys = (["cluster"] if by else []) + ["dim"]
    summed = parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("s").alias("total"), F.sum("m2").alias("__m2"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("__sq"),
        F.min("low").alias("low"), F.max("high").alias("high"))
    m2 = F.greatest(F.col("__m2") + F.col("__sq") - F.col("total") * F.col("total") / F.col("n"), F.lit(0.0))
    out = summed.withColumn("centre", F.col("total") / F.col("n")).withColumn("m2", m2)
    out = out.withColumn("variance", F.try_divide("m2", F.col("n") - 1)).drop("__m2", "__sq")
    return out


def centroids_long(df: DataFrame, vector: str = "v", by: str = "cluster", weight: str | None = None) -> DataFrame:
    """``cluster, dim, centre, n``."""
    return dimension_moments(df, vector, by, weight).select("cluster", "dim", "centre", "n")


def centroids(df: DataFrame, vector: str = "v", by: str = "cluster", weight: str | None = None) -> DataFrame:
    """``cluster, n, centre`` with the centre as an array."""
    long = centroids_long(df, vector, by, weight)
    cells = F.array_sort(F.collect_list(F.struct("dim", "centre")))
    return long.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(cells, lambda c: c["centre"]).alias("centre"))


def bounding_box(df: DataFrame, vector: str = "v") -> DataFrame:
    """``dim, low, high``; a constant dimension is widened by 1e-12."""
    box = dimension_moments(df, vector)
    high = F.when(F.col("high") <= F.col("low"), F.col("low") + F.lit(1e-12)).otherwise(F.col("high"))
    return box.select("dim", "low", high.alias("high"))
