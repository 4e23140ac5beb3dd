"""Vector functions on ``array<double>`` columns, and Arrow to numpy conversion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def entropy(p: Column, floor: float = 1e-12) -> Column:
    terms = F.transform(p, lambda x: -x * F.ln(F.least(F.greatest(x, F.lit(floor)), F.lit(1.0))))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def arg_max(v: Column) -> Column:
    """Zero-based position of the first largest component."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def head(v: Column, count: int) -> Column:
    return F.slice(v, 1, count)


def drop_last(v: Column) -> Column:
    return F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0)))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column as a 2-D float64 array. Null rows and rows of unequal length are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if column.null_count:
        raise ValueError(f"{column.null_count} of {rows} vectors are null")
    widths = pc.min_max(pc.list_value_length(column)).as_py()
    if widths["min"] != widths["max"]:
        raise ValueError(f"vectors have between {widths['min']} and {widths['max']} components")
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def list_array(values: np.ndarray) -> pa.Array:
    """2-D array as an Arrow ``list<double>`` column."""
    rows, width = values.shape
    offsets = np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


# Numbers of one strip of a distance block.
STRIP_NUMBERS = 1 << 16


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distance block between the rows of ``a`` and the rows of ``b``."""
    if metric == "cosine":
        left = np.linalg.norm(a, axis=1)
        right = np.linalg.norm(b, axis=1)
        scale = np.outer(np.where(left > 0, left, 1.0), np.where(right > 0, right, 1.0))
        return np.clip(1.0 - (a @ b.T) / scale, 0.0, 2.0)
    # Centring keeps the expanded form accurate for far-away data.
    centre = a.mean(axis=0) if len(a) else 0.0
    a, b = a - centre, b - centre
    own, other, turned = (a * a).sum(axis=1), (b * b).sum(axis=1), b.T
    out = np.empty((len(a), len(b)))
    # A strip of rows at a time stays in the processor's cache.
    step = max(16, STRIP_NUMBERS // max(1, len(b)))
    for low in range(0, len(a), step):
        squared = out[low : low + step]
        product = a[low : low + step] @ turned
        product *= 2.0
        np.add.outer(own[low : low + step], other, out=squared)
        squared -= product
        # The expanded form loses small distances to cancellation: redo those exactly.
        if squared.size and squared.min() <= 1e-6 * (own[low : low + step].max() + other.max()):
            near_row, near_col = np.nonzero(squared <= 1e-6 * np.add.outer(own[low : low + step], other))
            for start in range(0, len(near_row), 65536):
                i, j = near_row[start : start + 65536], near_col[start : start + 65536]
                squared[i, j] = ((a[low + i] - b[j]) ** 2).sum(axis=1)
        np.maximum(squared, 0.0, out=squared)
        np.sqrt(squared, out=squared)
    return out


def fused_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean ``distances`` for sums and extremes: one product gives the squares, so equal pairs may differ in the last bits."""
    centre = a.mean(axis=0) if len(a) else 0.0
    a, b = a - centre, b - centre
    own, other = (a * a).sum(axis=1), (b * b).sum(axis=1)
    left = np.concatenate([a, own[:, None], np.ones((len(a), 1))], axis=1)
    right = np.concatenate([-2.0 * b, np.ones((len(b), 1)), other[:, None]], axis=1).T
    out = np.empty((len(a), len(b)))
    step = max(16, STRIP_NUMBERS // max(1, len(b)))
    for low in range(0, len(a), step):
        squared = out[low : low + step]
        np.matmul(left[low : low + step], right, out=squared)
        if squared.size and squared.min() <= 1e-6 * (own[low : low + step].max() + other.max()):
            near_row, near_col = np.nonzero(squared <= 1e-6 * np.add.outer(own[low : low + step], other))
            for start in range(0, len(near_row), 65536):
                i, j = near_row[start : start + 65536], near_col[start : start + 65536]
                squared[i, j] = ((a[low + i] - b[j]) ** 2).sum(axis=1)
        np.sqrt(squared, out=squared)
    return out
