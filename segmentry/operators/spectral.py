"""Spectral embedding of a nearest-neighbour graph by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.functions.hashing import uniform
from segmentry.operators.kmeans import Fit, lloyd, plus_plus_seeds
from segmentry.operators.pairs import BROADCAST_BYTES, self_knn
from segmentry.session import cut_lineage


def neighbour_graph(df: DataFrame, neighbours: int = 20) -> DataFrame:
    """Symmetric connectivity ``src, dst, w``: the mean of both directions of the neighbour lists (self included)."""
    near = self_knn(df, neighbours).select(F.col("row_id").alias("src"), F.col("neighbour").alias("dst"))
    both = near.withColumn("w", F.lit(0.5)).unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.5).alias("w")))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def spectral_embedding(graph: DataFrame, k: int, seed: int, rounds: int = 60, degree: int = 12, guard: int = 3, tolerance: float = 1e-3) -> DataFrame:
    """``row_id, v``: the k leading eigenvectors of the normalised adjacency, divided by the root degree.

    A round filters a block of ``k + guard`` columns by a Chebyshev polynomial that is small on the part of the spectrum
    below the block and grows steeply above it; one degree is a join of the edges with the current vectors and a sum per
    source. The edges lie by source, so with vectors of up to ``BROADCAST_BYTES`` a degree shuffles sums of rows, not edges. A Rayleigh-Ritz step then turns the block to its best eigenvectors, with products of columns the only thing on the
    driver. Rounds end when the residuals of the k columns are all at most ``tolerance``; a block that has not
    settled after ``rounds`` is an error. Eigenvalues that are as large as those of the guard columns are told apart by chance.
    """
    weight = graph.groupBy("src").agg(F.sum("w").alias("d"))
    left = weight.select("src", F.col("d").alias("ds"))
    right = weight.select(F.col("src").alias("dst"), F.col("d").alias("dd"))
    edges = graph.join(left, "src").join(right, "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("w"))
    edges = cut_lineage(edges.repartition("src").sortWithinPartitions("src"))
    rows = weight.count()
    names = [f"u{i}" for i in range(min(k + guard, rows))]
    small = rows * (len(names) + 1) * 8 <= BROADCAST_BYTES
    if len(names) < k:
        raise ValueError(f"{k} eigenvectors of {len(names)} rows")
    # The first eigenvector is known up to scale: the root degree. The others start from hashed numbers.
    start = [F.sqrt("d").alias("u0")] + [(uniform(seed, "spectral", i, F.col("src")) - 0.5).alias(f"u{i}") for i in range(1, len(names))]
    block = cut_lineage(weight.select(F.col("src").alias("row_id"), *start))
    block, values, residual = _ritz(edges, block, names, small)
    for _ in range(rounds):
        if residual[:k].max() <= tolerance:
            break
        block, values, residual = _ritz(edges, _filtered(edges, block, names, float(values[-1]), degree, small), names, small)
    if residual[:k].max() > tolerance:
        raise RuntimeError(f"spectral embedding not converged: residual {residual[:k].max():.1e} after {rounds} rounds of {degree} steps")
    scaled = block.join(weight.withColumnRenamed("src", "row_id"), "row_id")
    return scaled.select("row_id", F.array(*[F.col(u) / F.sqrt("d") for u in names[:k]]).alias("v"))


def _heard(edges: DataFrame, block: DataFrame, names: list[str], small: bool = False) -> DataFrame:
    """``block`` with the product of the adjacency and each of its columns beside them; vectors of a ``small`` one travel to the edges."""
    vectors = block.select(F.col("row_id").alias("dst"), *names)
    sums = edges.join(F.broadcast(vectors) if small else vectors, "dst").groupBy(F.col("src").alias("row_id")).agg(*[F.sum(F.col("w") * F.col(u)).alias(f"__{u}") for u in names])
    return block.join(sums, "row_id", "left").fillna(0.0, [f"__{u}" for u in names])


def _filtered(edges: DataFrame, block: DataFrame, names: list[str], upper: float, degree: int, small: bool) -> DataFrame:
    """The block under the Chebyshev polynomial of ``degree`` that stays within 1 on [-1, upper]."""
    centre, half = (upper - 1.0) / 2, max((upper + 1.0) / 2, 1e-3)
    last = [f"p{u}" for u in names]
    state = block.select("row_id", *names, *[F.lit(0.0).alias(p) for p in last])
    for step in range(degree):
        scale = (1.0 if step == 0 else 2.0) / half
        new = [(scale * (F.col(f"__{u}") - centre * F.col(u)) - F.col(p)).alias(u) for u, p in zip(names, last)]
        # A step reads the last one twice.
        state = cut_lineage(_heard(edges, state, names, small).select("row_id", *new, *[F.col(u).alias(p) for u, p in zip(names, last)]))
    return state.select("row_id", *names)


def _ritz(edges: DataFrame, block: DataFrame, names: list[str], small: bool) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The block turned to its Ritz vectors of unit length, their values (falling) and residuals."""
    heard = cut_lineage(_heard(edges, block, names, small))
    n = len(names)
    both = [*names, *[f"__{u}" for u in names]]
    cells = [(i, j) for i in range(2 * n) for j in range(i + 1)]
    row = heard.agg(*[F.sum(F.col(both[i]) * F.col(both[j])).alias(f"g{i}_{j}") for i, j in cells]).first()
    gram = np.zeros((2 * n, 2 * n))
    for i, j in cells:
        gram[i, j] = gram[j, i] = row[f"g{i}_{j}"]
    own, cross, square = gram[:n, :n], gram[:n, n:], gram[n:, n:]
    length = np.sqrt(np.diag(own))
    scaled = own / np.outer(length, length)
    lean = np.linalg.inv(np.linalg.cholesky(scaled + 1e-13 * np.eye(n))).T / length[:, None]
    small = lean.T @ ((cross + cross.T) / 2) @ lean
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)
    turn, values = lean @ turn[:, order], values[order]
    # |A x - value x|^2 from the products of the columns.
    residual = np.sqrt(np.maximum(np.diag(turn.T @ square @ turn) - 2 * values * np.diag(turn.T @ cross @ turn) + values**2 * np.diag(turn.T @ own @ turn), 0.0))

    def mixed(j: int) -> Column:
        return reduce(lambda a, b: a + b, [F.col(names[i]) * float(turn[i, j]) for i in range(n)])

    return cut_lineage(heard.select("row_id", *[mixed(j).alias(names[j]) for j in range(n)])), values, residual


def spectral(df: DataFrame, k: int, seed: int, neighbours: int = 20, n_init: int = 10, graph: DataFrame | None = None) -> tuple[DataFrame, Fit]:
    """``row_id, v`` spectral rows and the best k-means fit on them."""
    graph = cut_lineage(neighbour_graph(df, neighbours)) if graph is None else graph
    embedded = cut_lineage(spectral_embedding(graph, k, seed))
    fits = lloyd(embedded, plus_plus_seeds(embedded, [k] * n_init, seed))
    return embedded, min(fits, key=lambda f: f.inertia)
