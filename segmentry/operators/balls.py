"""A ball index: pairs of rows that the triangle inequality rules out are never brought together.

A bounded number of rows, chosen by hash, are pivots. A row belongs to the ball of its nearest pivot; a ball knows its
radius and its number of rows. The distance of a row to all rows of a ball is at least its distance to the pivot less the
radius, so a row is sent to a ball only if that lower bound does not exceed what still matters: a given radius, the row's
(or the ball's) k-th nearest distance so far, or the heaviest edge of a path that already links the two. Large balls are
split into parts by hash, so a cell stays bounded, and also a group of equal vectors is shared by many tasks.

Only pivots, radii and row counts are on the driver and broadcast; ``PIVOTS`` and ``PIVOT_BYTES`` bound them whatever the
table. Results do not depend on the choice of pivots. In many dimensions without groups nearly no ball is ruled out,
and the work is that of all pairs.

Defined results: a table without rows has no balls and no cells; repeated vectors share a ball of radius 0; null vectors
and vectors of unequal length raise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from segmentry.functions.vectors import distances, matrix
from segmentry.session import cut_lineage

BALL_ROWS = 128
PIVOTS = 2048
PIVOT_BYTES = 32 << 20
# Numbers of one block of distances inside a task.
BLOCK_NUMBERS = 1 << 21
# Distances are exact to about 1e-9 of their size; bounds give way by more.
SLACK = 1e-6


@dataclass(frozen=True)
class Balls:
    """``rows`` with ``__ball`` and ``__own`` (distance to its pivot); per ball: pivot, radius, rows, parts, number of its first part."""

    rows: DataFrame
    pivots: np.ndarray
    pivot_ids: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    parts: np.ndarray
    first: np.ndarray
    give: float  # what rounding may add to a distance between rows far from the origin of their block


def build(df: DataFrame, keep: Sequence[str], part_rows: int, count: int, ball_rows: int = BALL_ROWS) -> Balls:
    """The index of ``row_id, v`` and the columns ``keep``: one pass that chooses pivots, one that places the rows."""
    plain = df.select(
        F.col("row_id").cast("bigint").alias("row_id"), F.col("v").cast("array<double>").alias("v"), *keep,
        F.pmod(F.xxhash64("row_id", F.lit("part")), F.lit(1 << 30)).cast("int").alias("__h"))
    width = plain.select(F.size("v").alias("d")).first()["d"]
    wanted = max(1, min(-(-count // ball_rows), PIVOTS, PIVOT_BYTES // (8 * max(1, width))))
    chosen = plain.select("row_id", "v").orderBy(F.xxhash64("row_id", F.lit("pivot")), "row_id").limit(wanted).toArrow()
    points = matrix(chosen.column("v"))
    _, once = np.unique(points, axis=0, return_index=True)
    pivots, ids = points[once], chosen.column("row_id").to_numpy()[once]
    placed = cut_lineage(_nearest(plain, pivots))
    found = placed.groupBy("__ball").agg(F.count(F.lit(1)).alias("n"), F.max("__own").alias("r")).toArrow()
    size, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    ball = found.column("__ball").to_numpy()
    size[ball], radius[ball] = found.column("n").to_numpy(), found.column("r").to_numpy()
    parts = -(-size // part_rows)
    extent = np.abs(pivots - pivots.mean(axis=0)).sum(axis=1).max() + radius.max()
    return Balls(placed, pivots, ids, radius, size, parts, np.cumsum(parts) - parts, float(extent) * 1e-12)


def _nearest(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    schema = StructType(df.schema.fields + [StructField("__ball", IntegerType()), StructField("__own", DoubleType())])
    where = df.columns.index("v")
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(where))
            ball, own = np.empty(len(x), np.int32), np.empty(len(x))
            for rows, d in pivot_distances(x, shared.value):
                ball[rows] = d.argmin(axis=1)
                own[rows] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball), pa.array(own)], names=[*batch.schema.names, "__ball", "__own"])

    return df.mapInArrow(run, schema)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Slices of rows with their distances to all pivots, a bounded block at a time."""
    step = max(1, BLOCK_NUMBERS // max(1, len(pivots)))
    for start in range(0, len(x), step):
        rows = slice(start, min(start + step, len(x)))
        yield rows, distances(pivots, x[rows]).T


Reach = Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray]], np.ndarray]


def runs(index: Balls, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``(spots, groups)``: per part its place in an order in which near balls follow each other, and its group, a run of about equal rows."""
    m = len(index.pivots)
    order = np.concatenate([[0], dense_tree(distances(index.pivots, index.pivots))[1]]) if m > 1 else np.arange(m)
    parts = np.concatenate([index.first[b] + np.arange(index.parts[b]) for b in order]).astype(np.int64)
    rows = np.repeat(index.size / np.maximum(index.parts, 1), index.parts)[parts]
    spots, groups = np.empty(len(parts), np.int32), np.empty(len(parts), np.int32)
    spots[parts] = np.arange(len(parts))
    groups[parts] = np.minimum((np.cumsum(rows) - rows / 2) * count / max(1.0, rows.sum()), count - 1).astype(np.int32)
    return spots, groups


def cells(
    index: Balls, keep: Sequence[str], limit: Reach, state: object, rows: DataFrame | None = None, placed: tuple[np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """Rows at every cell they take part in: ``row_id, v``, ``keep``, ``__i <= __j`` (parts) and ``__side``.

    With ``placed``, the result of ``runs``, cells are pairs of groups and rows also have ``__spot``, the place of their part.

    ``limit(state, ball, columns)`` gives, for rows of the given balls, the largest distance (rows x balls) that matters
    between a row and each ball; it has to be no smaller than what the rows of that ball allow in return.
    ``state`` is broadcast with the index.
    """
    rows = index.rows if rows is None else rows
    where, names = rows.columns.index("v"), [c for c in rows.columns if c != "v"]
    holds = None
    if placed:
        # Groups that hold a part of a ball.
        holds = np.zeros((len(index.pivots), int(placed[1].max(initial=0)) + 1), np.float32)
        holds[np.repeat(np.arange(len(index.pivots)), index.parts), placed[1]] = 1.0
    shared = rows.sparkSession.sparkContext.broadcast((index.pivots, index.radius, index.parts, index.first, index.give, state, placed, holds))
    added = ["__spot", "__own_part", "__parts"] if placed else ["__own_part", "__parts"]
    schema = StructType(rows.schema.fields + [StructField(c, ArrayType(IntegerType()) if c == "__parts" else IntegerType()) for c in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius, parts, first, give, held, places, groups = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(where))
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            for taken, d in pivot_distances(x, pivots):
                own = {c: v[taken] for c, v in columns.items()}
                ball = own["__ball"]
                near = d * (1 - SLACK) <= (radius[None, :] + limit(held, ball, own)) * (1 + SLACK) + give
                near[np.arange(len(ball)), ball] = True
                near &= (parts > 0)[None, :]
                mine = (first[ball] + own["__h"] % np.maximum(parts[ball], 1)).astype(np.int32)
                piece = batch.slice(taken.start, taken.stop - taken.start)
                if places:
                    who, other = np.nonzero(near.astype(np.float32) @ groups > 0)
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(ball)))]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(other.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(places[0][mine]), pa.array(places[1][mine]), lists], names=[*batch.schema.names, *added])
                    continue
                who, other = np.nonzero(near)
                times = parts[other]
                start = np.cumsum(times) - times
                part = np.repeat(first[other] - start, times) + np.arange(int(times.sum()))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(who, weights=times, minlength=len(ball)))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(mine), lists], names=[*batch.schema.names, *added])

    spread = rows.mapInArrow(run, schema).withColumn("__o", F.explode("__parts"))
    return spread.select(
        "row_id", "v", *keep, F.least("__own_part", "__o").alias("__i"), F.greatest("__own_part", "__o").alias("__j"),
        (F.col("__own_part") > F.col("__o")).cast("int").alias("__side"))


def within(eps: float) -> tuple[Reach, object]:
    """Pairs within a fixed distance."""
    return (lambda eps, ball, own: np.full((len(ball), 1), eps)), float(eps)


def count_bounds(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """An upper bound of the k-th smallest distance per row, from the sizes of whole balls (infinite if all hold fewer)."""
    bound = np.empty(len(x))
    for rows, d in pivot_distances(x, pivots):
        far = d * (1 + SLACK) + radius[None, :]
        order = np.argsort(far, axis=1)
        held = np.cumsum(size[order], axis=1)
        at = (held < k).sum(axis=1)
        enough = at < len(pivots)
        value = np.take_along_axis(far, np.take_along_axis(order, np.minimum(at, len(pivots) - 1)[:, None], 1), 1)[:, 0]
        bound[rows] = np.where(enough, value, np.inf)
    return bound


def neighbour_reach(index: Balls, k: int, include_self: bool) -> tuple[DataFrame, tuple[Reach, object]]:
    """Rows with ``__tau``, at least their k-th nearest distance, and the reach that follows from it.

    The bound is the k-th nearest inside the row's own part or what whole balls around it guarantee. A ball reaches as
    far as the row of its that knows least.
    """
    rows = index.rows
    shared = rows.sparkSession.sparkContext.broadcast((index.pivots, index.radius, index.size, index.give))
    parts = F.expr(f"array({', '.join(map(str, index.parts))})")
    placed = rows.withColumn("__part", F.col("__h") % F.get(parts, F.col("__ball")))
    schema = StructType(rows.schema.fields + [StructField("__tau", DoubleType())])
    need, names = k if include_self else k + 1, rows.columns

    def run(part: pa.Table) -> pa.Table:
        pivots, radius, size, give = shared.value
        x = matrix(part.column("v"))
        tau = count_bounds(x, pivots, radius, size, need)
        if len(x) >= need:
            tau = np.minimum(tau, np.partition(distances(x, x), need - 1, axis=1)[:, need - 1] * (1 + SLACK))
        tau += give
        return part.select(names).append_column("__tau", pa.array(tau))

    bounded = cut_lineage(placed.groupBy("__ball", "__part").applyInArrow(run, schema))
    most = bounded.groupBy("__ball").agg(F.max("__tau").alias("t")).toArrow()
    least_known = np.zeros(len(index.pivots))
    least_known[most.column("__ball").to_numpy()] = most.column("t").to_numpy()
    return bounded, (lambda far, ball, own: np.maximum(own["__tau"][:, None], far[None, :]), least_known)


def tree_reach(index: Balls, core: str | None) -> tuple[Reach, object]:
    """Pairs that may be an edge of a minimum spanning tree.

    Each row is linked to its pivot and the pivots by their own spanning tree. A pair heavier than the heaviest edge of that
    path between its ends closes a cycle as its heaviest edge and is left out; equal weights stay. With ``core`` the
    weights are mutual reachability distances.
    """
    m = len(index.pivots)
    w = distances(index.pivots, index.pivots)
    reach = index.radius.copy()
    cores = np.zeros(m)
    if core:
        named = index.rows.filter(F.col("row_id").isin([int(i) for i in index.pivot_ids])).select("row_id", core).toArrow()
        known = dict(zip(named.column("row_id").to_pylist(), named.column(core).to_pylist()))
        cores = np.array([known[int(i)] for i in index.pivot_ids], dtype=np.float64)
        most = index.rows.groupBy("__ball").agg(F.max(core).alias("c")).toArrow()
        ball = most.column("__ball").to_numpy()
        reach[ball] = np.maximum(reach[ball], most.column("c").to_numpy())
        reach = np.maximum(reach, cores)
        w = np.maximum(w, np.maximum(cores[:, None], cores[None, :]))
    a, b, weight = dense_tree(w)
    path = np.zeros((m, m))
    group = {i: np.array([i]) for i in range(m)}
    name = np.arange(m)
    for i in np.argsort(weight, kind="stable"):
        left, right = group[name[a[i]]], group.pop(name[b[i]])
        path[np.ix_(left, right)] = path[np.ix_(right, left)] = weight[i]
        name[right] = name[a[i]]
        group[name[a[i]]] = np.concatenate([left, right])
    # What the rows of both balls need at most, so that both ends of a pair come to the cell.
    path = np.maximum(path, reach[None, :])
    core_of = core

    def limit(held: tuple[np.ndarray, np.ndarray], ball: np.ndarray, own: dict[str, np.ndarray]) -> np.ndarray:
        table, centre = held
        mine = np.maximum(own["__own"], centre[ball])
        if core_of:
            mine = np.maximum(mine, own[core_of])
        return np.maximum(table[ball], mine[:, None])

    return limit, (path, cores)


def dense_tree(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges ``(a, b, weight)`` of a minimum spanning tree of a dense graph."""
    n = len(w)
    best, parent = w[0].copy(), np.zeros(n, dtype=np.int64)
    outside = np.ones(n, dtype=bool)
    outside[0] = False
    a, b, weight = np.empty(n - 1, np.int64), np.empty(n - 1, np.int64), np.empty(n - 1)
    for step in range(n - 1):
        j = int(np.argmin(np.where(outside, best, np.inf)))
        a[step], b[step], weight[step] = parent[j], j, best[j]
        outside[j] = False
        closer = w[j] < best
        best = np.where(closer, w[j], best)
        parent = np.where(closer, j, parent)
    return a, b, weight


def pair_load(placed: DataFrame) -> int:
    """Pairs of rows that the cells compare, for a look at what the bounds leave out."""
    sides = placed.groupBy("__i", "__j").agg(F.count(F.lit(1)).alias("n"), F.sum("__side").alias("right"))
    pairs = F.when(F.col("__i") == F.col("__j"), F.col("n") * (F.col("n") - 1) / 2).otherwise((F.col("n") - F.col("right")) * F.col("right"))
    return int(sides.agg(F.coalesce(F.sum(pairs), F.lit(0))).first()[0])
