"""Work on all pairs of rows without ever writing the pairs.

Rows are hashed into at most ``BLOCKS`` blocks (more only where a block would outgrow ``BLOCK_BYTES``). Every pair of blocks is
one cell, which receives the rows of its two blocks through an ordinary grouped shuffle, so a row travels once per block and
the shuffle grows with the rows, not with the pairs. Inside a cell numpy goes through pairs of tiles of ``BLOCK_ROWS`` rows and
keeps running results (sums per row and cluster, nearest neighbours, a spanning forest), which Spark then combines. No pair
leaves a task.
Measures over all distances (sums, diameters) are quadratic in rows by nature, so at cluster scale these run on an
evaluation sample or on many cells at once. What only close pairs decide (nearest neighbours, rows within a radius, spanning
trees) goes through the ball index of ``balls`` for tables above ``PLAIN_ROWS``: blocks are runs of neighbouring balls, rows are
not sent to blocks they have no close pair with, and tiles too far apart are not compared. Either way the result is exact for
the rows given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from segmentry.functions.vectors import STRIP_NUMBERS, distances, fused_distances, matrix
from segmentry.operators import balls

BLOCK_ROWS = 1024
# Blocks of a table, and the bytes of vectors in one block beyond which there are more of them.
BLOCKS = 12
BLOCK_BYTES = 64 << 20
# Tables up to this size are compared block by block, as building an index costs more than it leaves out.
PLAIN_ROWS = 4096
# Query sets up to this size travel to every task; larger ones go through cells.
BROADCAST_BYTES = 64 << 20


class Side:
    """Rows of one block inside a cell, or of one tile of it. Tiles are ordered by row id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, extra: dict[str, np.ndarray], at: np.ndarray):
        self.ids, self.x, self.extra, self.at = ids, x, extra, at

    @classmethod
    def of(cls, part: pa.Table) -> Side:
        extra = {c: part.column(c).to_numpy() for c in part.column_names if c not in ("row_id", "v", "__i", "__j", "__side")}
        ids = part.column("row_id").to_numpy()
        return cls(ids, matrix(part.column("v")), extra, np.arange(len(ids)))

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at: np.ndarray) -> Side:
        return Side(self.ids[at], self.x[at], {c: v[at] for c, v in self.extra.items()}, at)

    def tiles(self) -> list[Side]:
        """Runs of neighbouring rows (by row id where no index placed them), each ordered by row id."""
        order = np.lexsort((self.ids, self.extra["__spot"])) if "__spot" in self.extra else np.argsort(self.ids, kind="stable")
        pieces = [order[i : i + BLOCK_ROWS] for i in range(0, len(order), BLOCK_ROWS)]
        return [self.take(p[np.argsort(self.ids[p], kind="stable")]) for p in pieces]


Kernel = Callable[[Side, "Side | None"], dict[str, np.ndarray]]


def block_count(df: DataFrame, block_rows: int | None = None, rows: int | None = None) -> int:
    """At most ``BLOCKS`` blocks of at least about ``block_rows`` rows, and enough of them to keep every core busy; more where one would outgrow ``BLOCK_BYTES``."""
    rows = df.count() if rows is None else rows
    cores = df.sparkSession.sparkContext.defaultParallelism
    busy = int(np.ceil(np.sqrt(2 * cores)))
    blocks = max(1, min(int(np.ceil(rows / (block_rows or BLOCK_ROWS))), BLOCKS), min(busy, rows // 64))
    if rows > BLOCKS * BLOCK_ROWS:
        width = df.select(F.size("v").alias("d")).first()["d"]
        blocks = max(blocks, -(-rows * max(1, width) * 8 // BLOCK_BYTES))
    return blocks


def cell_map(df: DataFrame, kernel: Kernel, schema: str, keep: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Run ``kernel(left, right)`` on every cell; ``right`` is None on the diagonal.

    ``df`` has ``row_id`` (bigint), ``v`` and the numeric columns named in ``keep``.
    """
    blocks = blocks or block_count(df)
    mine = F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int")
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    placed = df.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("v").cast("array<double>").alias("v"), *keep)
    placed = placed.withColumn("__b", mine).withColumn("__o", F.explode(others))
    placed = placed.select(
        "row_id", "v", *keep, F.least("__b", "__o").alias("__i"), F.greatest("__b", "__o").alias("__j"),
        (F.col("__b") > F.col("__o")).cast("int").alias("__side"))
    return _run_cells(placed, kernel, schema)


def _run_cells(placed: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(cell: pa.Table) -> pa.Table:
        side = cell.column("__side").to_numpy()
        left = Side.of(cell.filter(pa.array(side == 0)))
        right = Side.of(cell.filter(pa.array(side == 1))) if cell.column("__i")[0] != cell.column("__j")[0] else None
        found = kernel(left, right)
        return pa.table({n: found[n] for n in names})

    return placed.groupBy("__i", "__j").applyInArrow(run, schema)


def _index_cells(index: balls.Balls, keep: Sequence[str], limit: balls.Reach, state: object, count: int, rows: DataFrame | None = None) -> DataFrame:
    """The rows of an index at the cells of its blocks, with ``__spot``, the place of their ball's part."""
    spots, groups = balls.runs(index, block_count(index.rows, rows=count))
    return balls.cells(index, [*keep, "__spot"], limit, state, rows, (spots, groups))


def close_map(df: DataFrame, kernel: Kernel, schema: str, eps: float, keep: Sequence[str] = ()) -> DataFrame:
    """``cell_map`` for kernels that only pairs within ``eps`` matter to."""
    count = df.count()
    if count <= PLAIN_ROWS:
        return cell_map(df, kernel, schema, keep, block_count(df, rows=count))
    index = balls.build(df, keep, BLOCK_ROWS, count)
    return _run_cells(_index_cells(index, keep, *balls.within(eps), count), kernel, schema)


def _tile_pairs(left: Side, right: Side | None, reach: Callable[[Side, Side], float] | None = None) -> Iterator[tuple[Side, Side]]:
    """Pairs of tiles of a cell, the same object twice for a tile with itself. Tiles whose rows are all farther apart than ``reach`` are left out."""
    first = left.tiles()
    second = first if right is None else right.tiles()
    balls_of = {}
    if reach is not None:
        for t in {id(t): t for t in (*first, *second)}.values():
            centre = t.x.mean(axis=0)
            balls_of[id(t)] = centre, float(np.sqrt(((t.x - centre) ** 2).sum(axis=1).max())), float(np.abs(t.x).max(initial=0.0))
    for i, a in enumerate(first):
        for b in second[i:] if right is None else second:
            if reach is not None and a is not b:
                (ca, ra, ma), (cb, rb, mb) = balls_of[id(a)], balls_of[id(b)]
                apart = float(np.sqrt(((ca - cb) ** 2).sum()))
                if apart * (1 - balls.SLACK) > (ra + rb + reach(a, b)) * (1 + balls.SLACK) + (ma + mb) * 1e-9:
                    continue
            yield a, b


def _both_ways(left: Side, right: Side | None, reach: Callable[[Side, Side], float] | None = None) -> Iterator[tuple[Side, Side, np.ndarray, bool, bool]]:
    """(rows, others, distance block, same tile, rows are of the left block) seen from each side of a cell's tile pairs."""
    for a, b in _tile_pairs(left, right, reach):
        d = distances(a.x, b.x)
        yield a, b, d, a is b, True
        if a is not b:
            yield b, a, d.T, False, right is None


def _inside(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Whether rows are within ``eps``: squared distances, those that rounding may have put on either side taken anew from the differences."""
    centre = a.mean(axis=0)
    near, far = a - centre, b - centre
    own, other = (near * near).sum(axis=1), (far * far).sum(axis=1)
    edge = eps * eps
    band = 4e-6 * edge + 1e-6 * min(edge, 1.0) + 1e-9 * (own.max() + other.max())
    inside, turned = np.empty((len(a), len(b)), dtype=bool), far.T
    step = max(16, STRIP_NUMBERS // max(1, len(b)))
    for low in range(0, len(a), step):
        squared = near[low : low + step] @ turned
        squared *= -2.0
        squared += own[low : low + step, None]
        squared += other
        close = np.less_equal(squared, edge + band, out=inside[low : low + step])
        row, col = np.nonzero(close)
        unsure = squared[row, col] >= edge - band
        row, col = row[unsure], col[unsure]
        for start in range(0, len(row), 65536):
            i, j = row[start : start + 65536], col[start : start + 65536]
            close[i, j] = np.sqrt(((a[low + i] - b[j]) ** 2).sum(axis=1)) <= eps
    return inside


def _stack(parts: list[dict[str, np.ndarray]], types: dict[str, type]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]).astype(t) if parts else np.array([], dtype=t) for c, t in types.items()}


def cluster_distance_sums(df: DataFrame, candidates: Sequence[str], metric: str = "euclidean") -> DataFrame:
    """``row_id, candidate, other, total``: summed distance from each row to each cluster of each labeling.

    ``candidates`` are integer label columns of ``df``; labels below 0 are left out.
    """

    def kernel(left: Side, right: Side | None) -> dict[str, np.ndarray]:
        whole = {True: left} if right is None else {True: left, False: right}
        groups = {way: [np.unique(v[v >= 0]) for v in (rows.extra[c] for c in candidates)] for way, rows in whole.items()}
        # What the rows of a block meet: the labels of the other one (of their own on the diagonal).
        met = {way: groups[way if right is None else not way] for way in whole}
        total = {way: np.zeros((len(rows), sum(map(len, met[way])))) for way, rows in whole.items()}
        marks: dict[int, np.ndarray] = {}

        def marked(tile: Side, way: bool) -> np.ndarray:
            """Membership of the rows of a tile in all clusters of its block, side by side for all labelings."""
            if id(tile) not in marks:
                marks[id(tile)] = np.concatenate([(tile.extra[c][:, None] == g[None, :]).astype(np.float64) for c, g in zip(candidates, groups[way])], axis=1)
            return marks[id(tile)]

        for a, b in _tile_pairs(left, right):
            d = fused_distances(a.x, b.x) if metric == "euclidean" else distances(a.x, b.x, metric)
            if a is b:
                np.fill_diagonal(d, 0.0)
            total[True][a.at] += d @ marked(b, right is None)
            if a is not b:
                total[right is None][b.at] += d.T @ marked(a, True)
        parts = []
        for way, rows in whole.items():
            ends = np.cumsum([0] + [len(g) for g in met[way]])
            for i, g in enumerate(met[way]):
                if len(rows) and len(g):
                    parts.append({
                        "row_id": np.repeat(rows.ids, len(g)), "candidate": np.full(len(rows) * len(g), i), "other": np.tile(g, len(rows)),
                        "total": total[way][:, ends[i] : ends[i + 1]].ravel()})
        return _stack(parts, {"row_id": np.int64, "candidate": np.int32, "other": np.int64, "total": np.float64})

    parts = cell_map(df, kernel, "row_id bigint, candidate int, other bigint, total double", candidates)
    return parts.groupBy("row_id", "candidate", "other").agg(F.sum("total").alias("total"))


def _first_k(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column positions of the k smallest entries per row, ties by column."""
    k = min(k, d.shape[1])
    edge = np.partition(d, k - 1, axis=1)[:, k - 1]
    row, col = np.nonzero(d <= edge[:, None])
    order = np.lexsort((col, d[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def self_knn(df: DataFrame, k: int, include_self: bool = True) -> DataFrame:
    """Exact k nearest rows of every row: ``row_id, neighbour, distance, rank`` (ties by neighbour id)."""

    def kernel(left: Side, right: Side | None) -> dict[str, np.ndarray]:
        whole = {True: left} if right is None else {True: left, False: right}
        best = {way: (np.full((len(rows), k), np.inf), np.full((len(rows), k), np.iinfo(np.int64).max)) for way, rows in whole.items()}
        known = {way: rows.extra["__tau"] * (1 + balls.SLACK) if "__tau" in rows.extra else np.full(len(rows), np.inf) for way, rows in whole.items()}

        def reach(a: Side, b: Side) -> float:
            return float(max(known[True][a.at].max(), known[right is None][b.at].max()))

        for rows, others, d, same, way in _both_ways(left, right, reach if "__tau" in left.extra else None):
            if same:
                d = d.copy()
                np.fill_diagonal(d, 0.0 if include_self else np.inf)
            some = np.flatnonzero(d.min(axis=1) <= known[way][rows.at])
            if not len(some):
                continue
            at = rows.at[some]
            i, j = _first_k(d[some], k)
            value, who = d[some[i], j], others.ids[j]
            real = np.isfinite(value) & (value <= known[way][at[i]])
            few = min(k, d.shape[1])
            far, none = np.inf, np.iinfo(np.int64).max
            value, who = np.where(real, value, far).reshape(-1, few), np.where(real, who, none).reshape(-1, few)
            value, who = np.concatenate([best[way][0][at], value], axis=1), np.concatenate([best[way][1][at], who], axis=1)
            order = np.lexsort((who, value), axis=1)[:, :k]
            best[way][0][at], best[way][1][at] = np.take_along_axis(value, order, 1), np.take_along_axis(who, order, 1)
            known[way][at] = np.minimum(known[way][at], best[way][0][at, k - 1])
        parts = []
        for way, rows in whole.items():
            i, j = np.nonzero(np.isfinite(best[way][0]))
            parts.append({"row_id": rows.ids[i], "neighbour": best[way][1][i, j], "distance": best[way][0][i, j]})
        return _stack(parts, {"row_id": np.int64, "neighbour": np.int64, "distance": np.float64})

    schema, count = "row_id bigint, neighbour bigint, distance double", df.count()
    if count <= PLAIN_ROWS:
        parts = cell_map(df, kernel, schema, blocks=block_count(df, rows=count))
    else:
        index = balls.build(df, (), BLOCK_ROWS, count)
        bounded, reach = balls.neighbour_reach(index, k, include_self)
        parts = _run_cells(_index_cells(index, ["__tau"], *reach, count, bounded), kernel, schema)
    return _merge_neighbours(parts, ["row_id"], k)


def _merge_neighbours(parts: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    window = Window.partitionBy(*by).orderBy("distance", "neighbour")
    return parts.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def query_knn(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """Exact k nearest base rows of every query: ``query_id, neighbour, distance, rank``.

    ``queries`` has ``query_id, v``; ``base`` has ``row_id, v``. A query set below ``BROADCAST_BYTES``
    visits every partition of the base, which is then not shuffled; a larger one goes through cells.
    """
    width = base.select(F.size("v").alias("d")).first()
    count = queries.count()
    if width is None or count == 0:
        empty = queries.select(F.col("query_id").cast("bigint").alias("query_id")).limit(0)
        return empty.selectExpr("query_id", "0L AS neighbour", "0D AS distance", "1 AS rank")
    if count * width["d"] * 8 <= BROADCAST_BYTES:
        parts = _query_everywhere(queries, base, k)
    else:
        parts = _query_cells(queries, base, k, count)
    return _merge_neighbours(parts, ["query_id"], k)


_QUERY_SCHEMA = "query_id bigint, neighbour bigint, distance double"


def _query_everywhere(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    rows = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("v").cast("array<double>").alias("v")).toArrow()
    shared = base.sparkSession.sparkContext.broadcast((rows.column("query_id").to_numpy(), matrix(rows.column("v"))))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = shared.value
        best_d = np.full((len(ids), 0), np.inf)
        best_i = np.zeros((len(ids), 0), dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, names = matrix(batch.column(1)), batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(names, kind="stable")
            x, names = x[order], names[order]
            width = min(k, best_d.shape[1] + len(names))
            new_d, new_i = np.empty((len(ids), width)), np.empty((len(ids), width), dtype=np.int64)
            step = max(1, balls.BLOCK_NUMBERS // len(names))
            for start in range(0, len(ids), step):
                part = slice(start, start + step)
                d = distances(points[part], x)
                i, j = _first_k(d, k)
                few = min(k, len(names))
                d, who = d[i, j].reshape(-1, few), names[j].reshape(-1, few)
                d, who = np.concatenate([best_d[part], d], axis=1), np.concatenate([best_i[part], who], axis=1)
                keep = np.lexsort((who, d), axis=1)[:, :k]
                new_d[part], new_i[part] = np.take_along_axis(d, keep, 1), np.take_along_axis(who, keep, 1)
            best_d, best_i = new_d, new_i
        if best_d.size:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, best_d.shape[1])), pa.array(best_i.ravel()), pa.array(best_d.ravel())], names=["query_id", "neighbour", "distance"])

    plain = base.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("v").cast("array<double>").alias("v"))
    return plain.mapInArrow(nearest, _QUERY_SCHEMA)


def _query_cells(queries: DataFrame, base: DataFrame, k: int, count: int) -> DataFrame:
    # A cell of queries holds one block of distances.
    query_blocks, base_blocks = (max(1, -(-n // BLOCK_ROWS)) for n in (count, base.count()))

    def placed(df: DataFrame, key: str, own: int, other: int, side: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(key), F.lit(own)).cast("int")
        cell = [mine.alias("__i"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("__j")]
        flat = df.select(F.col(key).cast("bigint").alias("row_id"), F.col("v").cast("array<double>").alias("v"), *cell)
        return flat if side == 0 else flat.select("row_id", "v", F.col("__j").alias("__i"), F.col("__i").alias("__j"))

    both = placed(queries, "query_id", query_blocks, base_blocks, 0).withColumn("__side", F.lit(0)).unionByName(
        placed(base, "row_id", base_blocks, query_blocks, 1).withColumn("__side", F.lit(1)))

    def run(cell: pa.Table) -> pa.Table:
        side = cell.column("__side").to_numpy()
        asked, known = (s.take(np.argsort(s.ids, kind="stable")) for s in (Side.of(cell.filter(pa.array(side == i))) for i in (0, 1)))
        if not len(asked) or not len(known):
            return pa.table({"query_id": np.array([], np.int64), "neighbour": np.array([], np.int64), "distance": np.array([], np.float64)})
        d = distances(asked.x, known.x)
        i, j = _first_k(d, k)
        return pa.table({"query_id": asked.ids[i], "neighbour": known.ids[j], "distance": d[i, j]})

    return both.groupBy("__i", "__j").applyInArrow(run, _QUERY_SCHEMA)


def distance_summary(df: DataFrame, eps: float | None = None) -> DataFrame:
    """Per row over all other rows: ``nearest, farthest, mean_distance`` and ``within`` (others within ``eps``)."""
    radius = -1.0 if eps is None else float(eps)

    def kernel(left: Side, right: Side | None) -> dict[str, np.ndarray]:
        whole = {True: left} if right is None else {True: left, False: right}
        near, far, total, others_of, within = ({w: np.full(len(r), v) for w, r in whole.items()} for v in (np.inf, 0.0, 0.0, 0, 0))
        for rows, others, d, same, way in _both_ways(left, right):
            low, at = d, rows.at
            if same:
                low = d.copy()
                np.fill_diagonal(low, np.inf)
                d = np.where(np.isfinite(low), d, 0.0)
            near[way][at], far[way][at] = np.minimum(near[way][at], low.min(axis=1)), np.maximum(far[way][at], d.max(axis=1))
            total[way][at] += d.sum(axis=1)
            others_of[way][at] += len(others) - same
            within[way][at] += (low <= radius).sum(axis=1)
        parts = [{"row_id": r.ids, "nearest": near[w], "farthest": far[w], "total": total[w], "others": others_of[w], "within": within[w]} for w, r in whole.items() if right is None or (len(left) and len(right))]
        return _stack(parts, {"row_id": np.int64, "nearest": np.float64, "farthest": np.float64, "total": np.float64, "others": np.int64, "within": np.int64})

    parts = cell_map(df, kernel, "row_id bigint, nearest double, farthest double, total double, others bigint, within bigint")
    return parts.groupBy("row_id").agg(
        F.min("nearest").alias("nearest"), F.max("farthest").alias("farthest"),
        F.try_divide(F.sum("total"), F.sum("others")).alias("mean_distance"), F.sum("within").alias("within"))


def eps_counts(df: DataFrame, eps: float) -> DataFrame:
    """``row_id, within``: other rows within ``eps`` of each row."""

    def kernel(left: Side, right: Side | None) -> dict[str, np.ndarray]:
        whole = {True: left} if right is None else {True: left, False: right}
        within = {way: np.zeros(len(rows), np.int64) for way, rows in whole.items()}
        for a, b in _tile_pairs(left, right, lambda a, b: eps):
            close = _inside(a.x, b.x, eps)
            within[True][a.at] += close.sum(axis=1) - (a is b)
            if a is not b:
                within[right is None][b.at] += close.sum(axis=0)
        parts = [{"row_id": rows.ids, "within": within[way]} for way, rows in whole.items()]
        return _stack(parts, {"row_id": np.int64, "within": np.int64})

    return close_map(df, kernel, "row_id bigint, within bigint", eps).groupBy("row_id").agg(F.sum("within").alias("within"))


def separation(df: DataFrame, candidates: Sequence[str] = ("cluster",)) -> DataFrame:
    """``candidate, max_diameter, min_separation``: largest distance inside and smallest between clusters, per labeling.

    Labels below 0 are left out. All labelings share the pass.
    """
    names = list(candidates)

    def kernel(left: Side, right: Side | None) -> dict[str, np.ndarray]:
        inside, between = np.full(len(names), -np.inf), np.full(len(names), np.inf)
        for a, b in _tile_pairs(left, right):
            d = fused_distances(a.x, b.x)
            if a is b:
                np.fill_diagonal(d, 0.0)
            for i, name in enumerate(names):
                la, lb = a.extra[name][:, None], b.extra[name][None, :]
                used, same = (la >= 0) & (lb >= 0), la == lb
                inside[i] = max(inside[i], d[used & same].max(initial=-np.inf))
                between[i] = min(between[i], d[used & ~same].min(initial=np.inf))
        return {"candidate": np.arange(len(names), dtype=np.int32), "inside": inside, "between": between}

    parts = cell_map(df, kernel, "candidate int, inside double, between double", names)
    name = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("candidate") + 1)
    return parts.groupBy(name.alias("candidate")).agg(F.max("inside").alias("max_diameter"), F.min("between").alias("min_separation"))


def cluster_gaps(df: DataFrame) -> DataFrame:
    """``cluster_a, cluster_b, distance``: smallest distance between two clusters, ``cluster_a < cluster_b``."""

    def kernel(left: Side, right: Side | None) -> dict[str, np.ndarray]:
        least: dict[tuple[int, int], float] = {}
        for one, two in _tile_pairs(left, right):
            d = distances(one.x, two.x)
            la, lb = one.extra["cluster"], two.extra["cluster"]
            for a in np.unique(la):
                rows = d[la == a]
                for b in np.unique(lb):
                    if a != b:
                        key = (min(a, b), max(a, b))
                        least[key] = min(least.get(key, np.inf), rows[:, lb == b].min())
        a, b, value = (np.array(c) for c in zip(*((*key, v) for key, v in least.items()))) if least else (np.array([]),) * 3
        return {"cluster_a": a.astype(np.int64), "cluster_b": b.astype(np.int64), "distance": value.astype(np.float64)}

    parts = cell_map(df, kernel, "cluster_a bigint, cluster_b bigint, distance double", ["cluster"])
    return parts.groupBy("cluster_a", "cluster_b").agg(F.min("distance").alias("distance"))


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest member position per node after the edges between the components ``a`` and ``b`` (lowest positions) join them."""
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        parent = np.arange(len(root))
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        root = parent[root]
        a, b = parent[a], parent[b]
        a, b = a[a != b], b[a != b]
    return root


def eps_forest(df: DataFrame, eps: float) -> DataFrame:
    """``a_id, b_id``: star edges whose connected components equal those of the graph of pairs within ``eps``.

    A cell emits at most one edge per row, however many of its pairs are close.
    """

    def kernel(left: Side, right: Side | None) -> dict[str, np.ndarray]:
        ids = np.unique(left.ids if right is None else np.concatenate([left.ids, right.ids]))
        root = np.arange(len(ids))
        for a, b in _tile_pairs(left, right, lambda a, b: eps):
            close = _inside(a.x, b.x, eps)
            mine, theirs = root[np.searchsorted(ids, a.ids)], root[np.searchsorted(ids, b.ids)]
            # Pairs inside one component need no edge; of the others the tile keeps its star edges.
            i, j = np.nonzero(close & (mine[:, None] != theirs[None, :]))
            if len(i):
                root = _joined(root, mine[i], theirs[j])
        inner = root != np.arange(len(ids))
        return {"a_id": ids[root[inner]], "b_id": ids[inner]}

    return close_map(df, kernel, "a_id bigint, b_id bigint", eps).distinct()


def nearest_core_cluster(df: DataFrame, eps: float) -> DataFrame:
    """``row_id, border``: lowest ``cluster`` (>= 0) among the rows within ``eps`` of a row with ``cluster`` -1."""

    def kernel(left: Side, right: Side | None) -> dict[str, np.ndarray]:
        none = np.iinfo(np.int64).max
        whole = {True: left} if right is None else {True: left, False: right}
        best = {way: np.full(len(rows), none) for way, rows in whole.items()}
        for a, b in _tile_pairs(left, right, lambda a, b: eps):
            for rows, others, way in [(a, b, True)] + ([] if a is b else [(b, a, right is None)]):
                loose, core = np.flatnonzero(rows.extra["cluster"] < 0), np.flatnonzero(others.extra["cluster"] >= 0)
                if len(loose) and len(core):
                    labels = np.where(_inside(rows.x[loose], others.x[core], eps), others.extra["cluster"][core][None, :], none)
                    best[way][rows.at[loose]] = np.minimum(best[way][rows.at[loose]], labels.min(axis=1))
        parts = [{"row_id": rows.ids[best[way] < none], "border": best[way][best[way] < none]} for way, rows in whole.items()]
        return _stack(parts, {"row_id": np.int64, "border": np.int64})

    parts = close_map(df, kernel, "row_id bigint, border bigint", eps, ["cluster"])
    return parts.groupBy("row_id").agg(F.min("border").alias("border"))


_NO_EDGES = (np.array([], np.int64), np.array([], np.int64), np.array([], np.float64))
# Tree edges of tiles that a cell gathers before it joins them to one forest.
FOREST_EDGES = 1 << 18


def _tile_tree(one: Side, two: Side, core: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning tree ``(a, b, weight)`` of the pairs inside a tile, or of those between two."""
    w = distances(one.x, two.x)
    if core:
        w = np.maximum(w, np.maximum(one.extra[core][:, None], two.extra[core][None, :]))
    if one is two:
        if len(one) < 2:
            return _NO_EDGES
        a, b, weight = balls.dense_tree(w)
    else:
        a, b, weight = _cross_tree(w)
    a, b = one.ids[a], two.ids[b]
    return np.minimum(a, b), np.maximum(a, b), weight


def _cross_tree(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges ``(row, column, weight)`` of a minimum spanning tree of the graph between rows and columns."""
    rows, columns = w.shape
    turned = np.ascontiguousarray(w.T)
    best, parent = np.full(rows + columns, np.inf), np.zeros(rows + columns, dtype=np.int64)
    outside = np.ones(rows + columns, dtype=bool)
    best[rows:], outside[0] = w[0], False
    ends, weight = np.empty((rows + columns - 1, 2), np.int64), np.empty(rows + columns - 1)
    for step in range(rows + columns - 1):
        j = int(best.argmin())
        weight[step], outside[j], best[j] = best[j], False, np.inf
        ends[step] = (j, parent[j]) if j < rows else (parent[j], j - rows)
        other, line, me = (slice(rows, None), w[j], j) if j < rows else (slice(0, rows), turned[j - rows], j - rows)
        closer = line < best[other]
        closer &= outside[other]
        np.copyto(best[other], line, where=closer)
        np.copyto(parent[other], me, where=closer)
    return ends[:, 0], ends[:, 1], weight


def _forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning forest of edges (ties by ids), by rounds in which every component takes its lightest edge."""
    order = np.lexsort((b, a, weight))
    a, b, weight = a[order], b[order], weight[order]
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    left, taken = np.arange(len(a)), np.zeros(len(a), dtype=bool)
    while True:
        left = left[x[left] != y[left]]
        if not len(left):
            return a[taken], b[taken], weight[taken]
        first = np.full(len(ids), len(a))
        np.minimum.at(first, x[left], left)
        np.minimum.at(first, y[left], left)
        picked = np.unique(first[first < len(a)])
        taken[picked] = True
        name = _joined(np.arange(len(ids)), x[picked], y[picked])
        x, y = name[x], name[y]


def spanning_candidates(df: DataFrame, core: str | None = None) -> DataFrame:
    """``a_id, b_id, weight``: the spanning tree of every cell; together they hold a tree of the whole graph.

    By the cycle property an edge outside its cell's tree is in no need of the global one; cells whose pairs are all heavier
    than a path that links them anyway do not exist. With ``core``
    (a core-distance column) the weight is the mutual reachability distance.
    """
    keep = [core] if core else []

    def kernel(left: Side, right: Side | None) -> dict[str, np.ndarray]:
        edges, waiting = [_NO_EDGES], 0
        for one, two in _tile_pairs(left, right):
            found = _tile_tree(one, two, core)
            edges.append(found)
            waiting += len(found[0])
            if waiting > FOREST_EDGES + 4 * (len(left) + len(right or ())):
                edges, waiting = [_forest(*(np.concatenate(c) for c in zip(*edges)))], 0
        a, b, weight = (np.concatenate(c) for c in zip(*edges))
        a, b, weight = _forest(a, b, weight) if len(edges) > 2 else (a, b, weight)
        return {"a_id": a, "b_id": b, "weight": weight}

    schema, count = "a_id bigint, b_id bigint, weight double", df.count()
    if count <= PLAIN_ROWS:
        parts = cell_map(df, kernel, schema, keep, block_count(df, rows=count))
    else:
        index = balls.build(df, keep, BLOCK_ROWS, count)
        parts = _run_cells(_index_cells(index, keep, *balls.tree_reach(index, core), count), kernel, schema)
    return parts.groupBy("a_id", "b_id").agg(F.min("weight").alias("weight"))


def centre_distances(df: DataFrame, centres: np.ndarray, name: str = "distances") -> DataFrame:
    """Distances of every row to a fixed list of centres, as one array column (no shuffle)."""
    from segmentry.functions.vectors import list_array

    schema = StructType(df.schema.fields + [StructField(name, ArrayType(DoubleType()))])
    where = df.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(where))
            d = distances(centres, x).T if batch.num_rows else np.zeros((0, len(centres)))
            yield pa.RecordBatch.from_arrays([*batch.columns, list_array(np.ascontiguousarray(d))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)
