"""K-means family. One pass over the rows serves every restart, every k and every bootstrap run.

The centres are the model (runs x k x dimensions numbers) and live on the driver; each task turns its rows into
partial sums, and the shuffle carries those only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from segmentry.functions.hashing import draw_key
from segmentry.functions.vectors import distances, list_array, matrix

# Rounds of draws for starting centres, each of twice as many rows as the largest k.
SEED_ROUNDS = 5
# Partial sums of all tasks that the driver adds up itself; larger ones are added up by a shuffle.
PARTIAL_BYTES = 16 << 20


@dataclass
class Fit:
    """Centres of one run and how they were reached."""

    centres: np.ndarray
    inertia: float
    iterations: int
    converged: bool

    @property
    def k(self) -> int:
        return len(self.centres)


def hash_seeds(df: DataFrame, k: int, seed: int) -> np.ndarray:
    """Rows with the k smallest draw keys, as starting centres."""
    rows = df.select("row_id", F.col("v").cast("array<double>").alias("v")).withColumn("__d", draw_key(seed, "kmeans-seed", F.col("row_id")))
    return np.array([r["v"] for r in rows.orderBy("__d").limit(k).collect()])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seed_pool(df: DataFrame, draws: int, seed: int, rounds: int = SEED_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Candidate centres from all rows, and the number of rows nearest to each.

    Every round draws ``draws`` rows without replacement with chances in proportion to the squared distance to the
    candidates so far: each row runs a race whose time is exponential at that rate and depends on its id, a task returns its
    first ones, and the first of all tasks are taken. So a small group that is far from the rest is found whatever its share.
    """
    rows = df.select("row_id", F.col("v").cast("array<double>").alias("v"))
    pool = hash_seeds(df, 1, seed)
    for number in range(rounds):
        start = _mixed(np.array([(seed + 1) * 1_000_003 + number], dtype=np.uint64))[0]

        def race(batches: Iterator[pa.RecordBatch], pool: np.ndarray = pool, start: np.uint64 = start) -> Iterator[pa.RecordBatch]:
            times, ids, vectors = np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros((0, pool.shape[1]))
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                own, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
                rate = distances(x, pool).min(axis=1) ** 2
                u = ((_mixed(_mixed(own.astype(np.int64).view(np.uint64)) ^ start) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
                time = np.divide(-np.log(u), rate, out=np.full(len(x), np.inf), where=rate > 0)
                times, ids, vectors = np.concatenate([times, time]), np.concatenate([ids, own]), np.concatenate([vectors, x])
                first = np.lexsort((ids, times))[:draws]
                times, ids, vectors = times[first], ids[first], vectors[first]
            real = np.isfinite(times)
            yield pa.RecordBatch.from_arrays([pa.array(times[real]), pa.array(ids[real]), list_array(vectors[real])], names=["time", "row_id", "v"])

        drawn = rows.mapInArrow(race, "time double, row_id bigint, v array<double>").orderBy("time", "row_id").limit(draws).toArrow()
        if not drawn.num_rows:
            break
        pool = np.concatenate([pool, matrix(drawn.column("v"))])
    return pool, _pass(rows, [pool], None)[0][0]


def plus_plus_seeds(df: DataFrame, sizes: Sequence[int], seed: int, pool: tuple[np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
    """Distance-weighted starting centres, one set per entry of ``sizes``, from a pool of candidates weighted by their rows.

    Calls that differ in the seed only may share a ``seed_pool``.
    """
    x, weight = seed_pool(df, 2 * max(sizes), seed) if pool is None else pool
    out = []
    for run, k in enumerate(sizes):
        rng = np.random.default_rng([seed, run])
        picked = [int(rng.choice(len(x), p=weight / weight.sum()))]
        nearest = distances(x, x[picked]).min(axis=1) ** 2
        while len(picked) < k:
            mass = weight * nearest
            spot = int(rng.choice(len(x), p=mass / mass.sum())) if mass.sum() > 0 else int(rng.integers(len(x)))
            picked.append(spot)
            nearest = np.minimum(nearest, distances(x, x[[spot]])[:, 0] ** 2)
        out.append(x[picked].copy())
    return out


def _pass(df: DataFrame, centres: list[np.ndarray], weights: str | None, entries: Sequence[int] = (), tasks: int | None = None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """One pass: per run the member weight and vector sum of every cluster, and the inertia.

    ``entries`` gives the place of each run's weight in the array column ``weights``. ``tasks`` is the number of partitions if it is
    known: up to ``PARTIAL_BYTES`` of partial sums need no shuffle.
    """
    offset = np.cumsum([0] + [len(c) for c in centres])
    everything, width = int(offset[-1]), centres[0].shape[1]
    pieces = [slice(offset[r], offset[r + 1]) for r in range(len(centres))]
    direct = tasks is not None and tasks * (everything * (width + 1) + len(centres)) * 8 <= PARTIAL_BYTES

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, inertia = np.zeros(everything), np.zeros((everything, width)), np.zeros(len(centres))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column(0))
            w = matrix(batch.column(1)) if weights else None
            for r, c in enumerate(centres):
                share = w[:, entries[r]] if weights else np.ones(len(x))
                use = share > 0
                if not use.any():
                    continue
                xs, ws = x[use], share[use]
                d = distances(xs, c)
                label = d.argmin(axis=1)
                member = np.zeros((len(xs), len(c)))
                member[np.arange(len(xs)), label] = ws
                span = slice(offset[r], offset[r + 1])
                count[span] += member.sum(axis=0)
                total[span] += member.T @ xs
                inertia[r] += ws @ d[np.arange(len(xs)), label] ** 2
        if direct:
            whole = np.concatenate([total.ravel(), count, inertia])
            yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], names=["sums"])
            return
        used = np.flatnonzero(count)
        slot = np.concatenate([np.repeat(used, width), used, -1 - np.arange(len(centres))])
        dim = np.concatenate([np.tile(np.arange(width), len(used)), np.full(len(used) + len(centres), -1)])
        value = np.concatenate([total[used].ravel(), count[used], inertia])
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(dim), pa.array(value)], names=["slot", "dim", "value"])

    columns = [F.col("v").cast("array<double>").alias("v")] + ([F.col(weights).cast("array<double>").alias("w")] if weights else [])
    if direct:
        got = df.select(*columns).mapInArrow(sums, "sums binary").toArrow()
        flat = np.sum([np.frombuffer(x, dtype=np.float64) for x in got.column("sums").to_pylist()] or [np.zeros(everything * (width + 1) + len(centres))], axis=0)
        total, count, inertia = np.split(flat, [everything * width, everything * (width + 1)])
        total = total.reshape(everything, width)
        return [count[p] for p in pieces], [total[p] for p in pieces], inertia
    parts = df.select(*columns).mapInArrow(sums, "slot bigint, dim bigint, value double")
    got = parts.groupBy("slot", "dim").agg(F.sum("value").alias("value")).toArrow()
    slot, dim, value = (got.column(c).to_numpy() for c in ("slot", "dim", "value"))
    count, total, inertia = np.zeros(everything), np.zeros((everything, width)), np.zeros(len(centres))
    cell = (slot >= 0) & (dim >= 0)
    total[slot[cell], dim[cell]] = value[cell]
    head = (slot >= 0) & (dim < 0)
    count[slot[head]] = value[head]
    inertia[-1 - slot[slot < 0]] = value[slot < 0]
    return [count[p] for p in pieces], [total[p] for p in pieces], inertia


def lloyd(
    df: DataFrame, starts: Sequence[np.ndarray], max_iter: int = 300, tol: float = 1e-4, weights: str | None = None, entries: Sequence[int] | None = None
) -> list[Fit]:
    """Lloyd iterations of many runs side by side.

    A run stops when the squared movement of its centres falls to ``tol`` times the mean dimension variance.
    ``weights``: array column of row weights (0 leaves the row out of a run); ``entries`` gives the place of each run's weight in
    it, one per run in order if missing. An empty cluster keeps its centre.
    """
    from segmentry.operators.moments import dimension_moments

    # A table of more than one iteration is read again and again: keep it close.
    held = df.select("v", *([weights] if weights else [])).persist()
    try:
        tasks = held.rdd.getNumPartitions()
        variance = dimension_moments(held).agg(F.avg(F.col("m2") / F.col("n"))).first()[0] or 0.0
        centres = [np.array(s, dtype=np.float64) for s in starts]
        places = list(range(len(centres))) if entries is None else list(entries)
        steps, done = [0] * len(centres), [False] * len(centres)
        for _ in range(max_iter):
            active = [r for r in range(len(centres)) if not done[r]]
            if not active:
                break
            count, total, _ = _pass(held, [centres[r] for r in active], weights, [places[r] for r in active], tasks)
            for i, r in enumerate(active):
                filled = count[i] > 0
                moved = centres[r].copy()
                moved[filled] = total[i][filled] / count[i][filled][:, None]
                shift = ((moved - centres[r]) ** 2).sum()
                centres[r], steps[r] = moved, steps[r] + 1
                done[r] = shift <= tol * variance
        _, _, inertia = _pass(held, centres, weights, places, tasks)
        return [Fit(c, float(e), s, bool(d)) for c, e, s, d in zip(centres, inertia, steps, done)]
    finally:
        held.unpersist()


def kmeans(df: DataFrame, ks: Sequence[int], seed: int, n_init: int = 10, max_iter: int = 300, tol: float = 1e-4) -> dict[int, Fit]:
    """Best of ``n_init`` restarts for every k, all in the same passes."""
    sizes = [k for k in ks for _ in range(n_init)]
    fits = lloyd(df, plus_plus_seeds(df, sizes, seed), max_iter, tol)
    best: dict[int, Fit] = {}
    for k, fit in zip(sizes, fits):
        if k not in best or fit.inertia < best[k].inertia:
            best[k] = fit
    return best


def fixed_lloyd(df: DataFrame, k: int, iterations: int, seed: int) -> np.ndarray:
    """Hash-chosen starting rows and a fixed number of Lloyd steps."""
    return lloyd(df, [hash_seeds(df, k, seed)], max_iter=iterations, tol=-1.0)[0].centres


def minibatch_kmeans(
    df: DataFrame, ks: Sequence[int], seed: int, batch: int = 2048, max_iter: int = 100, patience: int = 20, reassign: float = 0.01
) -> dict[int, Fit]:
    """Centres updated from a fresh hash sample per step with a per-centre learning rate, then one full scoring pass.

    Stops after ``patience`` steps without a smoothed batch inertia better by one part in ten thousand. Centres with fewer than
    ``reassign`` times the largest count move to a row of the current batch.
    """
    from segmentry.functions.hashing import uniform

    rows, tasks = df.count(), df.rdd.getNumPartitions()
    share = min(1.0, batch / max(rows, 1))
    starts = plus_plus_seeds(df, list(ks), seed)
    centres = [s.copy() for s in starts]
    counts = [np.zeros(len(c)) for c in centres]
    smooth, best, idle, steps = [None] * len(ks), [np.inf] * len(ks), [0] * len(ks), [0] * len(ks)
    for step in range(max_iter):
        active = [i for i in range(len(ks)) if idle[i] < patience]
        if not active:
            break
        picked = df.filter(uniform(seed, "minibatch", step, F.col("row_id")) < share) if share < 1 else df
        count, total, inertia = _pass(picked, [centres[i] for i in active], None, tasks=tasks)
        spare = None
        for j, i in enumerate(active):
            n = count[j]
            counts[i] += n
            rate = np.divide(n, counts[i], out=np.zeros_like(n), where=counts[i] > 0)[:, None]
            mean = np.divide(total[j], n[:, None], out=centres[i].copy(), where=n[:, None] > 0)
            centres[i] += rate * (mean - centres[i])
            poor = counts[i] < reassign * counts[i].max()
            if poor.any() and step % 10 == 9:
                if spare is None:
                    spare = hash_seeds(picked, max(ks), seed + step)
                fresh = spare[: int(poor.sum())]
                centres[i][np.flatnonzero(poor)[: len(fresh)]] = fresh
                counts[i][poor] = counts[i][~poor].min() if (~poor).any() else 1.0
            value = inertia[j] / max(n.sum(), 1.0)
            mix = min(1.0, 2.0 * batch / (rows + 1))
            smooth[i] = value if smooth[i] is None else smooth[i] * (1 - mix) + value * mix
            idle[i] = 0 if smooth[i] < best[i] * (1 - 1e-4) else idle[i] + 1
            best[i], steps[i] = min(best[i], smooth[i]), steps[i] + 1
    _, _, inertia = _pass(df, centres, None, tasks=tasks)
    return {k: Fit(c, float(e), s, s < max_iter) for k, c, e, s in zip(ks, centres, inertia, steps)}


def assign(df: DataFrame, centres: np.ndarray, label: str = "cluster", distance: str | None = None) -> DataFrame:
    """Add the nearest centre (lowest number on ties) and its distance; keeps every other column, no shuffle."""
    schema = StructType(df.schema.fields + [StructField(label, IntegerType())])
    if distance:
        schema.add(distance, DoubleType())
    where = df.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(where))
            d = distances(centres, x) if len(x) else np.zeros((len(centres), 0))
            best = d.argmin(axis=0).astype(np.int32)
            extra = [pa.array(best)] + ([pa.array(d[best, np.arange(len(best))])] if distance else [])
            names = [*batch.schema.names, label] + ([distance] if distance else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=names)

    return df.mapInArrow(run, schema)


def assign_many(df: DataFrame, models: Sequence[np.ndarray], key: str = "row_id") -> DataFrame:
    """Labels of many models in long form ``row_id, run, cluster``, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            labels = np.stack([distances(c, x).argmin(axis=0) for c in models])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(ids, len(models))), pa.array(np.repeat(np.arange(len(models), dtype=np.int32), len(ids))), pa.array(labels.ravel().astype(np.int32))],
                names=["row_id", "run", "cluster"])

    plain = df.select(F.col(key).cast("bigint").alias("row_id"), F.col("v").cast("array<double>").alias("v"))
    return plain.mapInArrow(run, "row_id bigint, run int, cluster int")


def centre_table(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """Centres as rows ``cluster, dim, centre``."""
    rows = [(int(c), int(j) + 1, float(x)) for c, line in enumerate(centres) for j, x in enumerate(line)]
    return df.sparkSession.createDataFrame(rows, "cluster int, dim int, centre double")
