"""Gaussian mixtures with spherical, diagonal, tied or full covariance.

EM keeps the parameters on the driver; a pass turns the rows into weighted sums per component inside the tasks. All
restarts share the passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.functions import vectors as vec
from segmentry.operators.kmeans import lloyd, plus_plus_seeds

COVARIANCES = ("spherical", "diag", "tied", "full")


@dataclass
class Mixture:
    """Parameters of one mixture; ``covariance`` has the shape of its kind."""

    kind: str
    weights: np.ndarray
    means: np.ndarray
    covariance: np.ndarray
    lower_bound: float = -np.inf
    iterations: int = 0
    converged: bool = False

    @property
    def free_parameters(self) -> int:
        k, d = self.means.shape
        spread = {"spherical": k, "diag": k * d, "tied": d * (d + 1) // 2, "full": k * d * (d + 1) // 2}[self.kind]
        return spread + k * d + k - 1

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Weighted log density per row and component."""
        k, d = self.means.shape
        out = np.empty((len(x), k))
        for c in range(k):
            gap = x - self.means[c]
            if self.kind in ("spherical", "diag"):
                var = np.broadcast_to(self.covariance[c], (d,))
                out[:, c] = -0.5 * ((gap * gap / var).sum(axis=1) + np.log(var).sum())
            else:
                low = np.linalg.cholesky(self.covariance if self.kind == "tied" else self.covariance[c])
                z = np.linalg.solve(low, gap.T)
                out[:, c] = -0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum()
        return out - 0.5 * d * np.log(2 * np.pi) + np.log(np.maximum(self.weights, 1e-300))


def _log_sum(log_p: np.ndarray) -> np.ndarray:
    top = log_p.max(axis=1)
    return top + np.log(np.exp(log_p - top[:, None]).sum(axis=1))


def _sums(df: DataFrame, width: int, k: int, kinds: list[str], responsibilities) -> list[tuple]:
    """Per run: member weight, first moments, second moments and log likelihood, summed over all rows."""
    full = [kind in ("tied", "full") for kind in kinds]
    sizes = [k + k * width + (k * width * width if f else k * width) + 1 for f in full]
    starts = np.cumsum([0] + sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(starts[-1])
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = vec.matrix(batch.column(0))
            for r, heavy in enumerate(full):
                share, log_l = responsibilities(r, x)
                if heavy:
                    second = np.stack([(x * share[:, [c]]).T @ x for c in range(k)]).ravel()
                else:
                    second = (share.T @ (x * x)).ravel()
                total[starts[r] : starts[r + 1]] += np.concatenate([share.sum(axis=0), (share.T @ x).ravel(), second, [log_l]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["slot", "value"])

    parts = df.select(F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "slot bigint, value double")
    got = parts.groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros(starts[-1])
    flat[got.column("slot").to_numpy()] = got.column("value").to_numpy()
    out = []
    for r, heavy in enumerate(full):
        piece = flat[starts[r] : starts[r + 1]]
        second = piece[k + k * width : -1]
        shape = (k, width, width) if heavy else (k, width)
        out.append((piece[:k], piece[k : k + k * width].reshape(k, width), second.reshape(shape), piece[-1]))
    return out


def _maximise(kind: str, sums: tuple, regular: float) -> Mixture:
    n, first, second, _ = sums
    safe = np.maximum(n, 1e-10)
    means = first / safe[:, None]
    if kind in ("diag", "spherical"):
        var = np.maximum(second / safe[:, None] - means**2, 0.0) + regular
        covariance = var if kind == "diag" else var.mean(axis=1, keepdims=True)
    else:
        each = second / safe[:, None, None] - means[:, :, None] * means[:, None, :]
        if kind == "tied":
            covariance = (second.sum(axis=0) - (means.T * n) @ means) / n.sum() + regular * np.eye(means.shape[1])
        else:
            covariance = each + regular * np.eye(means.shape[1])
    return Mixture(kind, n / n.sum(), means, covariance)


def fit_mixtures(
    df: DataFrame, k: int, kinds: tuple[str, ...] = COVARIANCES, seed: int = 42, n_init: int = 3, max_iter: int = 300, tol: float = 1e-3,
    regular: float = 1e-6,
) -> dict[str, Mixture]:
    """Best of ``n_init`` starts per covariance kind; starts are short k-means runs."""
    rows = df.select("v").persist()
    try:
        count = rows.count()
        starts = [f.centres for f in lloyd(rows, plus_plus_seeds(df, [k] * n_init, seed), max_iter=20)]
        width = starts[0].shape[1]
        plan = [(kind, s) for kind in kinds for s in range(n_init)]

        def hard(r: int, x: np.ndarray):
            share = np.zeros((len(x), k))
            share[np.arange(len(x)), vec.distances(starts[plan[r][1]], x).argmin(axis=0)] = 1.0
            return share, 0.0

        models = [_maximise(kind, s, regular) for (kind, _), s in zip(plan, _sums(rows, width, k, [p[0] for p in plan], hard))]
        for step in range(1, max_iter + 1):
            active = [i for i, m in enumerate(models) if not m.converged]
            if not active:
                break
            current = [models[i] for i in active]

            def soft(r: int, x: np.ndarray, current=current):
                log_p = current[r].log_density(x)
                norm = _log_sum(log_p)
                return np.exp(log_p - norm[:, None]), norm.sum()

            found = _sums(rows, width, k, [m.kind for m in current], soft)
            for i, sums in zip(active, found):
                old, bound = models[i], sums[3] / count
                if abs(bound - old.lower_bound) < tol:
                    old.lower_bound, old.converged = max(bound, old.lower_bound), True
                    continue
                new = _maximise(old.kind, sums, regular)
                new.lower_bound, new.iterations = bound, step
                models[i] = new
        best: dict[str, Mixture] = {}
        for (kind, _), model in zip(plan, models):
            if kind not in best or model.lower_bound > best[kind].lower_bound:
                best[kind] = model
        return best
    finally:
        rows.unpersist()


def mixture_labels(df: DataFrame, model: Mixture) -> DataFrame:
    """``row_id, cluster, entropy, log_likelihood`` of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            log_p = model.log_density(vec.matrix(batch.column(1)))
            norm = _log_sum(log_p)
            p = np.exp(log_p - norm[:, None])
            entropy = -(p * np.log(np.clip(p, 1e-12, 1.0))).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(entropy), pa.array(norm)],
                names=["row_id", "cluster", "entropy", "log_likelihood"])

    plain = df.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("v").cast("array<double>").alias("v"))
    return plain.mapInArrow(run, "row_id bigint, cluster int, entropy double, log_likelihood double")


def mixture_diagnostics(labels: DataFrame, model: Mixture) -> DataFrame:
    """One row ``aic, bic, mean_assignment_entropy, log_likelihood`` from the labelled rows."""
    sums = labels.agg(F.sum("log_likelihood").alias("log_likelihood"), F.count(F.lit(1)).alias("n"), F.avg("entropy").alias("mean_assignment_entropy"))
    p = float(model.free_parameters)
    return sums.select(
        (-2 * F.col("log_likelihood") + 2 * p).alias("aic"), (-2 * F.col("log_likelihood") + p * F.ln("n")).alias("bic"),
        "mean_assignment_entropy", "log_likelihood", F.lit(model.converged).alias("converged"), F.lit(model.iterations).alias("iterations"))
