"""Internal and external validity of labelings, and inference about them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.functions import vectors as vec
from segmentry.functions.hashing import draw_key
from segmentry.operators.moments import centroids, centroids_long, dimension_moments
from segmentry.operators.order import unpivot
from segmentry.operators.pairs import cluster_distance_sums, separation
from segmentry.session import cut_lineage, small_side

# Largest set of centres that is shipped to every task.
MODEL_BYTES = 64 << 20


def silhouette_points(df: DataFrame, candidates: Sequence[str] = ("cluster",), metric: str = "euclidean") -> DataFrame:
    """Exact point silhouettes: ``row_id, candidate, cluster, silhouette``; rows with a label below 0 are left out.

    All labelings share one pass over the pairs of rows; cosine distances need no pairs.
    """
    names = list(candidates)
    sums = cosine_sums(df, names) if metric == "cosine" else None
    if sums is None:
        sums = cluster_distance_sums(df, names, metric)
    index = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("column")) - 1
    labels = unpivot(df, names, ["row_id"], "bigint").select("row_id", index.cast("int").alias("candidate"), F.col("value").alias("cluster"))
    labels = labels.filter(F.col("cluster") >= 0)
    sizes = labels.groupBy("candidate", "cluster").agg(F.count(F.lit(1)).alias("n"))
    joined = sums.join(labels, ["row_id", "candidate"]).join(small_side(sizes.withColumnRenamed("cluster", "other")), ["candidate", "other"])
    own = F.col("other") == F.col("cluster")
    points = joined.groupBy("row_id", "candidate", "cluster").agg(
        F.max(F.when(own, F.try_divide("total", F.col("n") - 1))).alias("a"), F.max(F.when(own, F.col("n"))).alias("n"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    value = F.when(F.col("n") == 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    name = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("candidate") + 1)
    return points.select("row_id", name.alias("candidate"), "cluster", F.when(F.col("b").isNotNull(), value).alias("silhouette"))


def cosine_sums(df: DataFrame, candidates: Sequence[str]) -> DataFrame | None:
    """``row_id, candidate, other, total``: summed cosine distance from each row to each cluster, without pairs.

    The sum over a cluster is its size less the dot product with the sum of its unit vectors, so each row meets one vector
    per cluster. None if these vectors are more than ``MODEL_BYTES``. A zero vector has distance 1 to all others.
    """
    names = list(candidates)
    rows = df.select("row_id", F.col("v").cast("array<double>").alias("v"), *[F.col(c).cast("bigint").alias(c) for c in names])
    sizes = unpivot(rows, names, ["row_id"], "bigint").filter("value >= 0").groupBy(F.col("column").alias("name"), F.col("value").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    sizes = cut_lineage(sizes)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if sizes.count() * width * 8 > MODEL_BYTES:
        return None
    groups = {c: [] for c in names}
    for row in sizes.collect():
        groups[row["name"]].append((row["cluster"], row["n"]))
    known = [np.array(sorted(groups[c]), dtype=np.int64).reshape(-1, 2) for c in names]

    def unit(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = vec.matrix(batch.column(1))
        length = np.linalg.norm(x, axis=1)
        return x / np.where(length > 0, length, 1.0)[:, None], length > 0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(k), width)) for k in known]
        for batch in batches:
            if batch.num_rows:
                u, _ = unit(batch)
                for i, k in enumerate(known):
                    label = batch.column(2 + i).to_numpy(zero_copy_only=False)
                    used = label >= 0
                    np.add.at(total[i], np.searchsorted(k[:, 0], label[used]), u[used])
        for i, t in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(t.size, i, np.int32)), pa.array(np.arange(t.size)), pa.array(t.ravel())], names=["candidate", "cell", "value"])

    parts = rows.mapInArrow(add, "candidate int, cell bigint, value double").groupBy("candidate", "cell").agg(F.sum("value").alias("value")).toArrow()
    model = [np.zeros(len(k) * width) for k in known]
    which, cell, value = (parts.column(c).to_numpy() for c in ("candidate", "cell", "value"))
    for i, m in enumerate(model):
        m[cell[which == i]] = value[which == i]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, (u, real) = batch.column(0).to_numpy(zero_copy_only=False), unit(batch)
            for i, k in enumerate(known):
                total = k[:, 1][None, :] - u @ model[i].reshape(len(k), width).T
                # A zero vector would count its distance to itself.
                total[(batch.column(2 + i).to_numpy(zero_copy_only=False)[:, None] == k[:, 0][None, :]) & ~real[:, None]] -= 1.0
                n = len(ids) * len(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids, len(k))), pa.array(np.full(n, i, np.int32)), pa.array(np.tile(k[:, 0], len(ids))), pa.array(np.maximum(total, 0.0).ravel())],
                    names=["row_id", "candidate", "other", "total"])

    return rows.mapInArrow(measure, "row_id bigint, candidate int, other bigint, total double")


def mean_silhouette(points: DataFrame) -> DataFrame:
    return points.groupBy("candidate").agg(F.avg("silhouette").alias("silhouette"))


def scatter(df: DataFrame, by: str = "cluster", weight: str | None = None) -> DataFrame:
    """``<by>, n, centre, spread``: weighted size, centre and mean distance to the centre of every group.

    The centres of all groups form a small model that goes to the tasks; its size is checked, and a larger
    one is joined instead.
    """
    table = centroids(df, by=by, weight=weight).withColumnRenamed("cluster", by)
    size = table.agg(F.sum(F.size("centre")).alias("cells")).first()["cells"] or 0
    w = F.col(weight) if weight else F.lit(1.0)
    if size * 8 > MODEL_BYTES:
        joined = df.join(table, by)
        spread = joined.groupBy(by).agg((F.sum(w * vec.euclidean(F.col("v"), F.col("centre"))) / F.sum(w)).alias("spread"))
        return table.join(spread, by)
    model = table.select(by, "centre").toArrow()
    ids, centre = model.column(by).to_numpy(), vec.matrix(model.column("centre"))
    order = np.argsort(ids)
    ids, centre = ids[order], centre[order]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(len(ids)), np.zeros(len(ids))
        for batch in batches:
            if batch.num_rows:
                place = np.searchsorted(ids, batch.column(1).to_numpy(zero_copy_only=False))
                share = batch.column(2).to_numpy(zero_copy_only=False)
                d = np.sqrt(((vec.matrix(batch.column(0)) - centre[place]) ** 2).sum(axis=1))
                total += np.bincount(place, share * d, minlength=len(ids))
                seen += np.bincount(place, share, minlength=len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total), pa.array(seen)], names=["g", "t", "s"])

    plain = df.filter(w > 0).select("v", F.col(by).cast("bigint").alias("g"), w.cast("double").alias("w"))
    parts = plain.mapInArrow(sums, "g bigint, t double, s double")
    spread = parts.groupBy(F.col("g").alias(by)).agg((F.sum("t") / F.sum("s")).alias("spread"))
    return table.join(spread, by)


def davies_bouldin(df: DataFrame, weight: str | None = None) -> DataFrame:
    """One row ``davies_bouldin``. Pairs of clusters are formed from the cluster table only."""
    return davies_bouldin_of(scatter(df, "cluster", weight).withColumn("run", F.lit(0)), "cluster").select("davies_bouldin")


def davies_bouldin_of(table: DataFrame, cluster: str) -> DataFrame:
    """``run, davies_bouldin`` from ``run, <cluster>, centre, spread`` rows."""
    left = table.select("run", F.col(cluster).alias("i"), F.col("centre").alias("ci"), F.col("spread").alias("si"))
    right = table.select("run", F.col(cluster).alias("j"), F.col("centre").alias("cj"), F.col("spread").alias("sj"))
    ratio = F.try_divide(F.col("si") + F.col("sj"), vec.euclidean(F.col("ci"), F.col("cj")))
    worst = left.join(right, "run").filter("i <> j").groupBy("run", "i").agg(F.max(F.coalesce(ratio, F.lit(0.0))).alias("worst"))
    return worst.groupBy("run").agg(F.avg("worst").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, weight: str | None = None) -> DataFrame:
    """One row ``calinski_harabasz, per_row`` from one pass of per-dimension sums."""
    parts = dimension_moments(df, by="cluster", weight=weight).withColumn("run", F.lit(0))
    return calinski_harabasz_of(parts).select("calinski_harabasz", "per_row")


def calinski_harabasz_of(parts: DataFrame) -> DataFrame:
    """``run, calinski_harabasz, per_row`` from ``run, cluster, dim, n, total, m2`` rows."""
    by_dim = parts.groupBy("run", "dim").agg(
        F.sum("m2").alias("w"), (F.sum(F.col("total") * F.col("total") / F.col("n")) - F.sum("total") * F.sum("total") / F.sum("n")).alias("b"),
        F.sum("n").alias("n"), F.count_distinct(F.col("cluster")).alias("k"))
    sums = by_dim.groupBy("run").agg(F.sum("w").alias("w"), F.sum("b").alias("b"), F.max("n").alias("n"), F.max("k").alias("k"))
    between = F.try_divide("b", F.col("k") - 1)
    value = F.when(F.col("w") == 0, F.lit(1.0)).otherwise(F.try_divide(between, F.col("w") / (F.col("n") - F.col("k"))))
    return sums.select("run", value.alias("calinski_harabasz"), (value / F.col("n")).alias("per_row"), "n", "k")


def dunn_index(df: DataFrame, max_points: int | None = None, seed: int = 42) -> DataFrame:
    """One row ``dunn``: smallest separation over largest diameter, on a stratified sample if ``max_points`` is set."""
    from segmentry.operators.sampling import sample_per_group

    if max_points is not None:
        clusters = df.select("cluster").distinct().count()
        df = sample_per_group(df, "row_id", "cluster", max(2, max_points // max(clusters, 1)), seed, "dunn")
    return dunn_of(separation(df)).select("dunn")


def dunn_of(parts: DataFrame) -> DataFrame:
    """``candidate, dunn`` from separations; NULL without a second cluster or with a zero diameter."""
    known = (F.col("max_diameter") > 0) & (F.col("min_separation") < float("inf"))
    return parts.select("candidate", F.when(known, F.col("min_separation") / F.col("max_diameter")).alias("dunn"))


# --- Many labelings and many weightings in one pass -----------------------------------------------

RUN = 100_000  # run number = labeling index * RUN + repeat


def _plain(df: DataFrame, names: Sequence[str], weights: str | None) -> DataFrame:
    w = F.col(weights).cast("array<double>") if weights else F.array(F.lit(1.0))
    return df.select(F.col("v").cast("array<double>").alias("v"), w.alias("w"), *[F.col(c).cast("bigint").alias(c) for c in names])


def _members(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(labeling index, cluster, row positions, their weights rows x repeats) of a batch."""
    w = vec.matrix(batch.column(1))
    for i in range(len(names)):
        labels = batch.column(2 + i).to_numpy(zero_copy_only=False)
        for c in np.unique(labels[labels >= 0]):
            rows = np.flatnonzero(labels == c)
            yield i, int(c), rows, w[rows]


def labeling_moments(df: DataFrame, names: Sequence[str], weights: str | None = None) -> DataFrame:
    """``run, cluster, dim, n, total, m2`` of every labeling and every entry of the weight array."""
    names = list(names)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        shift = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = vec.matrix(batch.column(0))
            shift = x.mean(axis=0) if shift is None else shift
            x = x - shift
            for i, c, rows, w in _members(batch, names):
                part = [w.sum(axis=0), w.T @ x[rows], w.T @ (x[rows] ** 2)]
                known = found.get((i, c))
                found[i, c] = part if known is None else [a + b for a, b in zip(known, part)]
        for (i, c), (n, s, q) in found.items():
            use = np.flatnonzero(n > 0)
            d = s.shape[1]
            n, s, q = n[use][:, None], s[use], q[use]
            m2, total = np.maximum(q - s * s / n, 0.0), s + n * shift
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(i * RUN + use, d).astype(np.int64)), pa.array(np.full(len(use) * d, c)), pa.array(np.tile(np.arange(1, d + 1), len(use))),
                 pa.array(np.repeat(n[:, 0], d)), pa.array(total.ravel()), pa.array(m2.ravel())], names=["run", "cluster", "dim", "n", "s", "m2"])

    parts = _plain(df, names, weights).mapInArrow(sums, "run bigint, cluster bigint, dim bigint, n double, s double, m2 double")
    summed = parts.groupBy("run", "cluster", "dim").agg(
        F.sum("n").alias("n"), F.sum("s").alias("total"), F.sum("m2").alias("m2"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"))
    spread = F.greatest(F.col("m2") + F.col("q") - F.col("total") * F.col("total") / F.col("n"), F.lit(0.0))
    return summed.select("run", "cluster", "dim", "n", "total", spread.alias("m2"))


def labeling_scatter(df: DataFrame, names: Sequence[str], moments: DataFrame, weights: str | None = None) -> DataFrame:
    """``run, cluster, centre, spread`` with the weighted mean distance to the centre.

    The centres (labelings x repeats x clusters x dimensions) are a parameter-sized model and go to the tasks.
    """
    names = list(names)
    cells = F.transform(F.array_sort(F.collect_list(F.struct("dim", (F.col("total") / F.col("n")).alias("x")))), lambda c: c["x"])
    table = cut_lineage(moments.groupBy("run", "cluster").agg(cells.alias("centre")))
    got = table.toArrow()
    if got.nbytes > MODEL_BYTES:
        raise ValueError("too many centres for one pass; score fewer labelings or repeats at once")
    model: dict[tuple[int, int], dict[int, np.ndarray]] = {}
    for run, cluster, centre in zip(got.column("run").to_pylist(), got.column("cluster").to_pylist(), vec.matrix(got.column("centre"))):
        model.setdefault((run // RUN, cluster), {})[run % RUN] = centre

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = vec.matrix(batch.column(0))
            for i, c, rows, w in _members(batch, names):
                repeats = sorted(model[i, c])
                d = vec.distances(x[rows], np.stack([model[i, c][k] for k in repeats]))
                share = w[:, repeats]
                part = np.stack([(share * d).sum(axis=0), share.sum(axis=0)])
                found[i, c] = found[i, c] + part if (i, c) in found else part
        for (i, c), part in found.items():
            runs = i * RUN + np.array(sorted(model[i, c]), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs), pa.array(np.full(len(runs), c)), pa.array(part[0]), pa.array(part[1])], names=["run", "cluster", "t", "n"])

    parts = _plain(df, names, weights).mapInArrow(sums, "run bigint, cluster bigint, t double, n double")
    spread = parts.groupBy("run", "cluster").agg((F.sum("t") / F.sum("n")).alias("spread"))
    return table.join(spread, ["run", "cluster"])


def labeling_metrics(df: DataFrame, names: Sequence[str], weights: str | None = None) -> DataFrame:
    """``candidate, repeat, davies_bouldin, calinski_harabasz, per_row`` of all labelings and weightings in two passes."""
    moments = cut_lineage(labeling_moments(df, names, weights))
    db = davies_bouldin_of(labeling_scatter(df, names, moments, weights), "cluster")
    both = calinski_harabasz_of(moments).select("run", "calinski_harabasz", "per_row").join(db, "run")
    name = F.element_at(F.array(*[F.lit(c) for c in names]), F.floor(F.col("run") / RUN).cast("int") + 1)
    return both.select(name.alias("candidate"), (F.col("run") % RUN).cast("int").alias("repeat"), "davies_bouldin", "calinski_harabasz", "per_row")


def score_labelings(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cluster facts and the four internal metrics of every label column of ``row_id, v, ...``; noise is left out.

    Two passes over the pairs (distance sums, separations) and two over the rows serve all labelings.
    """
    from segmentry.operators.profiling import balance

    names = list(names)
    long = unpivot(df, names, ["row_id"], "bigint").withColumnRenamed("column", "candidate").withColumnRenamed("value", "cluster")
    noise = long.groupBy("candidate").agg(F.avg((F.col("cluster") < 0).cast("double")).alias("noise_fraction"), F.count_if(F.col("cluster") >= 0).alias("evaluated_rows"))
    facts = noise.join(balance(long, ["candidate"], ignore_noise=True), "candidate", "left")
    metrics = labeling_metrics(df, names).drop("repeat", "per_row")
    parts = [facts, mean_silhouette(silhouette_points(df, names)), metrics, dunn_of(separation(df, names)).withColumnRenamed("dunn", "dunn_approx")]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "candidate", "left")
    usable = (F.col("clusters_found") >= 2) & (F.col("clusters_found") < F.col("evaluated_rows"))
    return out.withColumns({c: F.when(usable, F.col(c)) for c in ("silhouette", "davies_bouldin", "calinski_harabasz", "dunn_approx")})


def internal_metrics(df: DataFrame, dunn_points: int | None = 1200, seed: int = 42) -> DataFrame:
    """One row: cluster facts and the four internal metrics of ``row_id, v, cluster``; noise (-1) is left out.

    A degenerate labeling (fewer than two clusters, or as many clusters as rows) gives NULL metrics.
    """
    from segmentry.operators.profiling import balance

    whole = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("cluster") >= 0).alias("evaluated_rows"))
    kept = df.filter(F.col("cluster") >= 0)
    facts = balance(kept)
    joined = _one_row(whole, facts)
    state = joined.first()
    noise = 1 - F.col("evaluated_rows") / F.col("rows")
    joined = joined.withColumn("noise_fraction", noise).drop("rows")
    if state["clusters_found"] < 2 or state["clusters_found"] >= state["evaluated_rows"]:
        empty = {c: F.lit(None).cast("double") for c in ("silhouette", "davies_bouldin", "calinski_harabasz", "dunn_approx")}
        return joined.withColumns(empty)
    return _one_row(
        joined, mean_silhouette(silhouette_points(kept)).select("silhouette"), davies_bouldin(kept),
        calinski_harabasz(kept).select("calinski_harabasz"), dunn_index(kept, dunn_points, seed).withColumnRenamed("dunn", "dunn_approx"))


def _one_row(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Put one-row tables side by side."""
    out = first.withColumn("__all", F.lit(0))
    for table in rest:
        out = out.join(F.broadcast(table.withColumn("__all", F.lit(0))), "__all")
    return out.drop("__all")


# --- Agreement of labelings -----------------------------------------------------------------------


def labeling_pairs(bundle: DataFrame, name: str = "candidate") -> DataFrame:
    """Contingency counts ``a_name, b_name, a, b, n`` of every pair of labelings of a long bundle.

    A row's labels are gathered first (as many as there are labelings), so the counts combine before the shuffle.
    """
    rows = bundle.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), "cluster"))).alias("labels"))
    first = rows.select("labels", F.explode("labels").alias("x"))
    cells = first.select(F.col("x"), F.explode(F.filter("labels", lambda y: y["name"] > F.col("x")["name"])).alias("y"))
    return cells.groupBy(
        F.col("x.name").alias("a_name"), F.col("y.name").alias("b_name"), F.col("x.cluster").alias("a"), F.col("y.cluster").alias("b")
    ).agg(F.count(F.lit(1)).alias("n"))


def contingency(df: DataFrame, a: str, b: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(n.alias("n"))


def adjusted_rand(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., ari`` from contingency counts."""

    def pairs(n):
        return n * (n - 1) / 2

    keys = list(by) or ["__all"]
    cells = cells if by else cells.withColumn("__all", F.lit(0))
    n = F.col("n").cast("double")
    both = cells.groupBy(*keys).agg(F.sum(pairs(n)).alias("both"), F.sum(n).alias("total"))
    sides = {s: cells.groupBy(*keys, s).agg(F.sum(n).alias("n")).groupBy(*keys).agg(F.sum(pairs(F.col("n"))).alias(f"in_{s}")) for s in "ab"}
    table = both.join(sides["a"], keys).join(sides["b"], keys)
    expected = F.try_divide(F.col("in_a") * F.col("in_b"), pairs(F.col("total")))
    top = (F.col("in_a") + F.col("in_b")) / 2
    ari = F.coalesce(F.try_divide(F.col("both") - expected, top - expected), F.lit(1.0))
    return table.select(*by, ari.alias("ari"))


def normalized_mutual_information(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., nmi`` with the arithmetic mean of the entropies."""
    keys = list(by) or ["__all"]
    cells = cells if by else cells.withColumn("__all", F.lit(0))
    n = F.col("n").cast("double")
    cells = cells.withColumn("n", n)
    total = cells.groupBy(*keys).agg(F.sum("n").alias("total"))
    a = cells.groupBy(*keys, "a").agg(F.sum("n").alias("na"))
    b = cells.groupBy(*keys, "b").agg(F.sum("n").alias("nb"))

    def entropy(table, c):
        p = F.col(c) / F.col("total")
        return table.join(total, keys).groupBy(*keys).agg((-F.sum(p * F.ln(p))).alias(f"h_{c}"), F.count(F.lit(1)).alias(f"k_{c}"))

    joint = cells.join(a, [*keys, "a"]).join(b, [*keys, "b"]).join(total, keys)
    mutual = joint.groupBy(*keys).agg(F.sum(n / F.col("total") * F.ln(n * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"))
    table = mutual.join(entropy(a, "na"), keys).join(entropy(b, "nb"), keys)
    mean = (F.col("h_na") + F.col("h_nb")) / 2
    value = F.when((F.col("k_na") == 1) & (F.col("k_nb") == 1), F.lit(1.0)).otherwise(
        F.coalesce(F.try_divide(F.greatest("mi", F.lit(0.0)), mean), F.lit(0.0)))
    return table.select(*by, value.alias("nmi"))


def pairwise_ari(bundle: DataFrame, name: str = "candidate") -> DataFrame:
    """``a_name, b_name, ari`` for every pair of labelings."""
    return adjusted_rand(labeling_pairs(bundle, name), ["a_name", "b_name"])


def ari_summary(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population sd and minimum of pairwise agreement."""
    return pairs.groupBy(*by).agg(F.avg("ari").alias("mean"), F.stddev_pop("ari").alias("std"), F.min("ari").alias("min"))


def proxy_association(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """NMI of the clusters with interpretive columns, and the number of categories of each; association only."""
    long = unpivot(df, columns, [cluster], "string").select(
        F.col("column").alias("proxy"), F.coalesce("value", F.lit("Missing")).alias("category"), cluster)
    cells = contingency(long, "category", cluster, ["proxy"])
    nmi = normalized_mutual_information(cells, ["proxy"]).withColumnRenamed("nmi", "normalized_mutual_information")
    return nmi.join(cells.groupBy("proxy").agg(F.count_distinct(F.col("a")).alias("categories")), "proxy")


def co_clustering(bundle: DataFrame, sample: DataFrame, name: str = "candidate") -> DataFrame:
    """Share of labelings that put two sampled rows together: ``a_id, b_id, share``, ``a_id < b_id``.

    The pair table is the result asked for, so the sample decides its size.
    """
    kept = bundle.join(sample.select("row_id"), "row_id", "left_semi")
    runs = kept.select(name).distinct().agg(F.count(F.lit(1)).alias("runs")).withColumn("__all", F.lit(0))
    x = kept.select(name, "cluster", F.col("row_id").alias("a_id"))
    y = kept.select(name, "cluster", F.col("row_id").alias("b_id"))
    together = x.join(y, [name, "cluster"]).filter("a_id < b_id").groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("n"))
    return together.withColumn("__all", F.lit(0)).join(F.broadcast(runs), "__all").select("a_id", "b_id", (F.col("n") / F.col("runs")).alias("share"))


# Signs of one hash: the bits of an md5 digest.
_FLIPS = 128


def _flip_sums(df: DataFrame, repeats: int, seed: int) -> DataFrame:
    """``repeat, total, n`` of ``k, d``: the sum of ``d`` under the signs of every repeat.

    Bit ``r % 128`` (first bit of the first byte first) of ``md5(seed:flip:r / 128:k)`` is the sign of a row in repeat ``r``. Spark hashes
    the words, a task multiplies a batch with its bits and returns one row per repeat.
    """
    blocks = -(-repeats // _FLIPS)
    words = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: draw_key(seed, "flip", b, F.col("k")))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(blocks * _FLIPS), 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            d = batch.column(0).to_numpy(zero_copy_only=False)
            packed = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(len(d), blocks, _FLIPS // 8)
            for b in range(blocks):
                bits = np.unpackbits(np.ascontiguousarray(packed[:, b]), axis=1)
                total[b * _FLIPS : (b + 1) * _FLIPS] += d @ (2.0 * bits - 1.0)
            rows += len(d)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(repeats)), pa.array(total[:repeats]), pa.array(np.full(repeats, rows))], names=["repeat", "total", "n"])

    parts = df.select(F.col("d").cast("double").alias("d"), F.unhex(F.array_join(words, "")).alias("w"))
    return parts.mapInArrow(sums, "repeat bigint, total double, n bigint").groupBy("repeat").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def sign_flip_test(df: DataFrame, difference: str, key: str, repeats: int, seed: int) -> DataFrame:
    """Two-sided paired randomisation test of a mean difference: ``observed, pvalue``.

    Every repeat flips each row's sign by hash; 128 repeats share a hash, and a task sends one row per repeat.
    """
    from segmentry.functions.numeric import finite

    clean = df.select(F.col(key).alias("k"), finite(F.col(difference)).alias("d")).filter(F.col("d").isNotNull())
    observed = clean.agg(F.round(F.abs(F.avg("d")), 12).alias("observed")).withColumn("__all", F.lit(0))
    means = _flip_sums(clean, repeats, seed).filter("n > 0").select(F.round(F.abs(F.col("total") / F.col("n")), 12).alias("m"))
    extreme = means.withColumn("__all", F.lit(0)).join(F.broadcast(observed), "__all").groupBy("observed").agg(
        F.count_if(F.col("m") >= F.col("observed")).alias("extreme"))
    return extreme.select("observed", ((F.col("extreme") + 1) / (repeats + 1)).alias("pvalue"))


def bootstrap_metrics(df: DataFrame, points: DataFrame, weights: DataFrame, reference: str) -> DataFrame:
    """``candidate, repeat, metric, value`` of five metrics over all bootstrap repeats at once.

    ``df``: ``row_id, v`` and one integer label column per candidate; ``points``: point silhouettes computed once;
    ``weights``: ``repeat, row_id, weight``. Draws that keep fewer than two clusters are skipped.
    """
    names = [c for c in df.columns if c not in ("row_id", "v")]
    labels = unpivot(df, names, ["row_id", reference], "bigint").select(
        "row_id", F.col("column").alias("candidate"), F.col("value").alias("cluster"), F.col(reference).alias("reference"))
    drawn = labels.join(weights, "row_id")
    clusters = drawn.groupBy("candidate", "repeat").agg(F.count_distinct(F.col("cluster")).alias("k")).filter("k > 1")
    silhouette = points.select("row_id", "candidate", "silhouette").join(weights, "row_id").groupBy("candidate", "repeat").agg(
        (F.sum(F.col("silhouette") * F.col("weight")) / F.sum("weight")).alias("silhouette"))
    cells = contingency(drawn, "cluster", "reference", ["candidate", "repeat"], "weight")
    by = ["candidate", "repeat"]
    external = adjusted_rand(cells, by).withColumnRenamed("ari", "ari_vs_reference").join(
        normalized_mutual_information(cells, by).withColumnRenamed("nmi", "nmi_vs_reference"), by)
    # Draw counts become one weight array per row, so no vector is copied per repeat.
    last = weights.agg(F.max("repeat").alias("r")).first()["r"]
    counts = weights.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("repeat", F.col("weight").cast("double")))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    weighted = cut_lineage(df.join(counts, "row_id").withColumn("__w", dense).drop("m"))
    internal = labeling_metrics(weighted, names, "__w").select(*by, F.col("per_row").alias("calinski_harabasz_per_row"), "davies_bouldin")
    wide = clusters.select(*by).join(silhouette, by).join(external, by).join(internal, by)
    metrics = ["silhouette", "calinski_harabasz_per_row", "davies_bouldin", "ari_vs_reference", "nmi_vs_reference"]
    return unpivot(wide, metrics, by, "double").select(*by, F.col("column").alias("metric"), "value")
