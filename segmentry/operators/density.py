"""Density clustering: k-distance curve and DBSCAN on exact neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.operators.graph import connected_components
from segmentry.operators.order import exact_quantiles, positions, running_counts, value_counts
from segmentry.operators.pairs import eps_counts, eps_forest, nearest_core_cluster, self_knn
from segmentry.session import cut_lineage

NOISE = -1


def k_distance(df: DataFrame, k: int = 20) -> DataFrame:
    """``row_id, k_distance``: distance to the k-th neighbour, the row itself counted first."""
    return self_knn(df, k).filter(F.col("rank") == k).select("row_id", F.col("distance").alias("k_distance"))


def k_distance_curve(distances: DataFrame) -> DataFrame:
    """``rank, k_distance`` ascending; ranks come from counts per value, not from one global sort."""
    counted = running_counts(value_counts(distances, "k_distance"), "k_distance", ["n"])
    ranks = F.sequence(F.col("n_before") + 1, F.col("n_before") + F.col("n"))
    return counted.select(F.explode(ranks).alias("rank"), "k_distance")


def eps_candidates(distances: DataFrame, probabilities=(0.85, 0.90, 0.95)) -> list[float]:
    return exact_quantiles(distances, "k_distance", list(probabilities)).first()["quantiles"]


def dbscan(df: DataFrame, eps: float, min_samples: int = 20) -> DataFrame:
    """``row_id, cluster``; noise is -1, clusters are numbered by their lowest core row.

    Core rows have at least ``min_samples`` rows within ``eps``, themselves included. Core rows are linked through
    per-cell star edges, never through a list of close pairs. A border row takes the lowest-numbered cluster in reach.
    """
    rows = df.select("row_id", "v")
    counts = eps_counts(rows, eps)
    core = cut_lineage(rows.join(counts.filter(F.col("within") + 1 >= min_samples), "row_id", "left_semi"))
    linked = connected_components(eps_forest(core, eps), core)
    roots = positions(linked.select("component").distinct(), "component")
    numbered = linked.join(roots, "component").select("row_id", F.col("position").cast("bigint").alias("cluster"))
    marked = cut_lineage(rows.join(numbered, "row_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(NOISE).cast("bigint"))))
    border = nearest_core_cluster(marked, eps)
    joined = marked.select("row_id", "cluster").join(border, "row_id", "left")
    return joined.select("row_id", F.coalesce("border", "cluster").cast("int").alias("cluster"))
