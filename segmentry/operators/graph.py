"""Connected components and minimum spanning trees as rounds of joins and groupings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.operators.pairs import _joined
from segmentry.session import cut_lineage

# Nodes of a partition whose components a task holds before it sends them on.
CONTRACT_NODES = 1 << 20


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 100) -> DataFrame:
    """``row_id, component`` (lowest member id) from ``a_id, b_id`` edges.

    Alternating large-star and small-star rounds: every grouping keeps the minimum neighbour, which combines
    before the shuffle, and the number of rounds grows with the logarithm of the component size. Before the first round each
    partition sends stars in place of its own edges, so edges that lie together need no rounds. The rounds are
    the same for every size of graph.
    """
    plain = edges.select(F.greatest("a_id", "b_id").alias("a"), F.least("a_id", "b_id").alias("b")).filter("a <> b")
    pairs = cut_lineage(_contracted(_contracted(plain).select("a", "b").distinct()))
    lies = pairs.agg(F.max("piece").alias("piece"), F.min("part").alias("first"), F.max("part").alias("last")).first()
    pairs, previous = pairs.select("a", "b"), None
    for _ in range(max_rounds):
        if lies["piece"] in (None, 0) and lies["first"] == lies["last"]:
            break
        pairs = cut_lineage(_small_star(_large_star(pairs)))
        state = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError("connected components did not settle")
    members = pairs.select(F.col("a").alias("row_id"), F.col("b").alias("component"))
    roots = pairs.select(F.col("b").alias("row_id"), F.col("b").alias("component")).distinct()
    return _with_single_nodes(members.unionByName(roots), nodes)


def _contracted(pairs: DataFrame) -> DataFrame:
    """``a > b`` edges, where each ``part`` (and ``piece`` of it) has a star to the lowest member for every component of its own edges."""
    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.array([], np.int64)
        high, low, piece = none, none, 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(high), pa.array(low), pa.array(np.full(len(high), piece, np.int32))], names=["a", "b", "piece"])

        for batch in batches:
            a, b = (np.concatenate([x, batch.column(i).to_numpy(zero_copy_only=False)]) for i, x in enumerate((high, low)))
            ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = _joined(np.arange(len(ids)), ends[: len(a)], ends[len(a) :])
            inner = np.flatnonzero(root != np.arange(len(ids)))
            high, low = ids[inner], ids[root[inner]]
            if len(high) > CONTRACT_NODES:
                yield made()
                high, low, piece = none, none, piece + 1
        yield made()

    whole = pairs.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    return whole.mapInArrow(stars, "a bigint, b bigint, piece int").withColumn("part", F.spark_partition_id())


def _with_single_nodes(found: DataFrame, nodes: DataFrame | None) -> DataFrame:
    if nodes is None:
        return found
    return nodes.select("row_id").join(found, "row_id", "left").withColumn("component", F.coalesce("component", "row_id"))


def _large_star(pairs: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest id around that node."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.filter("a <> b").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(lowest.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def spanning_tree(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Minimum spanning forest of ``a_id, b_id, weight`` (ties by ids), by Boruvka rounds.

    Each round takes the cheapest edge out of every component, joins the components it links
    and drops the edges that became internal, until none is left.
    """
    spark = edges.sparkSession
    live = cut_lineage(edges.select("a_id", "b_id", "weight", F.col("a_id").alias("ca"), F.col("b_id").alias("cb")).filter("ca <> cb"))
    chosen = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        order = F.struct("weight", F.least("a_id", "b_id").alias("x"), F.greatest("a_id", "b_id").alias("y"))
        ends = live.select("a_id", "b_id", "weight", F.explode(F.array("ca", "cb")).alias("c"), "ca", "cb")
        best = ends.groupBy("c").agg(F.min_by(F.struct("a_id", "b_id", "weight", "ca", "cb"), order).alias("e"))
        picked = cut_lineage(best.select("e.*").distinct())
        chosen.append(picked.select("a_id", "b_id", "weight"))
        merged = connected_components(picked.select(F.col("ca").alias("a_id"), F.col("cb").alias("b_id")))
        merged = merged.select(F.col("row_id").alias("old"), F.col("component").alias("new"))
        moved = live
        for side in ("ca", "cb"):
            moved = moved.join(merged.withColumnRenamed("old", side), side, "left").withColumn(side, F.coalesce("new", side)).drop("new")
        cheapest = F.min_by(F.struct("a_id", "b_id", "weight"), order).alias("e")
        live = cut_lineage(
            moved.filter("ca <> cb").groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(cheapest).select("e.*", "ca", "cb"))
    else:
        raise RuntimeError("spanning tree did not finish")
    tree = spark.createDataFrame([], "a_id bigint, b_id bigint, weight double")
    for part in chosen:
        tree = tree.unionByName(part)
    return tree.distinct()
