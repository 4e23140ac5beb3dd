"""Reduced tables that grow with the data: a tree of mergeable clustering features with leaves of bounded radius."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.session import cut_lineage

# Nodes of a round (four numbers each) that are broadcast to the rows; more are joined by a shuffle.
BROADCAST_NODES = 100_000

@dataclass
class Leaves:
    """``items``: ``row_id`` (lowest member), ``v`` (centre), ``weight`` (rows), ``inner`` (summed squared distance to the centre);
    ``members``: ``row_id, leaf``; ``total``: summed squared distance of all rows to their mean."""

    items: DataFrame
    members: DataFrame
    total: float

    def loss(self) -> DataFrame:
        """One row ``leaves, rows, lost``: the share of the spread inside the leaves, which a reduced table does not show."""
        sums = self.items.agg(F.count(F.lit(1)).alias("leaves"), F.coalesce(F.sum("weight"), F.lit(0)).alias("rows"), F.sum("inner").alias("inner"))
        return sums.select("leaves", "rows", F.coalesce(F.try_divide("inner", F.lit(self.total)), F.lit(0.0)).alias("lost"))


def feature_tree(df: DataFrame, radius: float) -> Leaves:
    """Split ``row_id, v`` until every leaf's root mean square distance to its centre is at most ``radius``.

    A node above it is cut in the middle of its widest dimension (the first of equal ones), so equal vectors share a leaf and the
    tree does not depend on the order of the rows. A round sums count, mean, centred squares and range per (node, dimension), which merge
    inside the tasks; only rows of open nodes go on. The number of rounds and leaves has no limit. Vectors must have one length;
    null vectors and components that are null or not finite are an error. An empty table has no leaves.
    """
    broken = F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    sound = F.when(broken, F.raise_error(F.lit("vectors need finite components")).cast("array<double>")).otherwise(F.col("v"))
    live = cut_lineage(df.select("row_id", F.col("v").cast("array<double>").alias("v")).select("row_id", sound.alias("v"), F.lit(0).cast("bigint").alias("node")))
    items, members, total = [], [], None
    while True:
        # Children are numbered in a written table, so that every later reading gives the same numbers.
        facts = cut_lineage(_node_facts(live, radius).withColumn("child", 2 * F.monotonically_increasing_id()))
        size = facts.agg(F.count(F.lit(1)).alias("nodes"), F.count("cut").alias("open"), F.sum("inner").alias("inner")).first()
        total = size["inner"] or 0.0 if total is None else total
        side = F.broadcast if size["nodes"] <= BROADCAST_NODES else lambda table: table
        done = facts.filter("cut IS NULL")
        items.append(done.select(F.col("lowest").alias("row_id"), "v", F.col("n").alias("weight"), "inner"))
        members.append(live.join(side(done.select("node", F.col("lowest").alias("leaf"))), "node").select("row_id", "leaf"))
        if size["open"] == 0:
            break
        splits = facts.filter("cut IS NOT NULL").select("node", "dim", "cut", "child")
        right = (F.element_at("v", F.col("dim")) > F.col("cut")).cast("bigint")
        live = cut_lineage(live.join(side(splits), "node").select("row_id", "v", (F.col("child") + right).alias("node")))
    return Leaves(cut_lineage(reduce(DataFrame.unionByName, items)), reduce(DataFrame.unionByName, members), total)


def _node_facts(live: DataFrame, radius: float) -> DataFrame:
    """``node, n, lowest, inner, v, dim, cut`` of every node; ``cut`` is null where the node is a leaf."""
    cells = live.select("node", "row_id", F.posexplode("v").alias("dim", "x"))
    by_dimension = cells.groupBy("node", "dim").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("lowest"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"),
        F.min("x").alias("low"), F.max("x").alias("high"))
    widest = F.max_by(F.struct((F.col("dim") + 1).alias("dim"), "low", "high"), F.struct((F.col("high") - F.col("low")).alias("e"), (-F.col("dim")).alias("d")))
    centre = F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda c: c["mean"])
    nodes = by_dimension.groupBy("node").agg(
        F.max("n").alias("n"), F.min("lowest").alias("lowest"), (F.sum("variance") * F.max("n")).alias("inner"), centre.alias("v"), widest.alias("w"))
    low, high = F.col("w.low"), F.col("w.high")
    middle = low + (high - low) / 2
    # Between neighbouring doubles the middle is one of them.
    cut = F.when(middle < high, middle).otherwise(low)
    open_node = (F.col("inner") / F.col("n") > F.lit(radius * radius)) & (high > low)
    return nodes.select("node", "n", "lowest", "inner", "v", F.col("w.dim").alias("dim"), F.when(open_node, cut).alias("cut"))
