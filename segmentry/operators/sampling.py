"""Samples, bootstraps and splits as pure functions of the row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmentry.functions.hashing import among_lowest, draw_key, uniform
from segmentry.operators.order import exact_quantiles, positions, running_counts


def sample_n(df: DataFrame, key: str, n: int, seed: int, purpose: str = "sample") -> DataFrame:
    """Fixed-size sample without replacement: the n smallest draw keys (a top-n, no full sort)."""
    return df.withColumn("__draw", draw_key(seed, purpose, F.col(key))).orderBy("__draw").limit(n).drop("__draw")


def sample_per_group(df: DataFrame, key: str, by: str, n: int, seed: int, purpose: str = "strata") -> DataFrame:
    """At most n rows per group; the top-n per group is taken before the shuffle."""
    window = Window.partitionBy(by).orderBy("__draw")
    drawn = df.withColumn("__draw", draw_key(seed, purpose, F.col(key)))
    return drawn.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= n).drop("__draw", "__rank")


def split(df: DataFrame, key: str, fraction: float, seed: int, by: Sequence[str] = (), purpose: str = "split") -> DataFrame:
    """Add ``is_train``: the first floor(fraction * n) rows of each stratum in draw order."""
    drawn = df.withColumn("__u", uniform(seed, purpose, F.col(key))).withColumn("__one", F.lit(1))
    placed = running_counts(drawn, "__u", ["__one"], by)
    train = F.col("__one_before") < F.floor(F.lit(fraction) * F.col("__one_total"))
    return placed.withColumn("is_train", train).select(*df.columns, "is_train")


def bootstrap(df: DataFrame, key: str, size: int, repeats: int, seed: int, purpose: str = "bootstrap") -> DataFrame:
    """Draws with replacement in long form: ``repeat, <key>, weight`` (how often a row was drawn).

    Draw j of repeat r picks the row at position floor(u * n); only (repeat, position, weight) is shuffled.
    """
    spark = df.sparkSession
    placed = positions(df.select(key), key)
    # Draw number and repeat come from one range, so any number of draws is spread over tasks.
    draws = spark.range(size * repeats).select(
        F.floor(F.col("id") / size).cast("int").alias("repeat"), (F.col("id") % size).alias("draw"), F.lit(0).alias("__all"))
    total = df.agg(F.count(F.lit(1)).alias("__n")).withColumn("__all", F.lit(0))
    spot = F.floor(uniform(seed, purpose, F.col("repeat"), F.col("draw")) * F.col("__n"))
    picked = draws.join(F.broadcast(total), "__all").groupBy("repeat", spot.alias("position")).agg(F.count(F.lit(1)).alias("weight"))
    return picked.join(placed, "position").select("repeat", key, "weight")


def nested_bootstrap(df: DataFrame, key: str, base: int, fraction: float, repeats: int, seed: int) -> DataFrame:
    """Per repeat: a sample of ``base`` rows without replacement, then draws from it with replacement."""
    keyed = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    window = Window.partitionBy("repeat").orderBy("__draw")
    ranked = keyed.withColumn("__draw", draw_key(seed, "nested-base", F.col("repeat"), F.col(key)))
    ranked = ranked.filter(among_lowest(F.col("__draw"), base, df.count()))
    kept = ranked.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= base)
    kept = kept.withColumn("position", F.col("__rank") - 1)
    sizes = kept.groupBy("repeat").agg(F.count(F.lit(1)).alias("__n"))
    size = F.floor(F.lit(fraction) * F.col("__n"))
    draws = sizes.filter(size > 0).select("repeat", "__n", F.explode(F.sequence(F.lit(1), size)).alias("draw"))
    spot = F.floor(uniform(seed, "nested-draw", F.col("repeat"), F.col("draw")) * F.col("__n"))
    picked = draws.groupBy("repeat", spot.alias("position")).agg(F.count(F.lit(1)).alias("weight"))
    return kept.join(picked, ["repeat", "position"]).select("repeat", key, "weight")


def uniform_box(bounds: DataFrame, n: int, seed: int, repeats: int = 1) -> DataFrame:
    """``n`` reference points per repeat, uniform in a box given as ``dim, low, high`` rows.

    Returns ``repeat, point, v``.
    """
    box = bounds.agg(F.array_sort(F.collect_list(F.struct("dim", "low", "high"))).alias("__box")).withColumn("__all", F.lit(0))
    points = bounds.sparkSession.range(n * repeats).select(
        F.floor(F.col("id") / n).cast("int").alias("repeat"), (F.col("id") % n).alias("point"), F.lit(0).alias("__all"))
    value = F.transform(
        "__box",
        lambda b: b["low"] + uniform(seed, "box", F.col("repeat"), F.col("point"), b["dim"]) * (b["high"] - b["low"]))
    return points.join(F.broadcast(box), "__all").select("repeat", "point", value.alias("v"))


def split_at_median(df: DataFrame, column: str) -> DataFrame:
    """``side``: 0 for values up to the exact median, 1 above it, NULL for missing values."""
    middle = exact_quantiles(df, column, [0.5]).select(F.col("quantiles")[0].alias("threshold"), F.lit(0).alias("__all"))
    joined = df.withColumn("__all", F.lit(0)).join(F.broadcast(middle), "__all").drop("__all")
    return joined.withColumn("side", F.when(F.col(column) <= F.col("threshold"), 0).when(F.col(column) > F.col("threshold"), 1))
