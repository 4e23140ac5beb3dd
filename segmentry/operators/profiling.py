"""Column profiles, frequency tables, association, correlation, histograms."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.functions import text as txt
from segmentry.operators.order import exact_quantiles, rank_table, unpivot
from segmentry.session import small_side

MISSING = "Missing"


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Type, counts, missing percentage and distinct count per column.

    Exact distinct counts come from a (column, value) grouping that combines before the shuffle.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    long = unpivot(df, columns, cast="string")
    if approximate:
        counted = long.groupBy("column").agg(
            F.count(F.lit(1)).alias("rows"), F.count("value").alias("non_null"),
            F.approx_count_distinct("value").alias("unique_non_null"))
    else:
        values = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        counted = values.groupBy("column").agg(
            F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"),
            F.count("value").alias("unique_non_null"))
    missing = F.col("rows") - F.col("non_null")
    return counted.select(
        "column", txt.lookup(F.col("column"), {c: types[c] for c in columns}).alias("dtype"), "non_null",
        missing.alias("missing_count"), F.bround(100 * missing / F.col("rows"), 3).alias("missing_pct"), "unique_non_null")


def label_prevalence(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows per (group, domain, label) of delimited columns."""
    long = unpivot(df, columns, by).select(*by, F.col("column").alias("domain"), F.explode(txt.split_labels(F.col("value"))).alias("label"))
    return long.groupBy(*by, "domain", "label").agg(F.count(F.lit(1)).alias("respondents"))


def with_share_of(df: DataFrame, part: str, whole: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Percentage of ``part`` in the row count ``rows`` of ``whole`` (per group, or overall)."""
    if by:
        joined = df.join(whole, list(by))
    else:
        joined = df.withColumn("__all", F.lit(0)).join(F.broadcast(whole.withColumn("__all", F.lit(0))), "__all").drop("__all")
    return joined.withColumn(name, 100 * F.col(part) / F.col("rows")).drop("rows")


def row_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def category_distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and percentage per (column, category); NULL counts as its own category."""
    long = unpivot(df, columns, cast="string").select("column", F.coalesce("value", F.lit(MISSING)).alias("category"))
    counts = long.groupBy("column", "category").agg(F.count(F.lit(1)).alias("count"))
    return with_share_of(counts, "count", row_counts(df), [], "pct")


def numeric_summary(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """count, mean, sd, min, exact percentiles, max per column."""
    long = unpivot(df, columns, cast="double").filter(F.col("value").isNotNull())
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    found = exact_quantiles(long, "value", probabilities, ["column"])
    names = [f"p{round(100 * p):02d}" for p in probabilities]
    picked = found.select("column", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(names)])
    return moments.join(picked, "column")


def paired_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Contingency counts ``column_a, column_b, a, b, n`` of every pair of columns, in one grouping."""
    value = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns}
    cells = [
        F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), value[x].alias("a"), value[y].alias("b"))
        for x, y in combinations(columns, 2)
    ]
    return df.select(F.inline(F.array(*cells))).groupBy("column_a", "column_b", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def cramers_v(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bias-corrected Cramer's V of every pair of columns."""
    pair = ["column_a", "column_b"]
    cells = paired_categories(df, columns)
    rows = cells.groupBy(*pair, "a").agg(F.sum("n").alias("row_n"))
    cols = cells.groupBy(*pair, "b").agg(F.sum("n").alias("col_n"))
    ratio = F.col("n") * F.col("n") / (F.col("row_n") * F.col("col_n"))
    stats = cells.join(rows, [*pair, "a"]).join(cols, [*pair, "b"]).groupBy(*pair).agg(
        F.sum("n").alias("n"), (F.sum(ratio) - 1).alias("phi2"),
        F.count_distinct(F.col("a")).alias("r"), F.count_distinct(F.col("b")).alias("c"))
    r, c, less = F.col("r"), F.col("c"), F.greatest(F.col("n") - 1, F.lit(1))
    phi2 = F.greatest(F.lit(0.0), F.col("phi2") - (c - 1) * (r - 1) / less)
    smaller = F.least(c - (c - 1) * (c - 1) / less, r - (r - 1) * (r - 1) / less) - 1
    value = F.when((F.least(r, c) >= 2) & (smaller > 0), F.sqrt(F.try_divide(phi2, smaller))).otherwise(0.0)
    return stats.select(*pair, value.alias("cramers_v"))


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlation of every pair of columns over the rows that have all of them."""
    complete = df.select(*columns).dropna()
    ranked = complete
    for c in columns:
        ranked = ranked.join(small_side(rank_table(complete, c, name=f"__rank_{c}")), c)
    pairs = list(combinations(columns, 2))
    row = ranked.agg(*[F.corr(f"__rank_{a}", f"__rank_{b}").alias(f"__{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"__{i}").alias("spearman")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*cells)))


def _scaled_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Zero-based equal-width bin, the top edge closed."""
    place = F.floor(F.try_divide((value - low) * bins, high - low))
    return F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int")


def histogram(df: DataFrame, value: str, bins: int = 35) -> DataFrame:
    present = df.filter(F.col(value).isNotNull()).withColumn("__all", F.lit(0))
    limits = present.groupBy("__all").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    placed = present.join(F.broadcast(limits), "__all")
    return placed.groupBy(_scaled_bin(F.col(value), F.col("low"), F.col("high"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("low").alias("low"), F.min((F.col("high") - F.col("low")) / bins).alias("width"))


def density_grid(df: DataFrame, x: str, y: str, bins: int = 75) -> DataFrame:
    """Counts on a square grid over two columns, with their log10."""
    flat = df.select(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(0).alias("__all"))
    limits = flat.groupBy("__all").agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low_", F.min), ("high_", F.max))])
    placed = flat.join(F.broadcast(limits), "__all")
    cell = [_scaled_bin(F.col(c), F.col(f"low_{c}"), F.col(f"high_{c}"), bins).alias(f"{c}_bin") for c in "xy"]
    return placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("rows")).withColumn("log10_rows", F.log10("rows"))


def cluster_profile(
    df: DataFrame, cluster: str, numeric: Sequence[str], nominal: Sequence[str], order: str, names: tuple[str, str]
) -> DataFrame:
    """Size, share, medians, modes and a name for the clusters with least and most ``order`` median."""
    from segmentry.operators.order import medians

    from pyspark.sql import Window

    sizes = with_share_of(df.groupBy(cluster).agg(F.count(F.lit(1)).alias("respondents")), "respondents", row_counts(df), [], "share_pct")
    profile = sizes.join(medians(df, numeric, [cluster]), cluster, "left").join(modes(df, nominal, cluster), cluster, "left")
    middle = f"{order}_median"
    up = F.row_number().over(Window.orderBy(F.col(middle), F.col(cluster)))  # one row per cluster
    last = F.max("__place").over(Window.partitionBy())
    profile = profile.withColumn("__place", up).withColumn("__last", last)
    name = F.when(F.col("__place") == F.col("__last"), names[1]).when(F.col("__place") == 1, names[0])
    return profile.withColumn("profile_name", name).drop("__place", "__last")


def modes(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Most frequent value per group and column, the smallest value on ties."""
    long = unpivot(df, columns, [by], "string").withColumn("value", F.coalesce("value", F.lit(MISSING)))
    counts = long.groupBy(by, "column", "value").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(by, "column").agg(F.min_by("value", F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))).alias("mode"))
    return top.groupBy(by).agg(*[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(f"{c}_mode") for c in columns])


def composition(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """Share of each category inside each cluster; absent combinations are present with 0."""
    long = unpivot(df, columns, [cluster], "string").select(
        cluster, F.col("column").alias("attribute"), F.coalesce("value", F.lit(MISSING)).alias("category"))
    counts = long.groupBy(cluster, "attribute", "category").agg(F.count(F.lit(1)).alias("n"))
    sizes = row_counts(df, [cluster])
    # Every category meets every cluster: the cluster list rides on each category row.
    clusters = sizes.agg(F.collect_list(cluster).alias("__clusters")).withColumn("__all", F.lit(0))
    categories = counts.select("attribute", "category").distinct().withColumn("__all", F.lit(0))
    grid = categories.join(F.broadcast(clusters), "__all").select("attribute", "category", F.explode("__clusters").alias(cluster))
    full = grid.join(counts, [cluster, "attribute", "category"], "left").join(sizes, cluster)
    return full.select("attribute", cluster, "category", (F.coalesce("n", F.lit(0)) / F.col("rows")).alias("share"))


def balance(df: DataFrame, by: Sequence[str] = (), cluster: str = "cluster", ignore_noise: bool = False) -> DataFrame:
    """Smallest cluster size and the smallest and largest share, per labeling."""
    kept = df.filter(F.col(cluster) >= 0) if ignore_noise else df
    sizes = kept.groupBy(*by, cluster).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*by).agg(
        F.min("n").alias("minimum_cluster_size"), (F.min("n") / F.sum("n")).alias("minimum_cluster_fraction"),
        (F.max("n") / F.sum("n")).alias("largest_cluster_fraction"), F.count(F.lit(1)).alias("clusters_found"))


def drop_degenerate(df: DataFrame, by: str = "candidate", cluster: str = "cluster") -> DataFrame:
    """Labelings with at least two clusters of at least two rows each."""
    sizes = balance(df, [by], cluster)
    good = sizes.filter((F.col("clusters_found") > 1) & (F.col("minimum_cluster_size") >= 2))
    return df.join(good.select(by), by, "left_semi")


def percentile_interval(df: DataFrame, value: str, confidence: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """Two-sided percentile interval over finite values."""
    from segmentry.functions.numeric import finite

    alpha = (1 - confidence) / 2
    found = exact_quantiles(df.withColumn(value, finite(F.col(value))), value, [alpha, 1 - alpha], by)
    return found.select(*by, F.col("quantiles")[0].alias("ci_lower"), F.col("quantiles")[1].alias("ci_upper"))
