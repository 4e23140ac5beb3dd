"""Site-relative line removal: drop the lines that too many pages of one host share.

A line counts once per page. Its share is the number of pages of the host that hold it over all pages of the host.
Lines whose share is above the ratio, on at least ``min_pages`` pages, are boilerplate of that host.

The number of boilerplate lines of a host is bounded by (mean lines per page) / ratio, whatever its size, so each
host's set is one array. It is broadcast if the count of all of them is small and joined by host otherwise.

Defined results: a null text stays null and an empty one empty; a null host is a host of its own; blank lines (white
space only) are never dropped; repeated rows are separate pages; a page that loses every line keeps an empty text;
an empty table gives an empty result; other columns pass through, but names that begin with two underscores are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.llm.common import BROADCAST_ROWS, without_reserved, written

RATIO = 0.02
MIN_PAGES = 4


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _line_hash(line: Column) -> Column:
    """64 bits; a host's set is small, so a chance hit on it is below 1e-15 for a line."""
    return F.xxhash64(line, F.length(line))


def host_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, drops`` (line hashes) of every host that has boilerplate.

    The counts combine before the shuffle; a host's page total is the count of a mark that every page carries
    besides its lines, so lines and totals come from one grouping.
    """
    own = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda s: F.trim(s) != ""), _line_hash))
    marked = pages.select(F.col(host).alias("host"), F.explode(F.concat(F.array(F.lit(None).cast("bigint")), F.coalesce(own, F.array().cast("array<bigint>")))).alias("h"))
    counts = written(marked.groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= min_pages) | F.col("h").isNull()))
    totals = counts.filter("h is null").select(F.col("host").alias("of"), F.col("n").alias("pages"))
    over = counts.filter("h is not null").join(totals, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return over.groupBy("host").agg(F.sort_array(F.collect_list("h")).alias("drops"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with the boilerplate lines of their hosts removed from ``text`` and, last, the number of them."""
    pages = without_reserved(pages)
    sets = written(host_boilerplate(pages, host, text, ratio, min_pages))
    n_hashes = sets.agg(F.coalesce(F.sum(F.size("drops")), F.lit(0))).first()[0]
    sets = sets.select(F.col("host").alias("__host"), F.col("drops").alias("__drops"))
    if n_hashes <= BROADCAST_ROWS:
        sets = F.broadcast(sets)
    joined = pages.join(sets, F.col(host).eqNullSafe(F.col("__host")), "left").withColumn("__lines", _lines(F.col(text)))
    stays = F.filter("__lines", lambda s: ~F.array_contains(F.col("__drops"), _line_hash(s)) | (F.trim(s) == ""))
    joined = joined.withColumn("__stays", F.when(F.col("__drops").isNotNull() & F.col("__lines").isNotNull(), stays).otherwise(F.col("__lines")))
    removed = F.coalesce(F.size("__lines") - F.size("__stays"), F.lit(0)).cast("bigint").alias("__removed")
    columns = [F.when(F.size("__stays") < F.size("__lines"), F.array_join("__stays", "\n")).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in pages.columns]
    return joined.select(*columns, removed)
