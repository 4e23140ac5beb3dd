"""Row-wise numeric functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 2.2250738585072014e-308


def in_range(c: Column, low: float, high: float) -> Column:
    """Keep inclusive-range values, NULL for the rest."""
    return F.when(c.between(low, high), c)


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
    return F.when(~bad, c)


def missing_flag(c: Column) -> Column:
    return c.isNull().cast("tinyint")


def row_median(*columns: Column) -> Column:
    """Median of the values of a row that are present."""
    values = F.array_sort(F.array_compact(F.array(*columns)))
    n = F.size(values)
    low = F.floor((n + F.lit(1)) / 2).cast("int")
    high = (F.floor(n / 2) + 1).cast("int")
    pair = F.try_element_at(values, low) + F.try_element_at(values, high)
    return F.when(n > 0, pair / 2)


def row_spread(*columns: Column) -> Column:
    return F.greatest(*columns) - F.least(*columns)


def clipped_ratio(top: Column, bottom: Column, floor: float = 0.5, cap: float = 2.0) -> Column:
    ratio = top / F.greatest(bottom, F.lit(floor))
    return F.least(F.greatest(ratio, F.lit(0.0)), F.lit(cap))


def safe_log(c: Column) -> Column:
    return F.ln(F.greatest(c, F.lit(TINY)))


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole)


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)
