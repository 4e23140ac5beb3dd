"""Text and label functions (blank handling, guarded numbers, delimited labels)."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boundary labels of an experience question, in years.
EXPERIENCE_LABELS = {"Less than 1 year": 0.5, "More than 50 years": 51.0}

# Organisation size ranges and the number that stands for each.
ORGANISATION_SIZES = {
    "Just me - I am a freelancer, sole proprietor, etc.": 1.0,
    "2 to 9 employees": 5.5,
    "10 to 19 employees": 14.5,
    "20 to 99 employees": 59.5,
    "100 to 499 employees": 299.5,
    "500 to 999 employees": 749.5,
    "1,000 to 4,999 employees": 2999.5,
    "5,000 to 9,999 employees": 7499.5,
    "10,000 or more employees": 10000.0,
}

NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(c: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def to_number(c: Column) -> Column:
    """Double, or NULL for text that is not a plain number."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def lookup(c: Column, mapping: Mapping[str, object]) -> Column:
    """Value of a small fixed mapping, NULL when the key is absent."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(pairs, c)


def parse_experience(c: Column, low: float = 0.0, high: float = 51.0) -> Column:
    years = F.coalesce(lookup(strip(c), EXPERIENCE_LABELS), to_number(c))
    return F.when(years.between(low, high), years)


def split_labels(c: Column, separator: str = ";") -> Column:
    """Sorted distinct non-empty labels of a delimited text; NULL gives an empty array."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), separator), strip)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def label_breadth(c: Column, separator: str = ";") -> Column:
    return F.size(split_labels(c, separator))


def domain_of(column_name: str, suffix: str = "HaveWorkedWith") -> str:
    return column_name.replace(suffix, "")


def feature_name(block: str, domain: Column, item: Column) -> Column:
    return F.concat_ws("__", F.lit(block), domain, item)


def label_of_feature(name: Column) -> Column:
    """Last part of ``block__domain__label``; other names stay as they are."""
    parts = F.split(name, "__", 3)
    return F.when(F.size(parts) == 3, F.element_at(parts, 3)).otherwise(name)


def percent_text(share: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(share * 100, digits), F.lit("%"))
