"""Expressions and small helpers that several operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.session import cut_lineage

# Tables of at most this many rows are broadcast by the operators that check a size first.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe against lost executors."""
    return cut_lineage(df)


def without_reserved(df: DataFrame) -> DataFrame:
    """``df`` without columns whose names begin with two underscores, which the operators use for themselves."""
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count finds at most ``limit`` rows; a plain join side otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_key(text: Column) -> Column:
    """32-byte content address of a text; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def letter_spaced(text: Column) -> Column:
    """Lower-case runs of letters and digits, one space between them; empty for a null or wordless text."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def ascii_spaced(text: Column) -> Column:
    """Runs of characters other than ASCII white space, A-Z in lower case, one space between them."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"[\x20\x09-\x0D]+", " "))


def split_words(spaced: Column) -> Column:
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def letter_words(text: Column) -> Column:
    return split_words(letter_spaced(text))


def shingle_hashes(words: Column, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` words, in order; a shorter text is one shingle, no words are none.

    The shifted word lists are zipped, so that the lambda reads its own argument only: wherever the optimizer moves
    this expression, the words are not computed again for each shingle.
    """
    many = F.greatest(F.size(words) - (size - 1), F.lit(0))
    runs = F.transform(F.arrays_zip(*[F.slice(words, k + 1, many) for k in range(size)]), lambda z: F.xxhash64(*[z[str(k)] for k in range(size)]))
    return F.when(F.size(words) >= size, runs).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def draw(seed: int, *columns: Column | str) -> Column:
    """Uniform number in [0, 1) that depends on the values only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") / F.lit(float(1 << 53))


def held_out(doc_id: Column) -> Column:
    """True for documents that no fit may learn from: crc32 of the id's text has remainder 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
