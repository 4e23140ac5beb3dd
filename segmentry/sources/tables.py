"""Scans and sinks: Parquet tables, delimited text under a contract, manifests, fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def missing_columns(present: Sequence[str], required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(present))


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail at analysis time, before any data is read, naming every absent column."""
    missing = missing_columns(df.columns, required)
    if missing:
        raise ValueError(f"Required columns missing: {missing}")
    return df


def scan_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str, columns: Sequence[str] | None = None, multi_line: bool = False) -> DataFrame:
    """Delimited scan with a declared schema and a pruned column list.

    Files are split among tasks. Quoted line breaks inside a field need ``multi_line``, which reads each file in one task.
    """
    df = spark.read.schema(schema).csv(path, header=True, multiLine=multi_line, escape='"', enforceSchema=False)
    return require_columns(df, columns).select(*columns) if columns else df


def scan_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Question dictionary with its four named columns."""
    required = ["qname", "question", "type", "selector"]
    return scan_csv(spark, path, ", ".join(f"{c} string" for c in required), required)


def scan_vectors_csv(spark: SparkSession, path: str, dimensions: int, prefix: str = "PC") -> DataFrame:
    """Upload with columns ``PC1..PCd`` as one vector column."""
    header = spark.read.csv(path, header=True)
    names = [f"{prefix}{i}" for i in range(1, dimensions + 1)]
    require_columns(header, names)
    schema = StructType([StructField(c, DoubleType()) for c in header.columns if c in set(names)])
    typed = header.select(*[c for c in header.columns if c not in set(names)], *[F.col(f.name).try_cast("double").alias(f.name) for f in schema])
    return typed.withColumn("v", F.array(*names)).drop(*names)


def require_non_empty(df: DataFrame, key: str) -> DataFrame:
    """One-row check ``rows, keyed_rows``; raises inside Spark when a count is zero."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), F.count(key).alias("keyed_rows"))
    guard = F.when(F.col("keyed_rows") > 0, F.col("keyed_rows")).otherwise(
        F.raise_error(F.lit("empty table or no keyed row")).cast("bigint"))
    return counts.withColumn("keyed_rows", guard)


def write_layer(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a stage table and continue from the files."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def read_csv_back(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, escape='"')


def write_manifest(df: DataFrame, path: str) -> DataFrame:
    """One-row nested record as JSON."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def manifest(spark: SparkSession, facts: Mapping[str, object]) -> DataFrame:
    """Facts of a run with a UTC time stamp."""
    columns = [F.lit(v).alias(k) for k, v in facts.items()]
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return spark.range(1).select(*columns, stamp.alias("created_at_utc"))


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-free table fingerprint: row count, and the sum and xor of a 60-bit slice of each row hash."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in (columns or df.columns)])
    slice_ = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
    hashed = df.select(slice_.alias("h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.bit_xor("h").alias("hash_xor"))
