"""An append-only table of model records: what was fitted on which data, with which metrics, when.

A record's id is the digest of its facts without the time, so a record that a retried job appends again is the same record.
Appending leaves out ids that the table holds; what two jobs append at the same moment is one record to every reader.
Files become visible when a write commits, so a lost writer leaves nothing behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

TIME = "created_at_utc"


def _identified(records: DataFrame) -> DataFrame:
    facts = F.to_json(F.struct(*sorted(c for c in records.columns if c != TIME)), {"ignoreNullFields": "false"})
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    timed = records if TIME in records.columns else records.withColumn(TIME, stamp)
    return timed.withColumn("record_id", F.sha2(facts, 256))


def read_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records with ``record_id``, ``created_at_utc`` and ``version`` (from 1 within ``model``, in order of time, then id).

    ``schema`` is that of the facts. A record that was written twice counts once, with its first time.
    """
    facts = [f for f in schema.fields if f.name != TIME]
    stored = spark.read.schema(StructType([*facts, StructField(TIME, StringType()), StructField("record_id", StringType())])).parquet(path)
    once = stored.groupBy("record_id").agg(F.min_by(F.struct(*[f.name for f in facts], TIME), TIME).alias("r")).select("r.*", "record_id")
    return once.withColumn("version", F.row_number().over(Window.partitionBy("model").orderBy(TIME, "record_id")))


def append_record(record: DataFrame, path: str, expected: int | None = None) -> DataFrame:
    """Append records (with a column ``model``) that the table does not hold; gives all records of the table.

    ``expected`` is the version that the caller takes for the latest of the record's model (0: none yet). If another has been
    appended since, nothing is written and a ``ValueError`` names both versions; a repeated append of the latest record passes.
    """
    spark, schema = record.sparkSession, record.schema
    # A frame of no rows creates the table.
    new = _identified(record)
    new.limit(0).write.mode("append").parquet(path)
    held = read_records(spark, path, schema)
    fresh = new.join(held.select("record_id"), "record_id", "left_anti").select(*new.columns)
    if expected is not None:
        behind = fresh.select("model").distinct().join(held.groupBy("model").agg(F.max("version").alias("latest")), "model", "left")
        for row in behind.filter(F.coalesce("latest", F.lit(0)) != expected).limit(1).collect():
            raise ValueError(f"model {row['model']!r} has version {row['latest'] or 0}, not {expected}")
    fresh.write.mode("append").parquet(path)
    return read_records(spark, path, schema)
