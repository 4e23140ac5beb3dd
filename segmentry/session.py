"""Session helpers: checkpoint location and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a local master
    without that setting gets a folder of its own; a cluster without it is an error,
    because files on one machine do not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="segmentry-checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder for a stage table, next to the checkpoints."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"


def small_side(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; beyond that a plain join side, whose skew adaptive execution splits.

    The rows are written first, so that the count does not compute them twice.
    """
    held = cut_lineage(df)
    return F.broadcast(held) if held.limit(limit + 1).count() <= limit else held


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table next to the checkpoints and continue from the files.

    A written table also forgets the plan facts (constraints) that ``checkpoint()`` hands on, which
    would otherwise pile up over the rounds of a loop.
    """
    spark = df.sparkSession
    path = stage_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
