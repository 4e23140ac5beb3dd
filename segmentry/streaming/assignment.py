"""Record-at-a-time assignment: the same stateless function serves batches and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.operators.pairs import centre_distances


def assign_with_distances(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add the nearest cluster and one distance column per centre to ``v`` rows; works on ``readStream`` input."""
    found = centre_distances(df, centres)
    best = (F.array_position("distances", F.array_min("distances")) - 1).cast("int")
    columns = {f"distance_cluster_{i}": F.get("distances", F.lit(i)) for i in range(len(centres))}
    return found.withColumn("cluster", best).withColumns(columns).drop("distances")


def stream_assignments(source: DataFrame, centres: np.ndarray, path: str, checkpoint: str):
    """Append assignments of a streaming source to Parquet and return the query; exactly once by file commit log."""
    assigned = assign_with_distances(source, centres)
    return assigned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
