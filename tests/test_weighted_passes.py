"""Weighted passes over written tables."""

from pyspark.sql import functions as F

from segmentry.operators import kmeans, stability
from test_clusters import blobs, frame


def test_bootstrap_passes_read_a_written_table(spark, monkeypatch):
    """The rows of the passes are no join, whose shuffle partitions every pass would read one by one."""
    seen = []
    monkeypatch.setattr(stability, "lloyd", lambda df, *a, **k: seen.append(df) or kmeans.lloyd(df, *a, **k))
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = frame(spark, blobs(300)[0])
        out = stability.bootstrap_k_stability(df, df, [2, 3], 300, 3, 1, n_init=2).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and seen[0].rdd.getNumPartitions() <= 16 and {r["k"] for r in out} == {2, 3}


def test_runs_share_weights_by_place(spark):
    df = frame(spark, blobs(200)[0]).withColumn("w", F.array(F.lit(1.0), (F.col("row_id") % 3).cast("double")))
    starts = kmeans.plus_plus_seeds(df, [3, 3], 5)
    own = kmeans.lloyd(df.withColumn("w", F.array(F.col("w")[1], F.col("w")[0])), starts, weights="w")
    shared = kmeans.lloyd(df, starts, weights="w", entries=[1, 0])
    assert [round(f.inertia, 9) for f in own] == [round(f.inertia, 9) for f in shared]
