import pytest
from pyspark.sql import functions as F

from segmentry.operators import monitoring
from segmentry.sources.model_registry import append_record, read_records


def record(spark, model, score):
    return spark.createDataFrame([(model, score)], "model string, score double")


def test_two_appends_give_two_rows_and_a_repeated_one_none(spark, tmp_path):
    path = str(tmp_path / "registry")
    append_record(record(spark, "a", 0.5), path, expected=0)
    append_record(record(spark, "a", 0.7), path, expected=1)
    got = append_record(record(spark, "a", 0.7), path, expected=1)
    assert [(r["version"], r["score"]) for r in got.orderBy("version").collect()] == [(1, 0.5), (2, 0.7)]
    assert {r["version"] for r in append_record(record(spark, "b", None), path).filter("model = 'b'").collect()} == {1}


def test_a_record_on_an_older_version_is_refused(spark, tmp_path):
    path = str(tmp_path / "registry")
    append_record(record(spark, "a", 0.5), path)
    with pytest.raises(ValueError, match="has version 1, not 0"):
        append_record(record(spark, "a", 0.9), path, expected=0)
    assert read_records(spark, path, record(spark, "a", 0.1).schema).count() == 1


def test_records_that_raced_are_one(spark, tmp_path):
    path = str(tmp_path / "registry")
    got = append_record(record(spark, "a", 0.5), path)
    got.drop("version").withColumn("created_at_utc", F.lit("2999-01-01T00:00:00.000000Z")).write.mode("append").parquet(path)
    rows = read_records(spark, path, record(spark, "a", 0.5).schema).collect()
    assert len(rows) == 1 and rows[0]["created_at_utc"] < "2999"


def test_gate_names_the_table_of_a_failed_check(spark):
    sizes = spark.createDataFrame([(0, 3), (1, 4)], "cluster int, n long")
    gate = monitoring.result_gate({"sizes": (sizes, {"sum": (F.sum("n"), F.col("observed") == 8)}), "other": (sizes, {"rows": (F.count("*"), F.col("observed") == 2)})})
    assert sorted(map(tuple, gate.collect())) == [("other.rows", 2.0, True), ("sizes.sum", 7.0, False)]
    with pytest.raises(Exception, match="sizes.sum"):
        monitoring.enforce(gate).collect()
