import numpy as np
import pytest
from pyspark.sql import functions as F

from segmentry.functions import hashing, text, vectors
from segmentry.functions import numeric as num
from segmentry.operators import cleaning, order, profiling, sampling
from segmentry.sources import tables


def column(df, name):
    return [r[name] for r in df.orderBy("i").collect()]


def test_experience_boundary_labels(spark):
    rows = [(0, "Less than 1 year"), (1, "12"), (2, "More than 50 years"), (3, None), (4, "bad"), (5, "12d"), (6, "NaN"), (7, "52"), (8, "\t7 ")]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("y", text.parse_experience(F.col("t")))
    assert column(df, "y") == [0.5, 12.0, 51.0, None, None, None, None, None, 7.0]


def test_labels_are_distinct_sorted_and_trimmed(spark):
    df = spark.createDataFrame([(0, "Python; SQL;Python"), (1, ""), (2, None), (3, " ;;")], "i int, t string").withColumn("l", text.split_labels(F.col("t")))
    assert column(df, "l") == [["Python", "SQL"], [], [], []]


def test_row_statistics_skip_missing(spark):
    rows = [(0, 1.0, None, 4.0), (1, None, None, None), (2, 3.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    df = df.withColumn("m", num.row_median(*cols)).withColumn("s", num.row_spread(*cols))
    assert column(df, "m") == [2.5, None, 2.0] and column(df, "s") == [3.0, None, 2.0]


def test_uniform_draws_do_not_depend_on_partitions(spark):
    one = spark.range(1000).repartition(1).withColumn("u", hashing.uniform(7, "x", F.col("id")))
    many = spark.range(1000).repartition(64).withColumn("u", hashing.uniform(7, "x", F.col("id")))
    a, b = (dict(d.collect()) for d in (one, many))
    assert a == b and 0.45 < np.mean(list(a.values())) < 0.55


def test_distances_are_exact_for_near_and_equal_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 5)) + 1e4
    x[1] = x[0]
    x[2] = x[0] + 1e-9
    exact = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.testing.assert_allclose(vectors.distances(x, x), exact, atol=1e-7)
    assert vectors.distances(x, x)[0, 1] == 0.0


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_exact_quantiles_with_a_hot_value(spark, partitions):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(400, 3.0), rng.lognormal(size=800)])
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(values)], "x double, g int").repartition(partitions)
    got = order.exact_quantiles(df, "x", [0.0, 0.1, 0.5, 0.93, 1.0]).first()["quantiles"]
    np.testing.assert_allclose(got, np.quantile(values, [0.0, 0.1, 0.5, 0.93, 1.0]))
    by = {r["g"]: r["quantiles"][0] for r in order.exact_quantiles(df, "x", [0.5], ["g"]).collect()}
    for g in range(3):
        assert by[g] == pytest.approx(np.median(values[np.arange(1200) % 3 == g]))


def test_take_extreme_keeps_exact_count_under_ties(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(1000)], "k long, s double")
    top = order.take_extreme(df, "s", "k", 0.1).collect()
    assert len(top) == 100 and {r["s"] for r in top} == {3.0} and max(r["k"] for r in top) == 399


def test_average_rank_and_halves(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5.0, 1.0, 5.0, 2.0])], "i int, v double")
    assert column(order.average_rank(df, "v"), "rank") == [3.5, 1.0, 3.5, 2.0]
    assert column(order.average_rank(df, "v", ascending=False), "rank") == [1.5, 4.0, 1.5, 3.0]
    assert column(order.split_halves(df.select("i"), "i"), "half") == [1, 1, 2, 2]


def test_knee_of_a_bent_curve(spark):
    df = spark.createDataFrame([(k, y) for k, y in zip(range(2, 9), [100.0, 50.0, 20.0, 15.0, 12.0, 10.0, 9.0])], "k int, inertia double")
    assert [r["k"] for r in order.knee(df).filter("is_knee").collect()] == [4]


def test_cleaning_keeps_missing_checks_and_groups_rare(spark):
    df = spark.createDataFrame([(0, "Apples", "x"), (1, None, "x"), (2, "pears", "x"), (3, "APPLES", "y"), (4, None, None)], "i int, c string, g string")
    assert column(cleaning.drop_failed_check(df, "c"), "i") == [0, 1, 3, 4]
    assert column(cleaning.group_rare(df, "g", 2), "g") == ["x", "x", "x", "Other", "Missing"]


def test_group_median_falls_back_to_overall(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (2, "a", None), (3, "b", None)], "i int, g string, v double")
    out = cleaning.impute_group_median(df, ["v"], "g")
    assert column(out, "vImputed") == [1.0, 3.0, 2.0, 2.0] and column(out, "vMissing") == [0, 0, 1, 1]


def test_dedupe_keeps_the_first_even_for_one_hot_key(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("o"))
    assert cleaning.dedupe_first(df, "k", "o").collect() == [(1, 0)]


def test_percentile_interval_of_range(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(float("nan"),)], "x double")
    low, high = profiling.percentile_interval(df, "x").first()
    assert 1 < low < 5 and 94 < high < 98


def test_contract_names_missing_columns(spark):
    with pytest.raises(ValueError, match="absent"):
        tables.require_columns(spark.range(1), ["id", "absent"])


def test_empty_table_guard(spark):
    with pytest.raises(Exception, match="empty table"):
        tables.require_non_empty(spark.range(0), "id").collect()


def test_fingerprint_ignores_row_order(spark):
    a = tables.fingerprint(spark.range(100).repartition(1)).first()
    b = tables.fingerprint(spark.range(100).orderBy(F.desc("id")).repartition(7)).first()
    assert a == b and a != tables.fingerprint(spark.range(1, 101)).first()


def test_stratified_split_has_exact_shares(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    out = sampling.split(df, "id", 0.75, 3, ["g"]).groupBy("g").agg(F.count_if("is_train").alias("n"), F.count("*").alias("m"))
    assert all(r["n"] == int(0.75 * r["m"]) for r in out.collect())


def test_bootstrap_draws_sum_to_size(spark):
    df = spark.range(50).withColumnRenamed("id", "row_id")
    out = sampling.bootstrap(df, "row_id", 50, 4, 1).groupBy("repeat").agg(F.sum("weight").alias("w")).collect()
    assert len(out) == 4 and {r["w"] for r in out} == {50}
