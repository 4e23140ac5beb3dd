"""Cells of several tiles, and blocks of bounded number."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmentry.operators import balls, pairs
from test_clusters import blobs, frame, matrix


def side(x, first=0, **extra):
    ids = np.random.default_rng(3).permutation(len(x)) + first
    return pairs.Side(ids, x, extra, np.arange(len(x)))


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 16)


def test_shuffled_rows_grow_with_the_table(spark):
    """A row travels once per block, and large tables have no more blocks than ``BLOCKS``."""
    df = spark.range(1 << 20).select(F.col("id").alias("row_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    counts = [pairs.block_count(df, rows=n) for n in (100_000, 200_000, 600_000, 3_000_000)]
    assert counts == [pairs.BLOCKS] * 4
    assert pairs.block_count(df, rows=1 << 30) > pairs.BLOCKS


def test_shuffled_copies_hardly_grow_from_ten_thousand_rows_on(spark):
    """Ten times the rows are sent in at most 1.2 times the copies."""
    df = spark.range(1 << 10).select(F.col("id").alias("row_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    few, many = (pairs.block_count(df, rows=n) for n in (10_256, 102_564))
    assert many <= 1.2 * few


def test_index_cells_send_a_row_once_per_block(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCKS", 4)
    x = np.random.default_rng(2).normal(size=(2000, 16))
    df = frame(spark, x)
    index = balls.build(df, (), 40, 2000)
    found = pairs._index_cells(index, [], *balls.within(10.0), 2000)
    assert found.count() <= 4 * 2000 and found.select("row_id").distinct().count() == 2000
    near = pairs._index_cells(index, [], *balls.within(0.0), 2000)
    assert near.filter("__i = __j").count() == 2000


def test_pair_steps_send_rows_once_per_block(spark, monkeypatch):
    """Silhouettes, separations, neighbours and counts within a radius, block by block and by the index: no row is sent to more cells than there are blocks."""
    sent, run = [], pairs._run_cells

    def counted(placed, kernel, schema):
        sent.append(placed.count())
        return run(placed, kernel, schema)

    monkeypatch.setattr(pairs, "_run_cells", counted)
    for name, value in (("BLOCKS", 4), ("BLOCK_ROWS", 64), ("PLAIN_ROWS", 500)):
        monkeypatch.setattr(pairs, name, value)
    for n in (400, 1600):
        df = frame(spark, *blobs(n, d=4, k=3))
        pairs.cluster_distance_sums(df, ["cluster"]), pairs.separation(df), pairs.self_knn(df, 3), pairs.eps_counts(df, 100.0)
    assert max(sent[:4]) <= 4 * 400 and max(sent[4:]) <= 4 * 1600


def test_cross_tree_is_least():
    rng = np.random.default_rng(4)
    w = rng.integers(1, 9, size=(13, 7)).astype(float)
    whole = np.full((20, 20), 1e9)
    whole[:13, 13:], whole[13:, :13] = w, w.T
    a, b, weight = pairs._cross_tree(w)
    assert np.isclose(weight.sum(), balls.dense_tree(whole)[2].sum()) and (w[a, b] == weight).all()


def test_forest_of_tiles_is_the_tree(small_tiles, spark):
    x = np.concatenate([blobs(100, d=3)[0], np.zeros((20, 3))])
    one = side(x)
    edges = [np.concatenate(c) for c in zip(*(pairs._tile_tree(a, b, None) for a, b in pairs._tile_pairs(one, None)))]
    assert np.isclose(pairs._forest(*edges)[2].sum(), balls.dense_tree(matrix(x))[2].sum())


def test_tiles_too_far_apart_are_not_compared(small_tiles):
    x, _ = blobs(400, d=3, sd=0.05, k=20)
    one = side(x, __spot=(np.arange(400) // 20))
    order = np.lexsort((x[:, 0], np.round(x).sum(axis=1)))
    one.extra["__spot"] = np.argsort(order)
    every, near = (sum(len(a) * len(b) for a, b in pairs._tile_pairs(one, None, r)) for r in (None, lambda a, b: 0.2))
    found = {frozenset((int(a.ids[i]), int(b.ids[j]))) for a, b in pairs._tile_pairs(one, None, lambda a, b: 0.2) for i, j in zip(*np.nonzero(pairs._inside(a.x, b.x, 0.2)))}
    d = matrix(x)
    assert near < every and found == {frozenset((int(one.ids[i]), int(one.ids[j]))) for i, j in zip(*np.nonzero(d <= 0.2))}


def test_components_joined():
    root = pairs._joined(np.arange(8), np.array([7, 2, 3, 5]), np.array([2, 3, 0, 6]))
    assert root.tolist() == [0, 1, 0, 0, 4, 5, 5, 0]


def test_large_cells_equal_brute_force(spark):
    """Two blocks of more than one tile each."""
    x, labels = blobs(3000, d=4, k=3)
    df = frame(spark, x, labels)
    d = matrix(x)
    own = pairs.cell_map
    try:
        pairs.cell_map = lambda df, kernel, schema, keep=(), blocks=None: own(df, kernel, schema, keep, 2)
        sums = pairs.cluster_distance_sums(df, ["cluster"]).toPandas().pivot(index="row_id", columns="other", values="total").to_numpy()
        near = pairs.self_knn(df, 4, include_self=False).orderBy("row_id", "rank").toPandas()["distance"].to_numpy().reshape(3000, 4)
        within = pairs.eps_counts(df, 0.5).orderBy("row_id").toPandas()["within"].to_numpy()
        facts = pairs.distance_summary(df, 0.5).orderBy("row_id").toPandas()
    finally:
        pairs.cell_map = own
    np.testing.assert_allclose(sums, np.stack([d[:, labels == c].sum(axis=1) for c in range(3)], axis=1))
    np.testing.assert_array_equal(within, (d <= 0.5).sum(axis=1) - 1)
    np.testing.assert_array_equal(facts["within"], within)
    np.testing.assert_allclose(facts["mean_distance"], d.sum(axis=1) / 2999)
    np.fill_diagonal(d, np.inf)
    np.testing.assert_allclose(near, np.sort(d, axis=1)[:, :4], atol=1e-9)
