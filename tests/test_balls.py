"""The ball index against brute force on all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmentry.operators import balls, condensed, density, graph, pairs, tendency
from test_clusters import blobs, frame, matrix


@pytest.fixture(autouse=True)
def small_balls(monkeypatch):
    """Every table above 0 rows is indexed, with parts of at most about 40 rows."""
    monkeypatch.setattr(pairs, "PLAIN_ROWS", 0)
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 40)
    monkeypatch.setattr(balls.build, "__defaults__", (12,))


def spread(seed=5):
    """Groups of points, copies, equal distances on a grid and lone rows far away."""
    rng = np.random.default_rng(seed)
    x, _ = blobs(150, k=6, seed=seed)
    grid = np.array([[20 + i, 20 + j] for i in range(7) for j in range(7)], dtype=float)
    return np.concatenate([x, grid, np.repeat(x[:1], 60, axis=0), rng.uniform(-300, 300, size=(12, 2))])


def nearest(d, k, include_self):
    d = d.copy()
    np.fill_diagonal(d, 0.0 if include_self else np.inf)
    ids = np.broadcast_to(np.arange(len(d)), d.shape)
    return np.lexsort((ids, d), axis=1)[:, :k]


@pytest.mark.parametrize("k,include_self", [(1, False), (5, True), (20, False)])
def test_neighbours_equal_brute_force(spark, k, include_self):
    x = spread()
    d = matrix(x)
    got = pairs.self_knn(frame(spark, x), k, include_self).orderBy("row_id", "rank").toPandas()
    want = np.take_along_axis(d if include_self else d + np.where(np.eye(len(x)) > 0, np.inf, 0), nearest(d, k, include_self), 1)
    np.testing.assert_allclose(got["distance"].to_numpy().reshape(len(x), k), want, atol=1e-9)
    exact = np.flatnonzero(np.arange(len(x)) >= 150)  # grid, copies: equal distances go to the smaller id
    np.testing.assert_array_equal(got["neighbour"].to_numpy().reshape(len(x), k)[exact[49:109]], nearest(np.round(d, 9), k, include_self)[exact[49:109]])


def test_fewer_rows_than_neighbours(spark):
    got = pairs.self_knn(frame(spark, np.array([[0.0], [1.0], [3.0]])), 5, include_self=False)
    assert [tuple(r) for r in got.orderBy("row_id", "rank").select("row_id", "neighbour", "distance").collect()] == [
        (0, 1, 1.0), (0, 2, 3.0), (1, 0, 1.0), (1, 2, 2.0), (2, 1, 2.0), (2, 0, 3.0)]


def test_no_rows(spark):
    empty = frame(spark, np.ones((1, 2))).filter("row_id < 0")
    assert pairs.self_knn(empty, 3).count() == 0 and pairs.eps_counts(empty, 1.0).count() == 0 and tendency.distance_tree(empty).count() == 0


@pytest.mark.parametrize("eps", [0.0, 0.3, 1.0, 40.0])
def test_counts_within_a_radius(spark, eps):
    x = spread()
    want = (matrix(x) <= eps).sum(axis=1) - 1
    got = pairs.eps_counts(frame(spark, x), eps).orderBy("row_id").toPandas()
    np.testing.assert_array_equal(got["within"], want)


@pytest.mark.parametrize("far", [0.0, 1e7])
def test_dbscan_equals_block_by_block(spark, monkeypatch, far):
    df = frame(spark, spread() + far)
    indexed = sorted(map(tuple, density.dbscan(df, 0.45, 6).collect()))
    monkeypatch.setattr(pairs, "PLAIN_ROWS", 10_000)
    assert indexed == sorted(map(tuple, density.dbscan(df, 0.45, 6).collect())) and len({c for _, c in indexed}) > 4


@pytest.mark.parametrize("core", [False, True])
def test_spanning_tree_has_the_least_weight(spark, core):
    x = spread()
    w = matrix(x)
    df = frame(spark, x)
    if core:
        reach = np.sort(w, axis=1)[:, 4]
        w = np.maximum(w, np.maximum(reach[:, None], reach[None, :]))
        df = df.join(spark.createDataFrame([(i, float(c)) for i, c in enumerate(reach)], "row_id long, core double"), "row_id")
    want = np.sort(balls.dense_tree(w)[2])
    tree = graph.spanning_tree(pairs.spanning_candidates(df, "core" if core else None)).toPandas()
    np.testing.assert_allclose(np.sort(tree["weight"]), want, atol=1e-9)


def test_reach_tree_of_condensed_clusters(spark, monkeypatch):
    df = frame(spark, spread())
    indexed = condensed.reachability_tree(df, 5).agg(F.count("*"), F.round(F.sum("weight"), 6)).first()
    monkeypatch.setattr(pairs, "PLAIN_ROWS", 10_000)
    assert indexed == condensed.reachability_tree(df, 5).agg(F.count("*"), F.round(F.sum("weight"), 6)).first()


def test_far_balls_are_skipped(spark):
    """Twenty groups of 100 rows: what the cells compare is a fraction of all pairs."""
    x, _ = blobs(2000, d=3, sd=0.05, k=20)
    df, every = frame(spark, x), 2000 * 1999 // 2
    index = balls.build(df, (), 40, 2000)
    near = balls.pair_load(balls.cells(index, (), *balls.within(0.2)))
    rows, reach = balls.neighbour_reach(index, 10, False)
    known = balls.pair_load(balls.cells(index, (), *reach, rows=rows))
    tree = balls.pair_load(balls.cells(index, (), *balls.tree_reach(index, None)))
    assert near < 0.08 * every and known < 0.08 * every and tree < 0.25 * every, (near / every, known / every, tree / every)


def test_a_hot_vector_is_shared_by_parts(spark):
    x = np.concatenate([np.zeros((400, 2)), blobs(200)[0]])
    index = balls.build(frame(spark, x), (), 40, 600)
    sizes = balls.cells(index, (), *balls.within(0.1)).groupBy("__i", "__j").count().agg(F.max("count")).first()[0]
    assert index.parts.max() >= 10 and sizes < 200


def test_queries_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(balls, "BLOCK_NUMBERS", 64)
    x, q = spread(), np.random.default_rng(9).uniform(-10, 30, size=(50, 2))
    asked = frame(spark, q).withColumnRenamed("row_id", "query_id")
    got = pairs.query_knn(asked, frame(spark, x).repartition(3), 4).orderBy("query_id", "rank").toPandas()
    want = np.sort(np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1)), axis=1)[:, :4]
    np.testing.assert_allclose(got["distance"].to_numpy().reshape(50, 4), want, atol=1e-9)
