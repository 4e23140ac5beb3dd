"""Fewer shuffles and rounds of the same work: passes of k-means, components."""

import numpy as np

from segmentry.operators import graph, kmeans


def test_a_chain_in_one_partition_needs_no_rounds(spark, monkeypatch):
    asked = []
    plain = graph._large_star
    monkeypatch.setattr(graph, "_large_star", lambda p: asked.append(1) or plain(p))
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(900, 800), (5, 5)], "a_id bigint, b_id bigint").coalesce(1)
    got = {r["row_id"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(501)} | {900: 800, 800: 800}
    assert not asked


def test_components_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(graph, "CONTRACT_NODES", 4)
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))]
    label = {i: i for e in edges for i in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    found = graph.connected_components(spark.createDataFrame(edges, "a_id bigint, b_id bigint").repartition(7))
    got = {r["row_id"]: r["component"] for r in found.collect()}
    assert got == {i: c for i, c in label.items() if any(i in e and e[0] != e[1] for e in edges)}
    assert graph.connected_components(spark.createDataFrame([], "a_id bigint, b_id bigint")).count() == 0


def test_a_pass_of_known_tasks_needs_no_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, w = rng.standard_normal((90, 3)), rng.integers(0, 3, (90, 2)).astype(float)
    df = spark.createDataFrame([(v.tolist(), u.tolist()) for v, u in zip(x, w)], "v array<double>, w array<double>").repartition(4)
    centres = [x[:2], x[5:8]]
    shuffled = kmeans._pass(df, centres, "w", [0, 1])
    asked = []
    plain = type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda *a, **k: asked.append(1) or plain(*a, **k))
    direct = kmeans._pass(df, centres, "w", [0, 1], df.rdd.getNumPartitions())
    assert not asked
    for a, b in zip(shuffled[:2], direct[:2]):
        assert all(np.allclose(p, q) for p, q in zip(a, b))
    assert np.allclose(shuffled[2], direct[2])
    monkeypatch.setattr(kmeans, "PARTIAL_BYTES", 8)
    again = kmeans._pass(df, centres, "w", [0, 1], 4)
    assert asked and np.allclose(again[2], direct[2])
