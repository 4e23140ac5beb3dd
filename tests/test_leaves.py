"""Feature trees against a recursive split in numpy, and linkages that share their rounds."""

import numpy as np
import pytest

from segmentry.operators import hierarchy
from segmentry.operators.leaves import feature_tree


def split(ids, x, radius):
    low, high = x.min(axis=0), x.max(axis=0)
    inner = ((x - x.mean(axis=0)) ** 2).sum()
    if inner / len(x) <= radius * radius or (high == low).all():
        return {int(ids.min()): (len(x), inner, x.mean(axis=0), set(ids.tolist()))}
    dim = int((high - low).argmax())
    right = x[:, dim] > low[dim] + (high[dim] - low[dim]) / 2
    return split(ids[~right], x[~right], radius) | split(ids[right], x[right], radius)


def test_tree_equals_recursive_splits_and_keeps_every_row(spark):
    rng = np.random.default_rng(5)
    groups = [rng.normal(c, 0.2, (60, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 5, 1))]
    # A third of the rows is one vector, and one row lies far away.
    x = np.vstack([*groups, np.tile([9.0, 9.0, 9.0], (100, 1)), [[1000.0, 0.0, 0.0]]])
    ids = rng.permutation(len(x)) + 10
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "row_id long, v array<double>").repartition(7)
    for radius in (2.0, 0.0):
        expected = split(ids, x, radius)
        found = feature_tree(df, radius)
        items = {r["row_id"]: r for r in found.items.collect()}
        assert items.keys() == expected.keys()
        members: dict[int, set] = {}
        for r in found.members.collect():
            members.setdefault(r["leaf"], set()).add(r["row_id"])
        for leaf, (n, inner, centre, held) in expected.items():
            assert items[leaf]["weight"] == n and members[leaf] == held
            assert items[leaf]["inner"] == pytest.approx(inner, abs=1e-6) and items[leaf]["v"] == pytest.approx(centre.tolist())
        lost = found.loss().first()
        total = ((x - x.mean(axis=0)) ** 2).sum()
        assert (lost["leaves"], lost["rows"]) == (len(expected), len(x)) and lost["lost"] == pytest.approx(sum(e[1] for e in expected.values()) / total, abs=1e-9)


def test_tree_of_an_empty_table_and_of_broken_vectors(spark):
    empty = feature_tree(spark.createDataFrame([], "row_id long, v array<double>"), 1.0)
    assert empty.items.count() == empty.members.count() == 0 and empty.loss().first()["lost"] == 0.0
    for bad in (None, [1.0, None], [1.0, float("nan")], [float("inf"), 0.0]):
        with pytest.raises(Exception, match="finite components"):
            feature_tree(spark.createDataFrame([(1, [0.0, 0.0]), (2, bad)], "row_id long, v array<double>"), 1.0)


def test_linkages_together_equal_each_alone(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist(), int(w)) for i, (v, w) in enumerate(zip(rng.normal(size=(9, 2)), rng.integers(1, 5, 9)))]
    items = spark.createDataFrame(rows, "row_id long, v array<double>, weight long")
    table = hierarchy.pair_table(items)
    every = {(r["linkage"], r["left"], r["right"]): r["height"] for r in hierarchy.agglomerate_all(items, table).collect()}
    alone = {("ward", r["left"], r["right"]): r["height"] for r in hierarchy.agglomerate(items, table, "ward").collect()}
    assert {k: h for k, h in every.items() if k[0] == "ward"} == pytest.approx(alone) and len(every) == 32
    with pytest.raises(ValueError, match="Unknown linkage"):
        hierarchy.agglomerate(items, table, "median")
