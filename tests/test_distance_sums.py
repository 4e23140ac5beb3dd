"""Sums of distances of several labelings in one pass."""

import numpy as np

from segmentry.operators import pairs


def test_distance_sums_share_one_product_per_tile(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((70, 4)) + 1e3, np.zeros((3, 4))])
    labels = np.stack([rng.integers(-1, 3, 73), rng.integers(0, 2, 73) * 7], axis=1)
    df = spark.createDataFrame([(i, v.tolist(), int(a), int(b)) for i, (v, (a, b)) in enumerate(zip(x, labels))], "row_id bigint, v array<double>, p bigint, q bigint")
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 16)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    got = {(r["row_id"], r["candidate"], r["other"]): r["total"] for r in pairs.cluster_distance_sums(df, ["p", "q"]).collect()}
    expected = {(i, c, int(g)): d[i, labels[:, c] == g].sum() for i in range(73) for c in (0, 1) for g in np.unique(labels[:, c]) if g >= 0}
    assert got.keys() == expected.keys() and all(abs(got[k] - v) <= 1e-9 * max(1, v) for k, v in expected.items())
