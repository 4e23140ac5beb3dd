import numpy as np
import pytest
from pyspark.sql import functions as F

from segmentry.operators import anomaly, condensed, consensus, density, explain, factorisation, graph, hierarchy, kmeans, mixture, monitoring, pairs, spectral, stability, supervised, tendency
from segmentry.operators import validation as val
from segmentry.session import cut_lineage


def blobs(n=90, d=2, sd=0.25, k=3, seed=42):
    rng = np.random.default_rng(seed)
    centre = rng.uniform(-8, 8, size=(k, d))
    label = np.arange(n) % k
    return centre[label] + rng.normal(scale=sd, size=(n, d)), label


def frame(spark, x, label=None):
    rows = [(i, [float(c) for c in line], int(label[i]) if label is not None else 0) for i, line in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, v array<double>, cluster long")


def matrix(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


@pytest.fixture(scope="module")
def three(spark):
    x, label = blobs()
    return x, label, frame(spark, x, label).cache()


def test_internal_metrics_reward_separated_blobs(three):
    row = val.internal_metrics(three[2], 300).first()
    assert row["silhouette"] > 0.8 and row["davies_bouldin"] < 0.3 and row["calinski_harabasz"] > 100 and row["dunn_approx"] > 0.5


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(150, 4)), rng.integers(0, 4, 150)
    label[0], x[5] = 9, x[6]  # a singleton cluster and a pair of copies
    d = matrix(x)
    want = []
    for i in range(150):
        same = (label == label[i]) & (np.arange(150) != i)
        if not same.any():
            want.append(0.0)
            continue
        a, b = d[i, same].mean(), min(d[i, label == c].mean() for c in set(label) - {label[i]})
        want.append((b - a) / max(a, b))
    got = val.silhouette_points(frame(spark, x, label)).orderBy("row_id").toPandas()["silhouette"]
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_degenerate_labelings_have_no_metrics(spark):
    row = val.internal_metrics(frame(spark, blobs(30)[0]), 10).first()
    assert row["clusters_found"] == 1 and row["silhouette"] is None


def test_scores_of_many_labelings_equal_single_scores(spark, three):
    x, label, df = three
    wide = df.select("row_id", "v", F.col("cluster").alias("a"), (F.col("row_id") % 4).alias("b"), F.when(F.col("row_id") < 20, -1).otherwise(F.col("cluster")).cast("long").alias("c"))
    many = {r["candidate"]: r for r in val.score_labelings(wide, ["a", "b", "c"]).collect()}
    for name in "abc":
        one = val.internal_metrics(wide.select("row_id", "v", F.col(name).alias("cluster")), None).first()
        for metric in ("silhouette", "davies_bouldin", "calinski_harabasz", "dunn_approx", "noise_fraction"):
            assert many[name][metric] == pytest.approx(one[metric], rel=1e-9), (name, metric)


def test_ari_is_permutation_invariant(spark):
    rows = [(i, n, c) for n, labels in (("a", [0, 0, 1, 1, 2, 2]), ("b", [2, 2, 0, 0, 1, 1])) for i, c in enumerate(labels)]
    bundle = spark.createDataFrame(rows, "row_id long, candidate string, cluster int")
    assert val.pairwise_ari(bundle).first()["ari"] == 1.0


def test_sign_flip_detects_gain_and_repeats(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.linspace(0.1, 0.3, 80))], "row_id long, d double")
    first = val.sign_flip_test(df, "d", "row_id", 999, 42).first()["pvalue"]
    assert first <= 0.01 and first == val.sign_flip_test(df.repartition(13), "d", "row_id", 999, 42).first()["pvalue"]


def test_knn_through_cells_equals_broadcast_and_brute_force(spark, three):
    x, _, df = three
    queries = df.filter("row_id < 10").select(F.col("row_id").alias("query_id"), "v")
    want = {(i, int(j)) for i in range(10) for j in np.argsort(matrix(x)[i], kind="stable")[:4]}
    for found in (pairs.query_knn(queries, df, 4), pairs._merge_neighbours(pairs._query_cells(queries, df, 4, 10), ["query_id"], 4)):
        assert {(r["query_id"], r["neighbour"]) for r in found.collect()} == want


def test_copies_of_one_row_do_not_multiply_neighbours(spark):
    x = np.concatenate([np.zeros((120, 3)), np.random.default_rng(0).normal(size=(60, 3))])
    near = pairs.self_knn(frame(spark, x), 5).groupBy("row_id").count().collect()
    assert len(near) == 180 and {r["count"] for r in near} == {5}


def test_spanning_tree_weight(spark):
    x, _ = blobs(80, d=3, sd=2.0)
    d = matrix(x)
    inside, total = [0], 0.0
    while len(inside) < len(x):
        rest = [i for i in range(len(x)) if i not in inside]
        sub = d[np.ix_(inside, rest)]
        total += sub.min()
        inside.append(rest[int(np.argmin(sub.min(axis=0)))])
    tree = graph.spanning_tree(pairs.spanning_candidates(frame(spark, x), None)).toPandas()
    assert len(tree) == 79 and tree["weight"].sum() == pytest.approx(total)


def test_connected_components_of_chain_star_and_single(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, i) for i in range(101, 140)]
    nodes = spark.createDataFrame([(i,) for i in [*range(0, 31), *range(100, 140), 500]], "row_id long")
    found = dict(graph.connected_components(spark.createDataFrame(edges, "a_id long, b_id long"), nodes).collect())
    assert all(found[i] == 0 for i in range(31)) and all(found[i] == 100 for i in range(100, 140)) and found[500] == 500


def greedy_tree(d, linkage, x):
    groups = {i: [i] for i in range(len(d))}
    heights = []
    while len(groups) > 1:
        best = None
        for a in groups:
            for b in groups:
                if a < b:
                    block = d[np.ix_(groups[a], groups[b])]
                    h = {"single": block.min(), "complete": block.max(), "average": block.mean()}.get(linkage)
                    if linkage == "ward":
                        na, nb = len(groups[a]), len(groups[b])
                        h = np.sqrt(2 * na * nb / (na + nb)) * np.linalg.norm(x[groups[a]].mean(0) - x[groups[b]].mean(0))
                    if best is None or h < best[0]:
                        best = (h, a, b)
        h, a, b = best
        groups[a] += groups.pop(b)
        heights.append(h)
    return sorted(heights)


@pytest.mark.parametrize("linkage", hierarchy.LINKAGES)
def test_agglomeration_heights(spark, linkage):
    x = np.random.default_rng(5).normal(size=(14, 3))
    items = frame(spark, x).withColumn("weight", F.lit(1.0))
    merges = hierarchy.agglomerate(items, hierarchy.pair_table(items), linkage).toPandas()
    np.testing.assert_allclose(sorted(merges["height"]), greedy_tree(matrix(x), linkage, x), rtol=1e-7)
    assert merges["link_pairs"].sum() == 14 * 13 // 2


def test_tree_cuts_and_cophenetic(spark):
    x, label = blobs(12)
    items = frame(spark, x, label).withColumn("weight", F.lit(1.0))
    table = hierarchy.pair_table(items)
    merges = cut_lineage(hierarchy.agglomerate(items, table, "average"))
    cut = hierarchy.cut_count(items, merges, 3).toPandas().sort_values("row_id")["cluster"].to_numpy()
    assert len({(a, b) for a, b in zip(cut, label)}) == 3
    assert [r["clusters"] for r in hierarchy.cut_strategies(items, merges, "average", 3).collect()] == [3, 3]
    assert hierarchy.cophenetic_correlation(merges, table).first()[0] > 0.9


def test_dbscan_with_a_third_of_copies(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.zeros((40, 2)), rng.normal(0, 0.3, (40, 2)), rng.normal(6, 0.3, (40, 2)), [[30.0, 30.0]]])
    label = density.dbscan(frame(spark, x), 0.8, 5).toPandas().sort_values("row_id")["cluster"].to_numpy()
    assert set(label[:80]) == {0} and set(label[80:120]) == {1} and label[120] == -1


def test_lloyd_runs_side_by_side_equal_single_runs(spark, three):
    df = three[2]
    starts = [kmeans.hash_seeds(df, k, 1) for k in (2, 3)]
    both = kmeans.lloyd(df, starts)
    for start, fit in zip(starts, both):
        np.testing.assert_allclose(kmeans.lloyd(df, [start])[0].centres, fit.centres)
    assert both[1].inertia <= both[0].inertia
    again = kmeans.lloyd(df.repartition(9), starts)
    np.testing.assert_allclose(again[1].centres, both[1].centres)


def test_kmeans_and_minibatch_find_blobs(spark, three):
    x, label, df = three
    for fit in (kmeans.kmeans(df, [3], 0, 4)[3], kmeans.minibatch_kmeans(df, [3], 0)[3]):
        guess = kmeans.assign(df, fit.centres, "g").toPandas()
        assert len(set(zip(guess["g"], guess["cluster"]))) == 3


def test_gap_has_one_row_per_k(spark):
    x, _ = blobs(180, d=4, sd=1.0)
    rows = stability.gap_statistic(frame(spark, x), [2, 3, 4], 2, 42, 2).orderBy("k").collect()
    assert [r["k"] for r in rows] == [2, 3, 4] and all(np.isfinite(r["gap"]) for r in rows) and not rows[-1]["one_se_rule_satisfied"]


def test_mixture_likelihood_grows_and_labels_match(spark, three):
    x, label, df = three
    bounds = [mixture.fit_mixtures(df, 3, ("full",), 0, 1, m, 0.0)["full"].lower_bound for m in (1, 3, 8)]
    assert bounds == sorted(bounds)
    for kind, model in mixture.fit_mixtures(df, 3, seed=0, n_init=2, max_iter=20).items():
        got = mixture.mixture_labels(df, model).toPandas().sort_values("row_id")
        assert len(set(zip(got["cluster"], label))) == 3, kind
        if kind == "full":
            p = sum(w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(2 * np.pi * c))
                    for w, m, c in zip(model.weights, model.means, model.covariance))
            np.testing.assert_allclose(got["log_likelihood"], np.log(p), rtol=1e-6)


def test_spectral_separates_blobs(spark, three):
    embedded, fit = spectral.spectral(three[2], 3, 1, neighbours=20, n_init=4)
    got = kmeans.assign(embedded, fit.centres).toPandas().sort_values("row_id")
    assert len(set(zip(got["cluster"], three[1]))) == 3


def test_pca_and_svd_match_numpy(spark):
    from pyspark.ml.functions import array_to_vector

    x = np.random.default_rng(0).normal(size=(200, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5]) + 3
    df = frame(spark, x).select("row_id", array_to_vector("v").alias("features"))
    for model, base in ((factorisation.pca(df, 3), x - x.mean(0)), (factorisation.truncated_svd(df, 3), x)):
        scores = np.stack(model.transform(df).toPandas().sort_values("row_id")["v"])
        _, s, vt = np.linalg.svd(base, full_matrices=False)
        np.testing.assert_allclose(np.abs(scores), np.abs(base @ vt[:3].T), atol=1e-6)
        assert all(model.loadings[np.abs(model.loadings).argmax(axis=0), range(3)] > 0)


def test_nmf_error_does_not_grow(spark):
    rows = [(i, sorted(set([i % 2 * 3 + j for j in range(3) if (i >> j) % 2 == 0] + [i % 2 * 3]))) for i in range(64)]
    df = spark.createDataFrame(rows, "row_id long, features array<int>")
    fit = factorisation.nmf(df, 2, 6, 1)
    assert (np.diff(fit.errors) <= 1e-6 * fit.errors[0]).all() and (fit.components >= 0).all()
    label = factorisation.nmf_weights(df, fit).toPandas()
    assert len(set(zip(label["row_id"] % 2, label["cluster"]))) == 2


def test_consensus_of_agreeing_labelings(spark, three):
    x, label, df = three
    long = df.select("row_id", F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), ((F.col("cluster") + s) % 3).alias("cluster")) for n, s in (("a", 0), ("b", 1), ("c", 2))])).alias("e")).select("row_id", "e.*")
    labels, choice = consensus.consensus(long, df)
    got = labels.toPandas().sort_values("row_id")
    assert set(got["k"]) == {3} and len(set(zip(got["cluster"], label))) == 3


def test_hopkins_detects_blobs(spark):
    rng = np.random.default_rng(42)
    x = np.vstack([rng.normal(-3, 0.15, (250, 2)), rng.normal(3, 0.15, (250, 2))])
    assert tendency.hopkins(frame(spark, x), 100, 1, 42).first()["hopkins"] > 0.75


def test_psi_and_ks(spark):
    same = [(float(v), f) for f in (True, False) for v in np.linspace(-2, 2, 500)]
    moved = [(float(v), True) for v in np.linspace(0, 1, 1000)] + [(float(v), False) for v in np.linspace(2, 3, 1000)]
    for rows, psi, ks in ((same, lambda v: v == 0, 0.0), (moved, lambda v: v > 0.2, 1.0)):
        df = spark.createDataFrame(rows, "x double, f boolean")
        assert psi(monitoring.population_stability(df, "x", F.col("f"), []).first()["psi"])
        row = monitoring.ks_statistic(df, "x", F.col("f"), []).first()
        assert row["ks_statistic"] == ks and (row["ks_pvalue"] > 0.99 if ks == 0 else row["ks_pvalue"] < 1e-6)


def test_failed_expectation_raises(spark):
    gate = monitoring.expectations(spark.range(3), {"rows": (F.count("*"), F.col("observed") == 4)})
    assert gate.first()["passed"] is False
    with pytest.raises(Exception, match="failed expectation: rows"):
        monitoring.enforce(gate).collect()


def test_shapley_adds_up_and_attribution_is_checked(spark, three):
    df = three[2].withColumn("cluster", F.col("cluster").cast("int"))
    tree, fidelity = supervised.surrogate_tree(df, 1, leaf=3)
    assert fidelity.first()["training_fidelity"] > 0.95  # splits are chosen among binned thresholds
    values = explain.tree_shapley(df, tree, 2)
    gap = values.select(F.abs(F.col("base") + F.aggregate("phi", F.lit(0.0), lambda s, x: s + x) - F.col("prediction")).alias("e")).agg(F.max("e")).first()[0]
    assert gap < 1e-9
    fixed = spark.createDataFrame([([0.0, -2.0, 0.0],), ([0.0, 2.0, 0.0],)], "phi array<double>")
    assert {r["feature"]: r["shap_mean_abs"] for r in explain.mean_absolute_attribution(fixed, ["a", "b", "c"]).collect()} == {"a": 0.0, "b": 2.0, "c": 0.0}
    with pytest.raises(Exception, match="unexpected attribution length"):
        explain.mean_absolute_attribution(fixed, ["a", "b"]).collect()


def test_isolation_finds_the_far_row(spark):
    x, label = blobs(300)
    x[7] = [90.0, -90.0]
    top = anomaly.cluster_anomalies(frame(spark, x, label), 0.004, 30, 1).collect()
    assert [r["row_id"] for r in top] == [7]


def test_matching_picks_the_cheapest_assignment(spark):
    a = spark.createDataFrame([(0, [0.0]), (1, [10.0]), (2, [20.0])], "cluster long, centre array<double>")
    b = spark.createDataFrame([(0, [19.0]), (1, [1.0]), (2, [11.0])], "cluster long, centre array<double>")
    assert {(r["a"], r["b"]) for r in stability.match_centres(a, b).collect()} == {(0, 1), (1, 2), (2, 0)}


def test_assignment_of_many_centres(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(11, 3))
    order = rng.permutation(11)
    table = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cluster long, centre array<double>")
    found = {(r["a"], r["b"]) for r in stability.match_centres(table(points), table(points[order] + rng.normal(scale=1e-3, size=(11, 3)))).collect()}
    assert found == {(int(order[b]), b) for b in range(11)}


def test_assignment_is_the_cheapest():
    from itertools import permutations

    for seed in range(30):
        cost = np.random.default_rng(seed).integers(0, 20, (5, 5)).astype(float)
        chosen = stability.cheapest_assignment(cost)
        assert sorted(chosen) == list(range(5))
        assert sum(cost[i, j] for i, j in enumerate(chosen)) == min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(5)))


def test_agglomeration_that_does_not_finish_is_an_error(spark):
    items = spark.createDataFrame([(i, 1.0) for i in range(6)], "row_id long, weight double")
    apart = spark.createDataFrame([(i, j, float(2**j - 2**i)) for i in range(6) for j in range(i + 1, 6)], "a long, b long, d double")
    with pytest.raises(RuntimeError):
        hierarchy.agglomerate(items, apart, "single", max_rounds=1)


def test_linear_fits_of_phase_two_read_all_rows(spark, monkeypatch):
    from segmentry.plans import job_queries, jobs

    x = np.concatenate([np.random.default_rng(3).normal(c, 0.3, size=(40, 2)) for c in (0, 4, 8)])
    seen = {}
    for module, name in ((kmeans, "kmeans"), (mixture, "fit_mixtures"), (stability, "gap_statistic")):
        def spy(df, *rest, _run=getattr(module, name), _name=name, **more):
            seen.setdefault(_name, set()).add(df.count())
            return _run(df, *rest, **more)
        monkeypatch.setattr(module, name, spy)
    few = {"seed": 1, "ks": (2, 3), "family_ks": (3,), "n_init": 1, "gap_references": 1, "evaluation_rows": 60, "family_rows": 60, "gap_rows": 60, "neighbours": 5, "mixture_iterations": 5, "micro": 8}
    tables = jobs.phase_two(frame(spark, x), job_queries.LIGHT | few)
    assert seen == {"kmeans": {120}, "fit_mixtures": {120}, "gap_statistic": {120}} and tables["sample"].count() == 60
    names = {r["configuration"] for r in tables["family_scores"].collect()}
    assert {f"agglomerative_{linkage}_k3" for linkage in hierarchy.LINKAGES} | {f"gmm_{kind}_k3" for kind in mixture.COVARIANCES} <= names
    assert {f"hdbscan_mcs{least}" for least in (30, 75, 150)} <= names


def test_spectral_embedding_settles_on_a_ring(spark):
    graph = spark.createDataFrame([(i, (i + d) % 120, 1.0) for i in range(120) for d in (-1, 0, 1)], "src bigint, dst bigint, w double")
    v = np.array([r["v"] for r in spectral.spectral_embedding(graph, 3, 1).orderBy("row_id").collect()]) * np.sqrt(3.0)
    a = sum(np.roll(np.eye(120), d, axis=1) for d in (-1, 0, 1)) / 3
    values = np.array([x @ a @ x for x in v.T])
    assert np.abs(v.T @ v - np.eye(3)).max() < 1e-6
    assert np.linalg.norm(a @ v - v * values, axis=0).max() < 1e-3
    assert np.allclose(values, [1.0, (1 + 2 * np.cos(2 * np.pi / 120)) / 3, (1 + 2 * np.cos(2 * np.pi / 120)) / 3], atol=2e-4)


def test_spectral_steps_do_not_shuffle_the_edges(spark, monkeypatch):
    graph = spark.createDataFrame([(i, (i + d) % 120, 1.0) for i in range(120) for d in (-1, 0, 1)], "src bigint, dst bigint, w double")
    block = spark.createDataFrame([(i, float(i % 7)) for i in range(120)], "row_id bigint, u0 double")
    monkeypatch.setattr(spectral, "cut_lineage", lambda df: df)
    own, seen = spectral._heard, []
    monkeypatch.setattr(spectral, "_heard", lambda *a: seen.append(own(*a)) or seen[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit in (spectral.BROADCAST_BYTES, 0):
            monkeypatch.setattr(spectral, "BROADCAST_BYTES", limit)
            with pytest.raises(RuntimeError, match="not converged"):
                spectral.spectral_embedding(graph, 3, 1, rounds=0)
        plans = [h._jdf.queryExecution().executedPlan().toString() for h in seen]
        near, far = (own(graph, block, ["u0"], small) for small in (True, False))
        assert near.orderBy("row_id").collect() == far.orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]


def test_unsettled_spectral_embedding_is_an_error(spark):
    graph = spark.createDataFrame([(i, (i + d) % 120, 1.0) for i in range(120) for d in (-1, 0, 1)], "src bigint, dst bigint, w double")
    with pytest.raises(RuntimeError, match="not converged"):
        spectral.spectral_embedding(graph, 3, 1, rounds=1, degree=1)


def test_a_small_far_cluster_is_seeded(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, (3996, 2)), rng.normal(0, 0.1, (4, 2)) + 60])
    df = frame(spark, x).cache()
    for seed in range(20):
        (starts,) = kmeans.plus_plus_seeds(df, [4], seed)
        assert (starts.sum(axis=1) > 100).any()


def _plain_condensed(x, min_samples, least):
    """Clusters of a least size from all thresholds of mutual reachability: rows' clusters and the choice, by definition."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min_samples]
    w = np.round(np.maximum(d, np.maximum(core[:, None], core[None])), 9)
    levels = sorted(set(w[np.triu_indices(len(x), 1)]))
    token, names, fell, above = [None] * len(x), {}, {}, {}
    for t in levels:
        group = np.full(len(x), -1)
        for i in range(len(x)):
            if group[i] < 0:
                todo = [i]
                group[i] = i
                while todo:
                    for j in np.flatnonzero((w[todo.pop()] <= t) & (group < 0)):
                        group[j] = i
                        todo.append(j)
        for root in np.unique(group):
            members = np.flatnonzero(group == root)
            if len(members) < least:
                continue
            inside = {token[m] for m in members if token[m]}
            name = inside.pop() if len(inside) == 1 else (t, int(root))
            for old in inside if name not in names else ():
                above[old] = (t, name, sum(token[m] == old for m in members))
            names[name] = None
            for m in members:
                if token[m] is None:
                    fell[m] = (t, name)
                token[m] = name
        if len(np.unique(group)) == 1:
            break
    order = sorted(names, key=lambda n: (-above[n][0] if n in above else -np.inf, -n[0], n[1]))
    birth = {n: 1 / max(above[n][0], 1e-12) if n in above else 0.0 for n in order}
    mass = {n: sum(1 / max(t, 1e-12) - birth[n] for t, o in fell.values() if o == n) + sum((birth[c] - birth[n]) * a[2] for c, a in above.items() if a[1] == n) for n in order}

    def best(n):
        below = [best(c) for c in order if c in above and above[c][1] == n]
        total = sum(b[0] for b in below)
        return (mass[n], [n]) if n in above and mass[n] >= total else (total, [c for b in below for c in b[1]])

    chosen = [n for n in order if n in best(order[0])[1]]

    def label(n):
        while n is not None and n not in chosen:
            n = above[n][1] if n in above else None
        return -1 if n is None else chosen.index(n)

    rows = {(order.index(above[n][1]), order.index(n), True, round(birth[n], 6), above[n][2]) for n in above}
    return [label(fell[i][1]) for i in range(len(x))], rows | {(order.index(n), int(i), False, round(1 / max(t, 1e-12), 6), 1) for i, (t, n) in fell.items()}


@pytest.fixture(scope="module")
def dense_parts(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (4, 0), (4.0, 2.5))] + [rng.uniform(-3, 7, (25, 2)), np.repeat([[9.0, 9.0]], 12, 0)])
    df = frame(spark, x).cache()
    return x, df, condensed.reachability_tree(df, 5)


@pytest.mark.parametrize(("least", "stage"), [(8, 1 << 18), (8, 20), (20, 1 << 18)])
def test_condensed_tree_by_definition(dense_parts, monkeypatch, least, stage):
    x, df, tree = dense_parts
    monkeypatch.setattr(condensed, "STAGE_EDGES", stage)
    found = condensed.hdbscan(df, tree, least)
    labels, rows = _plain_condensed(x, 5, least)
    assert [r["cluster"] for r in found.labels(df).orderBy("row_id").collect()] == labels and max(labels) >= 2
    assert {(r["parent"], r["child"], r["is_cluster"], round(r["lambda"], 6), r["child_size"]) for r in found.rows().collect()} == rows


def test_condensed_tree_of_too_few_rows_is_noise(dense_parts):
    _, df, tree = dense_parts
    few = condensed.hdbscan(df, tree, 1000)
    assert few.rows().count() == 0 and {r["cluster"] for r in few.labels(df).collect()} == {-1}


def test_cosine_sums_equal_those_of_pairs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (60, 4)), np.zeros((2, 4)), np.ones((3, 4))])
    df = frame(spark, x).withColumn("cluster", (F.col("row_id") % 4).cast("bigint") - 1).withColumn("other_one", (F.col("row_id") % 3).cast("bigint"))
    keys = ["row_id", "candidate", "other"]
    got, want = ({tuple(r[k] for k in keys): r["total"] for r in t.collect()} for t in (val.cosine_sums(df, ["cluster", "other_one"]), pairs.cluster_distance_sums(df, ["cluster", "other_one"], "cosine")))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9
