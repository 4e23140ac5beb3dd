"""Queries for pair work, tendency, clustering, validation, explanation, monitoring and streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from segmentry.functions import numeric as num
from segmentry.functions import vectors as vec
from segmentry.operators import anomaly, condensed, consensus, density, explain, hierarchy, kmeans, leaves, mixture, monitoring, pairs, selection, spectral, stability, supervised, tendency
from segmentry.operators import order as ordering
from segmentry.operators import profiling as prof
from segmentry.operators import sampling as samp
from segmentry.operators import validation as val
from segmentry.operators.moments import centroids
from segmentry.plans import fixtures as fx
from segmentry.plans.fixtures import draw_sql, uniform_sql
from segmentry.plans.lloyd_sql import lloyd_ctes
from segmentry.plans.registry import query, r
from segmentry.plans.table_queries import LABEL_LIST, _FALLING, _event_order, knee_sql, scores
from segmentry.session import cut_lineage, stage_path
from segmentry.sources import tables as src
from segmentry.sources.model_registry import append_record

SEED = 42


def num6(c, digits=6):
    return num.rounded(c, digits)


def labelled(spark, d):
    """Vectors with an integer label per row."""
    return fx.v_vec(spark, d).withColumn("cluster", F.col("cluster").cast("bigint"))


PAIRS = fx.V_VEC + """, p AS MATERIALIZED (SELECT a.row_id AS a, b.row_id AS b, a.cluster AS ca, b.cluster AS cb, list_distance(a.v, b.v) AS d,
  1 - list_cosine_similarity(a.v, b.v) AS cd FROM v_vec a, v_vec b WHERE a.row_id <> b.row_id)"""

# --- D. Pair joins --------------------------------------------------------------------------------


@query("d6_distance_summary", f"""WITH {PAIRS} SELECT a AS row_id, {r('min(d)')} AS nearest, {r('max(d)')} AS farthest, {r('avg(d)')} AS mean_distance, count(*) FILTER (d <= 1.2) AS within FROM p GROUP BY 1""")
def d6(spark, d):
    rows = pairs.distance_summary(fx.v_vec(spark, d), 1.2)
    return rows.withColumns({c: num6(F.col(c)) for c in ("nearest", "farthest", "mean_distance")})


@query("d7_knn_self", f"""WITH {PAIRS} SELECT a AS row_id, b AS neighbour, {r('d')} AS distance, i AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS i FROM p) WHERE i <= 5""")
def d7(spark, d):
    return pairs.self_knn(fx.v_vec(spark, d), 5, include_self=False).select("row_id", "neighbour", num6(F.col("distance")).alias("distance"), "rank")


@query("d7_knn_queries", f"""WITH {fx.V_VEC}, c AS (SELECT cluster AS query_id, list(m ORDER BY dim) AS v FROM (SELECT cluster, dim, avg(x) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS dim FROM v_vec) GROUP BY 1, 2) GROUP BY 1)
  SELECT query_id::BIGINT AS query_id, row_id AS neighbour, {r('d')} AS distance, i AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, row_id) AS i FROM (
    SELECT query_id, row_id, list_distance(c.v, v_vec.v) AS d FROM c, v_vec)) WHERE i <= 3""")
def d7q(spark, d):
    rows = labelled(spark, d)
    centres = centroids(rows).select(F.col("cluster").alias("query_id"), F.col("centre").alias("v"))
    return pairs.query_knn(centres, rows, 3).select("query_id", "neighbour", num6(F.col("distance")).alias("distance"), "rank")


@query("d8_eps_neighbours", f"WITH {PAIRS} SELECT v.row_id, count(p.b) + 1 AS neighbours FROM v_vec v LEFT JOIN p ON p.a = v.row_id AND d <= 1.25 GROUP BY 1")
def d8(spark, d):
    return pairs.eps_counts(fx.v_vec(spark, d), 1.25).select("row_id", (F.col("within") + 1).alias("neighbours"))


@query("d9_cluster_gaps", f"WITH {PAIRS} SELECT ca::BIGINT AS cluster_a, cb::BIGINT AS cluster_b, {r('min(d)')} AS distance FROM p WHERE ca < cb GROUP BY 1, 2")
def d9(spark, d):
    return pairs.cluster_gaps(labelled(spark, d)).withColumn("distance", num6(F.col("distance")))


CENTRES = fx.V_VEC + """, cen AS MATERIALIZED (SELECT cluster, list(m ORDER BY dim) AS c, any_value(n) AS n FROM (SELECT cluster, dim, avg(x) AS m, count(*) AS n FROM (
  SELECT cluster, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS dim FROM v_vec) GROUP BY 1, 2) GROUP BY 1)"""


@query("d10_centroid_distances", f"WITH {CENTRES} SELECT row_id, cen.cluster::INT AS cluster, {r('list_distance(v, c)')} AS distance FROM v_vec, cen")
def d10(spark, d):
    rows = labelled(spark, d)
    table = centroids(rows).orderBy("cluster").toArrow()
    found = pairs.centre_distances(rows.select("row_id", "v"), vec.matrix(table.column("centre")))
    return found.select("row_id", F.posexplode("distances").alias("cluster", "distance")).withColumn("distance", num6(F.col("distance")))


_ARI_CELLS = """x AS (SELECT a.candidate AS a_name, b.candidate AS b_name, a.cluster AS a, b.cluster AS b, count(*)::DOUBLE AS n FROM v_bundle a JOIN v_bundle b USING (row_id) WHERE a.candidate < b.candidate GROUP BY 1, 2, 3, 4),
  xa AS (SELECT a_name, b_name, sum(n * (n - 1) / 2) AS s FROM (SELECT a_name, b_name, a, sum(n) AS n FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2),
  xb AS (SELECT a_name, b_name, sum(n * (n - 1) / 2) AS s FROM (SELECT a_name, b_name, b, sum(n) AS n FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2),
  xt AS (SELECT a_name, b_name, sum(n * (n - 1) / 2) AS s, sum(n) * (sum(n) - 1) / 2 AS t FROM x GROUP BY 1, 2),
  ari AS (SELECT a_name, b_name, (xt.s - xa.s * xb.s / t) / ((xa.s + xb.s) / 2 - xa.s * xb.s / t) AS ari FROM xt JOIN xa USING (a_name, b_name) JOIN xb USING (a_name, b_name))"""


@query("d11_n9_pairwise_ari", f"WITH {fx.V_BUNDLE}, {_ARI_CELLS} SELECT a_name, b_name, {r('ari')} AS ari FROM ari")
def d11(spark, d):
    return val.pairwise_ari(fx.v_bundle(spark, d)).withColumn("ari", num6(F.col("ari")))


def _half_centres(spark, d):
    """Centres of label mod 3 in the first and in the second half of the vectors."""
    halves = ordering.split_halves(fx.v_vec(spark, d).withColumn("cluster", F.col("cluster") % 3), "row_id")
    return [centroids(halves.filter(F.col("half") == h)).select("cluster", "centre") for h in (1, 2)]


@query("d13_centre_matching", f"""WITH {fx.V_VEC}, h AS (SELECT row_id, v, (cluster % 3)::BIGINT AS cluster, row_number() OVER (ORDER BY row_id) <= (SELECT count(*) // 2 FROM v_vec) AS first FROM v_vec),
  c AS (SELECT first, cluster, list(m ORDER BY dim) AS c FROM (SELECT first, cluster, dim, avg(x) AS m FROM (SELECT first, cluster, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS dim FROM h) GROUP BY 1, 2, 3) GROUP BY 1, 2),
  cost AS (SELECT p.cluster AS a, q.cluster AS b, list_distance(p.c, q.c) AS d FROM c p, c q WHERE p.first AND NOT q.first),
  best AS (SELECT x.a AS a0, x.b AS b0, y.a AS a1, y.b AS b1, z.a AS a2, z.b AS b2, x.d AS d0, y.d AS d1, z.d AS d2 FROM cost x, cost y, cost z WHERE x.a = 0 AND y.a = 1 AND z.a = 2 AND x.b <> y.b AND x.b <> z.b AND y.b <> z.b ORDER BY x.d + y.d + z.d LIMIT 1)
  SELECT a0 AS a, b0 AS b, {r('d0')} AS distance FROM best UNION ALL SELECT a1, b1, {r('d1')} FROM best UNION ALL SELECT a2, b2, {r('d2')} FROM best""")
def d13(spark, d):
    return stability.match_centres(*_half_centres(spark, d)).withColumn("distance", num6(F.col("distance")))


# --- L. Tendency ----------------------------------------------------------------------------------

_HOPKINS = f"""{fx.V_LONG}, s AS (SELECT repeat, row_id FROM (SELECT repeat, row_id, row_number() OVER (PARTITION BY repeat ORDER BY {draw_sql(SEED, 'hopkins', 'repeat', 'row_id')}) AS i FROM v_vec, (SELECT unnest(range(0, 3)) AS repeat)) WHERE i <= 100),
  w AS (SELECT repeat, sum(d) AS w FROM (SELECT s.repeat, s.row_id, min(list_distance(a.v, b.v)) AS d FROM s JOIN v_vec a USING (row_id), v_vec b WHERE b.row_id <> s.row_id GROUP BY 1, 2) GROUP BY 1),
  bx AS (SELECT dim, min(x) AS low, max(x) AS high FROM v_long GROUP BY 1),
  pt AS (SELECT repeat, point, list(low + {uniform_sql(SEED, 'box', 'repeat', 'point', 'dim')} * (high - low) ORDER BY dim) AS v FROM (SELECT unnest(range(0, 3)) AS repeat), (SELECT unnest(range(0, 100)) AS point), bx GROUP BY 1, 2),
  u AS (SELECT repeat, sum(d) AS u FROM (SELECT repeat, point, min(list_distance(pt.v, v_vec.v)) AS d FROM pt, v_vec GROUP BY 1, 2) GROUP BY 1),
  h AS (SELECT repeat, u / (u + w) AS hopkins FROM u JOIN w USING (repeat))"""


@query("l1_hopkins", f"WITH {_HOPKINS} SELECT repeat::INT AS repeat, {r('hopkins')} AS hopkins FROM h")
def l1(spark, d):
    return tendency.hopkins(fx.v_vec(spark, d), 100, 3, SEED).withColumn("hopkins", num6(F.col("hopkins")))


@query("l2_hopkins_summary", f"WITH {_HOPKINS} SELECT 'vectors' AS representation, {r('avg(hopkins)')} AS mean, {r('stddev_samp(hopkins)')} AS std, {r('min(hopkins)')} AS min, {r('max(hopkins)')} AS max FROM h")
def l2(spark, d):
    repeats = tendency.hopkins(fx.v_vec(spark, d), 100, 3, SEED).withColumn("representation", F.lit("vectors"))
    return tendency.repeat_summary(repeats, "hopkins").withColumns({c: num6(F.col(c)) for c in ("mean", "std", "min", "max")})


# The tree grows from the first row: ``best`` holds each row's distance to the tree, infinite once it is inside.
_PRIM = f"""WITH RECURSIVE {PAIRS}, ids AS MATERIALIZED (SELECT row_id, row_number() OVER (ORDER BY row_id) AS i FROM v_vec),
  m AS MATERIALIZED (SELECT x.i AS i, list(coalesce(p.d, 'inf'::DOUBLE)::DOUBLE ORDER BY y.i) AS l FROM ids x CROSS JOIN ids y LEFT JOIN p ON p.a = x.row_id AND p.b = y.row_id GROUP BY 1),
  grown(step, best, inside, total) AS (SELECT 1, l, [i], 0.0::DOUBLE FROM m WHERE i = 1 UNION ALL
    SELECT step + 1, list_transform(g.best, lambda x, j: CASE WHEN j = m.i OR list_contains(g.inside, j) THEN 'inf'::DOUBLE ELSE least(x, m.l[j]) END), list_append(g.inside, m.i), total + list_min(g.best)
    FROM grown g JOIN m ON m.i = list_position(g.best, list_min(g.best)) WHERE step < len(g.best))"""


@query("l3_spanning_tree", f"{_PRIM} SELECT max(step)::BIGINT - 1 AS edges, {r('max(total)')} AS total_weight FROM grown")
def l3(spark, d):
    tree = tendency.distance_tree(fx.v_vec(spark, d))
    return tree.agg(F.count("*").alias("edges"), num6(F.sum("weight")).alias("total_weight"))


# --- M. Clustering --------------------------------------------------------------------------------


@query("m1_fixed_lloyd", f"WITH {fx.V_VEC}, {lloyd_ctes('v_vec', 3, 5, SEED)} SELECT row_id, cluster::INT AS cluster, {r('d')} AS distance FROM assigned")
def m1(spark, d):
    rows = fx.v_vec(spark, d).select("row_id", "v")
    return kmeans.assign(rows, kmeans.fixed_lloyd(rows, 3, 5, SEED), distance="distance").select("row_id", "cluster", num6(F.col("distance")).alias("distance"))


@query("m1_kmeans")
def m1k(spark, d):
    rows = fx.v_vec(spark, d).select("row_id", "v")
    fit = kmeans.kmeans(rows, [5], SEED, n_init=10)[5]
    sizes = kmeans.assign(rows, fit.centres).groupBy("cluster").agg(F.count("*").alias("rows"))
    return sizes.withColumn("inertia", F.lit(fit.inertia)).withColumn("converged", F.lit(fit.converged))


@query("m2_minibatch_kmeans")
def m2(spark, d):
    rows = fx.v_vec(spark, d).select("row_id", "v")
    fit = kmeans.minibatch_kmeans(rows, [5], SEED)[5]
    sizes = kmeans.assign(rows, fit.centres).groupBy("cluster").agg(F.count("*").alias("rows"))
    return sizes.withColumn("inertia", F.lit(fit.inertia)).withColumn("iterations", F.lit(fit.iterations))


@query("m3_assign_nearest", f"WITH {CENTRES} SELECT row_id, arg_min(cen.cluster, list_distance(v, c))::INT AS assigned FROM v_vec, cen GROUP BY 1")
def m3(spark, d):
    rows = labelled(spark, d)
    table = centroids(rows).orderBy("cluster").toArrow()
    return kmeans.assign(rows, vec.matrix(table.column("centre")), "assigned").select("row_id", "assigned")


@query("m4_inertia", f"WITH {CENTRES} SELECT {r('sum(d * d)', 5)} AS inertia FROM (SELECT row_id, min(list_distance(v, c)) AS d FROM v_vec, cen GROUP BY 1)")
def m4(spark, d):
    rows = labelled(spark, d)
    table = centroids(rows).orderBy("cluster").toArrow()
    marked = kmeans.assign(rows, vec.matrix(table.column("centre")), "assigned", "d")
    return marked.agg(num6(F.sum(F.col("d") * F.col("d")), 5).alias("inertia"))


@query("m5_partition_sweep")
def m5(spark, d):
    from segmentry.plans.jobs import partition_sweep

    return partition_sweep(fx.v_vec(spark, d), [2, 3, 4], SEED, n_init=3)


MICRO = 24


def micro_clusters(spark, d, k=MICRO):
    """Centres and row counts of a k-means fit: the reduced table for the tree methods."""
    rows = fx.v_vec(spark, d).select("row_id", "v")
    fit = kmeans.kmeans(rows, [k], SEED, n_init=1)[k]
    marked = kmeans.assign(rows, fit.centres)
    items = centroids(marked).select(F.col("cluster").alias("row_id"), F.col("centre").alias("v"), F.col("n").alias("weight"))
    return cut_lineage(items), marked.select("row_id", "cluster")


@query("m6_agglomerative")
def m6(spark, d):
    items, _ = micro_clusters(spark, d)
    table = hierarchy.pair_table(items)
    out = None
    for linkage in ("complete", "ward"):
        merges = hierarchy.agglomerate(items, table, linkage).select(F.lit(linkage).alias("linkage"), "left", "right", num6(F.col("height")).alias("height"), "size")
        out = merges if out is None else out.unionByName(merges)
    return out


@query("m6_single_linkage_full")
def m6s(spark, d):
    tree = tendency.distance_tree(fx.v_vec(spark, d))
    return hierarchy.single_linkage_of_tree(tree).select("left", "right", num6(F.col("height")).alias("height"))


@query("m7_tree_cuts")
def m7(spark, d):
    items, _ = micro_clusters(spark, d)
    merges = cut_lineage(hierarchy.agglomerate(items, hierarchy.pair_table(items), "average"))
    return hierarchy.cut_strategies(items, merges, "average", 4).withColumn("parameter", num6(F.col("parameter")))


@query("m8_cophenetic")
def m8(spark, d):
    items, _ = micro_clusters(spark, d)
    table = cut_lineage(hierarchy.pair_table(items))
    return hierarchy.cophenetic_correlation(hierarchy.agglomerate(items, table, "average"), table).select(num6(F.col("cophenetic_correlation")).alias("cophenetic_correlation"))


# Leaves of a feature tree over all rows, and what the linkages make of them step by step.
_RADIUS = 0.95
_LEAVES = f"""{fx.V_LONG}, t AS (SELECT 0 AS depth, row_id, '' AS node FROM v_vec UNION ALL
  SELECT t.depth + 1, t.row_id, t.node || CASE WHEN v.v[s.dim] > s.cut THEN '1' ELSE '0' END FROM t JOIN v_vec v USING (row_id) JOIN (
    SELECT node, dim, low + (high - low) / 2 AS cut FROM (SELECT *, sum(m) OVER (PARTITION BY node) AS r2, row_number() OVER (PARTITION BY node ORDER BY high - low DESC, dim) AS i FROM (
      SELECT t.node, dim, var_pop(x) AS m, min(x) AS low, max(x) AS high FROM t JOIN v_long USING (row_id) GROUP BY 1, 2)) WHERE i = 1 AND high > low AND r2 > {_RADIUS * _RADIUS}) s USING (node)),
  members AS MATERIALIZED (SELECT row_id, min(row_id) OVER (PARTITION BY node) AS leaf FROM (SELECT row_id, arg_max(node, depth) AS node FROM t GROUP BY 1)),
  items AS MATERIALIZED (SELECT leaf, list(m ORDER BY dim) AS v, max(n) AS w, sum(ss) AS inner_ss FROM (
    SELECT leaf, dim, avg(x) AS m, count(*) AS n, var_pop(x) * count(*) AS ss FROM members JOIN v_long USING (row_id) GROUP BY 1, 2) GROUP BY 1)"""
_LINKED = f"""{_LEAVES}, d AS MATERIALIZED (SELECT a.leaf AS a, b.leaf AS b, list_distance(a.v, b.v) AS d, (a.w * b.w)::DOUBLE AS w FROM items a, items b),
  s AS (SELECT linkage, 0 AS step, leaf, leaf AS c, NULL::BIGINT AS l, NULL::BIGINT AS r, NULL::DOUBLE AS height, NULL::DOUBLE AS links, NULL::DOUBLE AS linked
    FROM items, (SELECT unnest(['single', 'complete', 'average', 'ward']) AS linkage) UNION ALL
    SELECT s.linkage, s.step + 1, s.leaf, CASE WHEN s.c = m.b THEN m.a ELSE s.c END, m.a, m.b, m.h, m.links, m.linked FROM s JOIN (
      SELECT *, row_number() OVER (PARTITION BY linkage ORDER BY h, a, b) AS i FROM (
        SELECT g.linkage, g.a, g.b, g.links, g.linked, CASE g.linkage WHEN 'single' THEN low WHEN 'complete' THEN high WHEN 'average' THEN g.dist / g.ww
          ELSE sqrt(2 * sqrt(ga.ww) * sqrt(gb.ww) / (sqrt(ga.ww) + sqrt(gb.ww)) * greatest(g.sq / g.ww - ga.sq / ga.ww / 2 - gb.sq / gb.ww / 2, 0)) END AS h
        FROM (SELECT x.linkage, x.c AS a, y.c AS b, min(d) AS low, max(d) AS high, sum(w * d) AS dist, sum(w * d * d) AS sq, sum(w) AS ww, count(*) AS links, sum(d) AS linked
            FROM s x JOIN s y ON x.linkage = y.linkage AND x.c < y.c JOIN d ON d.a = x.leaf AND d.b = y.leaf GROUP BY 1, 2, 3) g
          JOIN (SELECT x.linkage, x.c AS c, sum(w * d * d) AS sq, sum(w) AS ww FROM s x JOIN s y ON x.linkage = y.linkage AND x.c = y.c JOIN d ON d.a = x.leaf AND d.b = y.leaf GROUP BY 1, 2) ga
            ON ga.linkage = g.linkage AND ga.c = g.a
          JOIN (SELECT x.linkage, x.c AS c, sum(w * d * d) AS sq, sum(w) AS ww FROM s x JOIN s y ON x.linkage = y.linkage AND x.c = y.c JOIN d ON d.a = x.leaf AND d.b = y.leaf GROUP BY 1, 2) gb
            ON gb.linkage = g.linkage AND gb.c = g.b)) m ON m.linkage = s.linkage AND m.i = 1),
  merges AS (SELECT DISTINCT linkage, step, l, r, height, links, linked FROM s WHERE step > 0)"""


def _leaf_merges(spark, d):
    tree = leaves.feature_tree(fx.v_vec(spark, d), _RADIUS)
    items = tree.items.select("row_id", "v", "weight")
    table = cut_lineage(hierarchy.pair_table(items))
    merges = cut_lineage(hierarchy.agglomerate_all(items, table))
    return tree, items, table, {n: merges.filter(F.col("linkage") == n).drop("linkage") for n in hierarchy.LINKAGES}


@query("m6_feature_tree", f"""WITH RECURSIVE {_LEAVES} SELECT leaf, w AS rows, {r('inner_ss', 5)} AS inner_squares, {r('inner_ss / (SELECT sum(q) FROM (SELECT var_pop(x) * count(*) AS q FROM v_long GROUP BY dim))', 6)} AS share_lost FROM items""")
def m6t(spark, d):
    tree = leaves.feature_tree(fx.v_vec(spark, d), _RADIUS)
    return tree.items.select(F.col("row_id").alias("leaf"), F.col("weight").alias("rows"), num6(F.col("inner"), 5).alias("inner_squares"), num6(F.col("inner") / tree.total).alias("share_lost"))


@query("m6_linkages", f"""WITH RECURSIVE {_LINKED} SELECT linkage, l AS "left", r AS "right", {r('height', 5)} AS height FROM merges""")
def m6l(spark, d):
    _, _, _, merges = _leaf_merges(spark, d)
    return reduce(lambda a, b: a.unionByName(b), [m.select(F.lit(n).alias("linkage"), "left", "right", num6(F.col("height"), 5).alias("height")) for n, m in merges.items()])


@query("m7_linkage_cuts", f"""WITH RECURSIVE {_LINKED} SELECT linkage, row_id, dense_rank() OVER (PARTITION BY linkage ORDER BY c) - 1 AS cluster FROM members JOIN s USING (leaf)
  WHERE step = (SELECT count(*) - 4 FROM items)""")
def m7l(spark, d):
    tree, items, _, merges = _leaf_merges(spark, d)
    cuts = [hierarchy.cut_count(items, m, 4).select(F.lit(n).alias("linkage"), F.col("row_id").alias("leaf"), "cluster") for n, m in merges.items()]
    labels = cut_lineage(reduce(lambda a, b: a.unionByName(b), cuts))
    return tree.members.join(labels, "leaf").select("linkage", "row_id", F.col("cluster").cast("bigint").alias("cluster"))


@query("m8_linkage_cophenetic", f"""WITH RECURSIVE {_LINKED}, sums AS (SELECT linkage, sum(links) AS n, sum(links * height) AS h, sum(links * height * height) AS hh, sum(height * linked) AS hd FROM merges GROUP BY 1),
  plain AS (SELECT sum(d) AS s, sum(d * d) AS ss FROM d WHERE a < b)
  SELECT linkage, {r('(n * hd - h * s) / sqrt((n * hh - h * h) * (n * ss - s * s))', 5)} AS cophenetic_correlation FROM sums, plain""")
def m8l(spark, d):
    _, _, table, merges = _leaf_merges(spark, d)
    parts = [hierarchy.cophenetic_correlation(m, table).select(F.lit(n).alias("linkage"), num6(F.col("cophenetic_correlation"), 5).alias("cophenetic_correlation")) for n, m in merges.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("m9_k_distance_curve", f"""WITH {PAIRS}, k AS (SELECT a AS row_id, d FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS i FROM p) WHERE i = 19)
  SELECT row_number() OVER (ORDER BY d) AS rank, {r('d')} AS k_distance FROM k""")
def m9(spark, d):
    return density.k_distance_curve(cut_lineage(density.k_distance(fx.v_vec(spark, d), 20))).select("rank", num6(F.col("k_distance")).alias("k_distance"))


_DBSCAN = f"""WITH RECURSIVE {PAIRS}, core AS MATERIALIZED (SELECT v.row_id FROM v_vec v LEFT JOIN p ON p.a = v.row_id AND p.d <= 1.2 GROUP BY 1 HAVING count(p.b) + 1 >= 5),
  e AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN core x ON x.row_id = p.a JOIN core y ON y.row_id = p.b WHERE d <= 1.2),
  reach(row_id, root) AS (SELECT row_id, row_id FROM core UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.row_id WHERE e.b > reach.root),
  lab AS (SELECT row_id, min(root) AS root FROM reach GROUP BY 1), num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM lab)),
  cl AS (SELECT row_id, cluster FROM lab JOIN num USING (root))
  SELECT v.row_id, coalesce(any_value(cl.cluster), min(nb.cluster), -1)::INT AS cluster FROM v_vec v LEFT JOIN cl USING (row_id)
    LEFT JOIN p ON p.a = v.row_id AND p.d <= 1.2 LEFT JOIN cl nb ON nb.row_id = p.b GROUP BY 1"""


@query("m10_dbscan", _DBSCAN)
def m10(spark, d):
    return density.dbscan(fx.v_vec(spark, d), 1.2, 5)


# Clusters of a least size from the Prim order of mutual reachability: the components below a weight are runs of it.
_LEAST = (5, 30, 75, 150)
_CONDENSED = f"""WITH RECURSIVE {PAIRS}, core AS (SELECT a, max(d) AS core FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS i FROM p) WHERE i <= 10 GROUP BY 1),
  ids AS MATERIALIZED (SELECT row_id, row_number() OVER (ORDER BY row_id) AS i, core FROM v_vec JOIN core ON a = row_id),
  m AS MATERIALIZED (SELECT x.i AS i, list(CASE WHEN p.d IS NULL THEN 'inf'::DOUBLE ELSE round(greatest(p.d, x.core, y.core)::DOUBLE, 9) END ORDER BY y.i) AS l FROM ids x CROSS JOIN ids y LEFT JOIN p ON p.a = x.row_id AND p.b = y.row_id GROUP BY 1),
  grown(step, place, h, best, inside) AS (SELECT 1, 1::BIGINT, 'inf'::DOUBLE, l, [i] FROM m WHERE i = 1 UNION ALL
    SELECT step + 1, m.i, list_min(g.best), list_transform(g.best, lambda x, j: CASE WHEN j = m.i OR list_contains(g.inside, j) THEN 'inf'::DOUBLE ELSE least(x, m.l[j]) END), list_append(g.inside, m.i)
    FROM grown g JOIN m ON m.i = list_position(g.best, list_min(g.best)) WHERE step < len(g.best)),
  seq AS MATERIALIZED (SELECT step AS pos, row_id, h FROM grown JOIN ids ON i = place),
  ws AS (SELECT w, lag(w) OVER (ORDER BY w) AS before FROM (SELECT DISTINCT h AS w FROM seq WHERE h < 'inf'::DOUBLE)),
  lev AS MATERIALIZED (SELECT w, pos, row_id, sum(CASE WHEN h > w THEN 1 ELSE 0 END) OVER (PARTITION BY w ORDER BY pos) AS run FROM ws, seq),
  comp AS MATERIALIZED (SELECT w, run, count(*) AS size, min(pos) AS lo, max(pos) AS hi, min(row_id) AS low FROM lev GROUP BY 1, 2),
  ls AS (SELECT unnest({list(_LEAST)}) AS least),
  tok AS MATERIALIZED (SELECT least, c.w, c.lo, c.hi, c.low FROM comp c JOIN ls ON c.size >= least JOIN ws ON ws.w = c.w
    LEFT JOIN comp b ON b.w = ws.before AND b.size >= least AND b.lo BETWEEN c.lo AND c.hi GROUP BY ALL HAVING count(b.lo) <> 1),
  fell AS MATERIALIZED (SELECT least, row_id, t.w AS w, arg_max(tok.w, tok.w) AS tw, arg_max(tok.low, tok.w) AS tid FROM (
      SELECT least, row_id, min(lev.w) AS w, arg_min(comp.lo, lev.w) AS lo, arg_min(comp.hi, lev.w) AS hi FROM lev JOIN comp USING (w, run) JOIN ls ON comp.size >= least GROUP BY 1, 2) t
    JOIN tok USING (least) WHERE tok.w <= t.w AND tok.lo >= t.lo AND tok.hi <= t.hi GROUP BY ALL),
  up AS MATERIALIZED (SELECT k.least, k.w, k.low, k.lo, k.hi, min(o.w) AS birth, arg_min(o.low, o.w) AS above FROM tok k LEFT JOIN tok o ON o.least = k.least AND o.w > k.w AND o.lo <= k.lo AND o.hi >= k.hi GROUP BY ALL),
  num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY least ORDER BY coalesce(birth, 'inf'::DOUBLE) DESC, w DESC, low) - 1 AS cluster, coalesce(1 / greatest(birth, 1e-12), 0.0::DOUBLE) AS lb FROM up),
  par AS MATERIALIZED (SELECT c.*, q.cluster AS parent, s.size FROM num c LEFT JOIN num q ON q.least = c.least AND q.w = c.birth AND q.low = c.above LEFT JOIN ws ON ws.w = c.birth
    LEFT JOIN comp s ON s.w = ws.before AND s.lo <= c.lo AND s.hi >= c.hi),
  pts AS MATERIALIZED (SELECT f.least, f.row_id, n.cluster, 1 / greatest(f.w, 1e-12) AS lam FROM fell f JOIN num n ON n.least = f.least AND n.w = f.tw AND n.low = f.tid),
  stab AS MATERIALIZED (SELECT c.*, coalesce((SELECT sum(lam - c.lb) FROM pts WHERE pts.least = c.least AND pts.cluster = c.cluster), 0)
    + coalesce((SELECT sum((x.lb - c.lb) * x.size) FROM par x WHERE x.least = c.least AND x.parent = c.cluster), 0) AS stability FROM par c),
  eom(least, c, below, wins) AS (SELECT least, max(cluster), list(0.0::DOUBLE), list(false) FROM stab GROUP BY 1 UNION ALL
    SELECT e.least, e.c - 1, list_transform(e.below, lambda x, j: CASE WHEN j = s.parent + 1 THEN x + greatest(s.stability, e.below[e.c + 1]) ELSE x END),
      list_transform(e.wins, lambda x, j: CASE WHEN j = e.c + 1 THEN s.parent IS NOT NULL AND s.stability >= e.below[e.c + 1] ELSE x END) FROM eom e JOIN stab s ON s.least = e.least AND s.cluster = e.c),
  won AS (SELECT s.*, wins[cluster + 1] AS win FROM stab s JOIN eom ON eom.least = s.least AND eom.c = -1),
  cho AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY least ORDER BY cluster) - 1 AS label FROM won x WHERE win AND NOT EXISTS (SELECT 1 FROM won y WHERE y.least = x.least AND y.win AND y.w > x.w AND y.lo <= x.lo AND y.hi >= x.hi))"""


def _density_trees(spark, d):
    rows = fx.v_vec(spark, d).select("row_id", "v")
    tree = condensed.reachability_tree(rows, 10)
    return rows, {least: condensed.hdbscan(rows, tree, least) for least in _LEAST}


@query("m11_hdbscan", f"""{_CONDENSED} SELECT ls.least, v.row_id, coalesce(max(cho.label), -1)::INT AS cluster FROM v_vec v CROSS JOIN ls LEFT JOIN pts ON pts.least = ls.least AND pts.row_id = v.row_id
  LEFT JOIN num n ON n.least = ls.least AND n.cluster = pts.cluster LEFT JOIN cho ON cho.least = ls.least AND cho.w >= n.w AND cho.lo <= n.lo AND cho.hi >= n.hi GROUP BY 1, 2""")
def m11(spark, d):
    rows, trees = _density_trees(spark, d)
    parts = [t.labels(rows).select(F.lit(least).alias("least"), "row_id", "cluster") for least, t in trees.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("m11_condensed_tree", f"""{_CONDENSED} SELECT least, cluster AS parent, row_id AS child, false AS is_cluster, {r('lam')} AS lambda, 1::BIGINT AS child_size FROM pts
  UNION ALL SELECT least, parent, cluster, true, {r('lb')}, size FROM par WHERE parent IS NOT NULL""")
def m11t(spark, d):
    _, trees = _density_trees(spark, d)
    parts = [t.rows().select(F.lit(least).alias("least"), "parent", "child", "is_cluster", num6(F.col("lambda")).alias("lambda"), "child_size") for least, t in trees.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("m12_gaussian_mixture")
def m12(spark, d):
    rows = _reduced(spark, d)
    models = mixture.fit_mixtures(rows, 3, seed=SEED, n_init=1, max_iter=40)
    out = None
    for kind, model in models.items():
        sizes = mixture.mixture_labels(rows, model).groupBy("cluster").agg(F.count("*").alias("rows")).select(F.lit(kind).alias("kind"), "cluster", "rows")
        out = sizes if out is None else out.unionByName(sizes)
    return out


def _reduced(spark, d, components=8):
    """Leading principal components of the vectors."""
    from pyspark.ml.functions import array_to_vector

    from segmentry.operators.factorisation import pca

    rows = fx.v_vec(spark, d).select("row_id", "cluster", array_to_vector("v").alias("features"))
    return cut_lineage(pca(rows, components).transform(rows))


@query("m13_mixture_diagnostics")
def m13(spark, d):
    rows = _reduced(spark, d)
    out = None
    for k in (2, 3):
        for kind, model in mixture.fit_mixtures(rows, k, ("diag", "full"), SEED, n_init=1, max_iter=40).items():
            facts = mixture.mixture_diagnostics(mixture.mixture_labels(rows, model), model).select(F.lit(kind).alias("kind"), F.lit(k).alias("k"), "aic", "bic", "mean_assignment_entropy")
            out = facts if out is None else out.unionByName(facts)
    return out


@query("m14_spectral")
def m14(spark, d):
    embedded, fit = spectral.spectral(fx.v_vec(spark, d), 3, SEED, n_init=5)
    return kmeans.assign(embedded, fit.centres).groupBy("cluster").agg(F.count("*").alias("rows"))


_SIGNATURES = fx.V_BUNDLE + """, sig AS MATERIALIZED (SELECT signature, min(row_id) AS row_id, count(*) AS weight, any_value(l) AS l FROM (
  SELECT row_id, string_agg(cluster::VARCHAR, ',' ORDER BY candidate) AS signature, list(cluster ORDER BY candidate) AS l FROM v_bundle GROUP BY 1) GROUP BY 1)"""


@query("m15_label_signatures", f"WITH {_SIGNATURES} SELECT signature, row_id, weight FROM sig")
def m15(spark, d):
    return consensus.signature_counts(fx.v_bundle(spark, d))


@query("m15_co_association", f"""WITH {_SIGNATURES} SELECT least(a.row_id, b.row_id) AS a_id, greatest(a.row_id, b.row_id) AS b_id, {r('list_sum(list_transform(range(1, len(a.l) + 1), lambda i: (a.l[i] = b.l[i])::INT)) / len(a.l)')} AS share,
  CASE WHEN a.row_id < b.row_id THEN a.weight ELSE b.weight END AS rows_a, CASE WHEN a.row_id < b.row_id THEN b.weight ELSE a.weight END AS rows_b FROM sig a JOIN sig b ON a.row_id < b.row_id""")
def m15c(spark, d):
    return consensus.co_association(fx.v_bundle(spark, d)).withColumn("share", num6(F.col("share")))


@query("m16_consensus")
def m16(spark, d):
    _, choice = consensus.consensus(fx.v_bundle(spark, d), fx.v_vec(spark, d))
    return choice.select("k", num6(F.col("silhouette")).alias("silhouette"), num6(F.col("minimum_cluster_fraction")).alias("minimum_cluster_fraction"))


_CHOICE_SCORES = """sc AS (SELECT CASE source WHEN 'web' THEN 'partitioning' WHEN 'books' THEN 'hierarchical' WHEN 'code' THEN 'density' WHEN 'wiki' THEN 'model_based' ELSE 'spectral' END AS family,
  source || '_' || lang AS configuration, avg(n_chars) / 1000.0::DOUBLE AS silhouette, avg(doc_id) AS bic, count(*) / (sum(count(*)) OVER (PARTITION BY source))::DOUBLE AS minimum_cluster_fraction,
  count(*) FILTER (n_chars < 300) / count(*)::DOUBLE AS noise_fraction FROM documents GROUP BY source, lang)"""


@query("m17_choose_candidates", f"""WITH {_CHOICE_SCORES}, v AS (SELECT * FROM sc WHERE minimum_cluster_fraction >= 0.02)
  SELECT * FROM (SELECT family, configuration FROM sc WHERE family = 'partitioning' ORDER BY silhouette DESC, configuration LIMIT 1) UNION ALL
  SELECT * FROM (SELECT family, configuration FROM v WHERE family = 'hierarchical' ORDER BY silhouette DESC, configuration LIMIT 1) UNION ALL
  SELECT * FROM (SELECT family, configuration FROM v WHERE family = 'spectral' ORDER BY silhouette DESC, configuration LIMIT 1) UNION ALL
  SELECT * FROM (SELECT family, configuration FROM v WHERE family = 'density' AND noise_fraction <= 0.5 ORDER BY silhouette * (1 - noise_fraction) DESC, configuration LIMIT 1) UNION ALL
  SELECT * FROM (SELECT family, configuration FROM sc WHERE family = 'model_based' ORDER BY bic, configuration LIMIT 1)""")
def m17(spark, d):
    docs = src.table(spark, d, "documents")
    source = F.col("source")
    family = (F.when(source == "web", "partitioning").when(source == "books", "hierarchical").when(source == "code", "density").when(source == "wiki", "model_based").otherwise("spectral"))
    bic = docs.groupBy(source.alias("family"), F.col("lang").alias("algorithm")).agg(F.avg("doc_id").alias("bic"))
    rows = scores(spark, d).join(bic, ["family", "algorithm"]).withColumn("configuration", F.concat_ws("_", "family", "algorithm"))
    rows = rows.withColumnRenamed("family", "source").withColumn("family", family)
    return selection.choose_candidates(rows)


# --- N. Validation --------------------------------------------------------------------------------


def _silhouette_sql(distance: str, digits: int = 6) -> str:
    return f"""{PAIRS}, m AS (SELECT a, ca, cb, avg({distance}) AS d FROM p GROUP BY 1, 2, 3), ab AS (SELECT v.row_id, v.cluster, max(d) FILTER (cb = ca) AS own, min(d) FILTER (cb <> ca) AS other FROM v_vec v JOIN m ON m.a = v.row_id GROUP BY 1, 2),
  sil AS MATERIALIZED (SELECT row_id, cluster, CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END AS silhouette FROM ab)"""


@query("n1_silhouette_points", f"WITH {_silhouette_sql('d')} SELECT row_id, cluster::BIGINT AS cluster, {r('silhouette')} AS silhouette FROM sil")
def n1(spark, d):
    return val.silhouette_points(labelled(spark, d)).select("row_id", "cluster", num6(F.col("silhouette")).alias("silhouette"))


@query("n1_silhouette_mean", f"WITH {_silhouette_sql('d')} SELECT 'cluster' AS candidate, {r('avg(silhouette)')} AS silhouette FROM sil")
def n1m(spark, d):
    return val.mean_silhouette(val.silhouette_points(labelled(spark, d))).withColumn("silhouette", num6(F.col("silhouette")))


@query("n2_cosine_silhouette", f"WITH {_silhouette_sql('cd')} SELECT {r('avg(silhouette)')} AS silhouette FROM sil")
def n2(spark, d):
    points = val.silhouette_points(labelled(spark, d), metric="cosine")
    return val.mean_silhouette(points).select(num6(F.col("silhouette")).alias("silhouette"))


_DB = f"""{CENTRES}, sp AS (SELECT cen.cluster, any_value(c) AS c, avg(list_distance(v, c)) AS s FROM v_vec JOIN cen USING (cluster) GROUP BY 1),
  db AS (SELECT avg(w) AS davies_bouldin FROM (SELECT i.cluster, max((i.s + j.s) / list_distance(i.c, j.c)) AS w FROM sp i, sp j WHERE i.cluster <> j.cluster GROUP BY 1))"""
_CH = """lg AS MATERIALIZED (SELECT cluster, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS dim FROM v_vec), cm AS (SELECT cluster, dim, avg(x) AS m, count(*) AS n FROM lg GROUP BY 1, 2), gm AS (SELECT dim, avg(x) AS g FROM lg GROUP BY 1),
  ch AS (SELECT (b / (k - 1)) / (w / (n - k)) AS calinski_harabasz, n FROM (SELECT (SELECT sum(n * (m - g) * (m - g)) FROM cm JOIN gm USING (dim)) AS b, (SELECT sum((x - m) * (x - m)) FROM lg JOIN cm USING (cluster, dim)) AS w,
    (SELECT count(DISTINCT cluster) FROM v_vec) AS k, (SELECT count(*) FROM v_vec) AS n))"""


@query("n3_davies_bouldin", f"WITH {_DB} SELECT {r('davies_bouldin')} AS davies_bouldin FROM db")
def n3(spark, d):
    return val.davies_bouldin(labelled(spark, d)).select(num6(F.col("davies_bouldin")).alias("davies_bouldin"))


@query("n4_calinski_harabasz", f"WITH {fx.V_VEC}, {_CH} SELECT {r('calinski_harabasz')} AS calinski_harabasz, {r('calinski_harabasz / n')} AS per_row FROM ch")
def n4(spark, d):
    return val.calinski_harabasz(labelled(spark, d)).select(num6(F.col("calinski_harabasz")).alias("calinski_harabasz"), num6(F.col("per_row")).alias("per_row"))


_DUNN = f"""ds AS (SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY cluster ORDER BY {draw_sql(SEED, 'dunn', 'row_id')}) AS i FROM v_vec) WHERE i <= 30),
  dn AS (SELECT min(d) FILTER (ca <> cb) / max(d) FILTER (ca = cb) AS dunn FROM p WHERE a IN (FROM ds) AND b IN (FROM ds))"""


@query("n5_dunn", f"WITH {PAIRS}, {_DUNN} SELECT {r('dunn')} AS dunn FROM dn")
def n5(spark, d):
    return val.dunn_index(labelled(spark, d), 300, SEED).select(num6(F.col("dunn")).alias("dunn"))


@query("n6_internal_metrics", f"""WITH {_silhouette_sql('d')}, {_DB[len(fx.V_VEC) + 2:]}, {_CH}, {_DUNN}, z AS (SELECT cluster, count(*) AS k FROM v_vec GROUP BY 1)
  SELECT (SELECT count(*) FROM v_vec) AS evaluated_rows, (SELECT min(k) FROM z) AS minimum_cluster_size, (SELECT {r('min(k) / sum(k)')} FROM z) AS minimum_cluster_fraction, (SELECT {r('max(k) / sum(k)')} FROM z) AS largest_cluster_fraction,
    (SELECT count(*) FROM z) AS clusters_found, 0.0::DOUBLE AS noise_fraction, (SELECT {r('avg(silhouette)')} FROM sil) AS silhouette, (SELECT {r('davies_bouldin')} FROM db) AS davies_bouldin, (SELECT {r('calinski_harabasz')} FROM ch) AS calinski_harabasz, (SELECT {r('dunn')} FROM dn) AS dunn_approx""")
def n6(spark, d):
    row = val.internal_metrics(labelled(spark, d), 300, SEED)
    return row.withColumns({c: num6(F.col(c)) for c in row.columns if c not in ("evaluated_rows", "minimum_cluster_size", "clusters_found")})


@query("n7_adjusted_rand", f"WITH {fx.V_BUNDLE}, {_ARI_CELLS} SELECT {r('ari')} AS ari FROM ari WHERE a_name = 'label' AND b_name = 'label_mod3'")
def n7(spark, d):
    rows = fx.v_vec(spark, d).withColumn("other", F.col("cluster") % 3)
    return val.adjusted_rand(val.contingency(rows, "cluster", "other")).select(num6(F.col("ari")).alias("ari"))


def _nmi_sql(source: str, a: str, b: str) -> str:
    return f"""(SELECT CASE WHEN ha + hb = 0 THEN 1 ELSE mi / ((ha + hb) / 2) END FROM (SELECT (SELECT sum(n / t * ln(n * t / (na * nb))) FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb
    FROM (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {source} GROUP BY 1, 2))) AS mi,
    (SELECT -sum(p * ln(p)) FROM (SELECT count(*) / (sum(count(*)) OVER ())::DOUBLE AS p FROM {source} GROUP BY {a})) AS ha, (SELECT -sum(p * ln(p)) FROM (SELECT count(*) / (sum(count(*)) OVER ())::DOUBLE AS p FROM {source} GROUP BY {b})) AS hb))"""


@query("n8_mutual_information", f"WITH {fx.V_VEC}, t AS (SELECT cluster AS a, v[1] > 0 AS b FROM v_vec) SELECT {r(_nmi_sql('t', 'a', 'b'))} AS nmi")
def n8(spark, d):
    rows = fx.v_vec(spark, d).withColumn("other", F.col("v")[0] > 0)
    return val.normalized_mutual_information(val.contingency(rows, "cluster", "other")).select(num6(F.col("nmi")).alias("nmi"))


@query("n9_ari_summary", f"WITH {fx.V_BUNDLE}, {_ARI_CELLS} SELECT {r('avg(ari)')} AS mean, {r('stddev_pop(ari)')} AS std, {r('min(ari)')} AS min FROM ari")
def n9(spark, d):
    row = val.ari_summary(val.pairwise_ari(fx.v_bundle(spark, d)))
    return row.select(*[num6(F.col(c)).alias(c) for c in ("mean", "std", "min")])


@query("n10_proxy_association", f"""WITH {fx.V_RESPONDENT} SELECT 'country' AS proxy, {r(_nmi_sql('v_respondent', 'country', 'region'))} AS normalized_mutual_information, (SELECT count(DISTINCT country) FROM v_respondent) AS categories UNION ALL
  SELECT 'segment', {r(_nmi_sql('v_respondent', 'segment', 'region'))}, (SELECT count(DISTINCT segment) FROM v_respondent)""")
def n10(spark, d):
    rows = fx.v_respondent(spark, d).withColumnRenamed("region", "cluster")
    return val.proxy_association(rows, ["country", "segment"]).withColumn("normalized_mutual_information", num6(F.col("normalized_mutual_information")))


@query("n11_gap_statistic")
def n11(spark, d):
    return stability.gap_statistic(fx.v_vec(spark, d), [2, 3, 4], 2, SEED, n_init=2)


_K_SCORES = """ks AS (SELECT l_linenumber AS k, avg(l_quantity) AS silhouette, avg(l_discount) AS davies_bouldin, avg(l_extendedprice) AS calinski_harabasz, avg(l_tax) AS stability, count(*)::DOUBLE AS inertia FROM lineitem GROUP BY 1)"""


def k_scores(spark, d):
    lines = src.table(spark, d, "lineitem")
    return lines.groupBy(F.col("l_linenumber").alias("k")).agg(
        F.avg("l_quantity").alias("silhouette"), F.avg("l_discount").alias("davies_bouldin"), F.avg("l_extendedprice").alias("calinski_harabasz"), F.avg("l_tax").alias("stability"), F.count("*").cast("double").alias("inertia"))


@query("n12_choose_k", """WITH """ + _K_SCORES + """, g AS (SELECT l_linenumber AS k, avg(l_extendedprice) AS gap, stddev_samp(l_extendedprice) / 100 AS se FROM lineitem GROUP BY 1),
  f AS (SELECT k, gap, coalesce(gap >= lead(gap) OVER (ORDER BY k) - lead(se) OVER (ORDER BY k), false) AS ok FROM g)
  SELECT (SELECT arg_max(k, silhouette) FROM ks) AS silhouette_best, coalesce((SELECT min(k) FROM f WHERE ok), (SELECT arg_max(k, gap) FROM f)) AS gap_one_se""")
def n12(spark, d):
    from segmentry.plans.table_queries import gaps

    return selection.choose_k(k_scores(spark, d), ordering.lead_one_se(gaps(spark, d))).select("silhouette_best", "gap_one_se")


@query("n12_elbow_knee", f"""WITH {_FALLING}, {knee_sql('c2')} SELECT knee AS elbow_knee FROM kk""")
def n12e(spark, d):
    from segmentry.plans.table_queries import gaps

    falling = k_scores(spark, d).withColumn("inertia", F.col("inertia") / F.col("k"))
    return selection.choose_k(falling, ordering.lead_one_se(gaps(spark, d))).select("elbow_knee")


@query("n13_rank_synthesis", f"""WITH {_K_SCORES}, a AS (SELECT k, rank() OVER (ORDER BY silhouette DESC) + rank() OVER (ORDER BY davies_bouldin) + rank() OVER (ORDER BY calinski_harabasz DESC) + rank() OVER (ORDER BY stability DESC) AS s FROM ks)
  SELECT k, s::DOUBLE AS selection_rank_sum, row_number() OVER (ORDER BY s, k) = 1 AS is_choice FROM a""")
def n13(spark, d):
    return selection.rank_synthesis(k_scores(spark, d)).select("k", "selection_rank_sum", "is_choice")


@query("n14_bootstrap_k_stability")
def n14(spark, d):
    rows = fx.v_vec(spark, d).select("row_id", "v")
    return stability.bootstrap_k_stability(rows, rows, [2, 3], rows.count(), 4, SEED, n_init=2)


@query("n15_seed_stability")
def n15(spark, d):
    rows = fx.v_vec(spark, d).select("row_id", "v")
    return stability.seed_stability(rows, rows, 3, list(range(SEED, SEED + 6)), n_init=2)[1]


@query("n16_bootstrap_stability")
def n16(spark, d):
    rows = fx.v_vec(spark, d).select("row_id", "v")
    return stability.bootstrap_stability(rows, rows, 3, rows.count(), 0.7, 6, SEED, n_init=2)[1]


@query("n17_co_clustering", f"""WITH {fx.V_BUNDLE}, s AS (SELECT row_id FROM (SELECT vec_id AS row_id, row_number() OVER (PARTITION BY label ORDER BY {draw_sql(SEED, 'strata', 'vec_id')}) AS i FROM embeddings) WHERE i <= 20)
  SELECT x.row_id AS a_id, y.row_id AS b_id, {r('count(*) / 3')} AS share FROM v_bundle x JOIN v_bundle y ON x.candidate = y.candidate AND x.cluster = y.cluster AND x.row_id < y.row_id
  WHERE x.row_id IN (FROM s) AND y.row_id IN (FROM s) GROUP BY 1, 2""")
def n17(spark, d):
    sample = samp.sample_per_group(fx.v_vec(spark, d), "row_id", "cluster", 20, SEED)
    return val.co_clustering(fx.v_bundle(spark, d), sample).withColumn("share", num6(F.col("share")))


@query("n18_agreement_matrix", f"WITH {fx.V_BUNDLE}, {_ARI_CELLS}, b AS (SELECT a_name, b_name, ari FROM ari UNION ALL SELECT b_name, a_name, ari FROM ari UNION ALL SELECT DISTINCT candidate, candidate, 1.0::DOUBLE FROM v_bundle) "
       f"SELECT a_name AS candidate, {r(chr(39).join(['max(ari) FILTER (b_name = ', 'first_sign', ')']))} AS first_sign, {r(chr(39).join(['max(ari) FILTER (b_name = ', 'label', ')']))} AS label, {r(chr(39).join(['max(ari) FILTER (b_name = ', 'label_mod3', ')']))} AS label_mod3 FROM b GROUP BY 1")
def n18(spark, d):
    pairs_ = val.pairwise_ari(fx.v_bundle(spark, d))
    flipped = pairs_.select(F.col("b_name").alias("a_name"), F.col("a_name").alias("b_name"), "ari")
    same = fx.v_bundle(spark, d).select(F.col("candidate").alias("a_name"), F.col("candidate").alias("b_name"), F.lit(1.0).alias("ari")).distinct()
    names = ["first_sign", "label", "label_mod3"]
    wide = pairs_.unionByName(flipped).unionByName(same).groupBy(F.col("a_name").alias("candidate")).pivot("b_name", names).agg(F.max("ari"))
    return wide.withColumns({n: num6(F.col(n)) for n in names})


def wide_labels(spark, d):
    return fx.v_vec(spark, d).select(
        "row_id", "v", F.col("cluster").cast("bigint").alias("label"), (F.col("cluster") % 3).cast("bigint").alias("label_mod3"), (F.col("v")[0] > 0).cast("bigint").alias("first_sign"))


@query("n19_metric_intervals")
def n19(spark, d):
    return stability.metric_intervals(wide_labels(spark, d), "label", 20, SEED)


def flip_bit_sql(seed: int, repeat: str, key: str) -> str:
    """Sign of a row in a repeat: a bit of the md5 that 128 repeats share, read from its hexadecimal digit."""
    digit = f"substr(md5('{seed}:flip:' || ({repeat} // 128)::VARCHAR || ':' || {key}::VARCHAR), ({repeat} % 128 // 4 + 1)::INT, 1)"
    return f"(2 * (((instr('0123456789abcdef', {digit}) - 1) >> (3 - {repeat} % 4)::INT) & 1) - 1)"


@query("n20_sign_flip", f"""WITH t AS (SELECT vec_id AS k, (embedding[1] - embedding[2])::DOUBLE AS d FROM embeddings), o AS (SELECT round(abs(avg(d)), 12) AS m FROM t),
  f AS (SELECT repeat, round(abs(avg(d * {flip_bit_sql(SEED, 'repeat', 'k')})), 12) AS m FROM t, (SELECT unnest(range(0, 199)) AS repeat) GROUP BY 1)
  SELECT {r('any_value(o.m)')} AS observed, {r('(count(*) FILTER (f.m >= o.m) + 1) / 200')} AS pvalue FROM f, o""")
def n20(spark, d):
    rows = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("embedding")[0] - F.col("embedding")[1]).cast("double").alias("d"))
    return val.sign_flip_test(rows, "d", "row_id", 199, SEED).select(num6(F.col("observed")).alias("observed"), num6(F.col("pvalue")).alias("pvalue"))


@query("n21_compare_methods")
def n21(spark, d):
    points = val.silhouette_points(wide_labels(spark, d), ["label", "label_mod3", "first_sign"])
    return stability.compare_methods(cut_lineage(points), "label_mod3", 199, SEED)


@query("n22_split_stability")
def n22(spark, d):
    types = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("experience"))
    rows = fx.v_vec(spark, d).select("row_id", "v").join(types, "row_id").join(fx.v_labels(spark, d).select("row_id", "types"), "row_id")
    return stability.split_stability(cut_lineage(rows), "experience", "types", 2, SEED, n_init=5, top=3)


@query("n23_sensitivity")
def n23(spark, d):
    rows = fx.v_vec(spark, d)
    variants = {f"first_{k}": rows.select("row_id", vec.head(F.col("v"), k).alias("v")) for k in (16, 32, 64)}
    return stability.sensitivity(variants, rows.select("row_id", "cluster"), 5, SEED, n_init=3)


# --- O. Assignment and explanation ----------------------------------------------------------------


@query("o1_extend_labels")
def o1(spark, d):
    rows = labelled(spark, d).withColumn("cluster", (F.col("cluster") % 3).cast("int"))
    labels, held, _ = supervised.extend_labels(rows.select("row_id", "v", "cluster"), rows, SEED, trees=30)
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("rows"))
    return sizes.withColumn("validation_accuracy", F.lit(held.first()[0]))


def _surrogate(spark, d):
    rows = labelled(spark, d).select("row_id", "v", "cluster")
    fit = kmeans.kmeans(rows.select("row_id", "v"), [3], SEED, n_init=3)[3]
    marked = cut_lineage(kmeans.assign(rows.select("row_id", "v"), fit.centres))
    return marked, *supervised.surrogate_tree(marked, SEED, leaf=20)


NAMES = [f"PC{i}" for i in range(1, 65)]


@query("o2_surrogate_tree")
def o2(spark, d):
    return _surrogate(spark, d)[2]


@query("o3_tree_rules")
def o3(spark, d):
    return explain.tree_rules(_surrogate(spark, d)[1], NAMES)


@query("o4_importance")
def o4(spark, d):
    return explain.importances(_surrogate(spark, d)[1], NAMES)


@query("o5_shapley")
def o5(spark, d):
    rows, model, _ = _surrogate(spark, d)
    return explain.mean_absolute_attribution(explain.tree_shapley(rows, model, 64), NAMES)


@query("o6_cluster_anomalies")
def o6(spark, d):
    return anomaly.cluster_anomalies(labelled(spark, d), 0.01, 40, SEED)


@query("o7_downstream_value")
def o7(spark, d):
    target = fx.v_target(spark, d).select("row_id", "target")
    rows = labelled(spark, d).withColumn("cluster", (F.col("cluster") % 2).cast("int")).join(target, "row_id")
    return supervised.downstream_value(rows.select("row_id", "v", "cluster", "target"), SEED)


@query("o8_typical_cases", f"""WITH {_silhouette_sql('d')}, own AS (SELECT a AS row_id, round(sum(d), 9) AS t FROM p WHERE ca = cb GROUP BY 1), f AS (SELECT row_id, cluster, silhouette, round(silhouette, 9) AS s, t FROM sil JOIN own USING (row_id)),
  k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY t, row_id) AS i, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, row_id) AS j, row_number() OVER (PARTITION BY cluster ORDER BY s, row_id) AS l FROM f)
  SELECT cluster::BIGINT AS cluster, 'medoid' AS kind, row_id, {r('silhouette')} AS silhouette FROM k WHERE i = 1 UNION ALL SELECT cluster::BIGINT, 'exemplar', row_id, {r('silhouette')} FROM k WHERE j = 1
  UNION ALL SELECT cluster::BIGINT, 'boundary', row_id, {r('silhouette')} FROM k WHERE l = 1""")
def o8(spark, d):
    rows = labelled(spark, d)
    return explain.typical_cases(rows, val.silhouette_points(rows)).withColumn("silhouette", num6(F.col("silhouette")))


@query("o9_low_silhouette_cases", f"WITH {_silhouette_sql('d')}, {fx.V_RESPONDENT} SELECT row_id, s.cluster::BIGINT AS cluster, {r('silhouette')} AS silhouette, country FROM (SELECT * FROM sil ORDER BY silhouette, row_id LIMIT (SELECT greatest(1, floor(0.05::DOUBLE * count(*))::BIGINT) FROM sil)) s JOIN v_respondent USING (row_id)")
def o9(spark, d):
    points = cut_lineage(val.silhouette_points(labelled(spark, d)))
    return explain.low_silhouette_cases(points, fx.v_respondent(spark, d).select("row_id", "country")).withColumn("silhouette", num6(F.col("silhouette")))


_ASSIGN_SQL = f"""WITH {fx.V_VEC}, q AS (SELECT row_id, v, cluster % 3 AS g FROM v_vec), cen AS MATERIALIZED (SELECT g, list(m ORDER BY dim) AS c FROM (SELECT g, dim, avg(x) AS m FROM (SELECT g, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS dim FROM q) GROUP BY 1, 2) GROUP BY 1),
  dd AS (SELECT row_id, max(list_distance(v, c)) FILTER (cen.g = 0) AS d0, max(list_distance(v, c)) FILTER (cen.g = 1) AS d1, max(list_distance(v, c)) FILTER (cen.g = 2) AS d2 FROM q, cen GROUP BY 1)
  SELECT row_id, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END::INT AS cluster, {r('d0')} AS distance_cluster_0, {r('d1')} AS distance_cluster_1, {r('d2')} AS distance_cluster_2 FROM dd"""


def _three_centres(spark, d):
    rows = fx.v_vec(spark, d).withColumn("cluster", F.col("cluster") % 3)
    return vec.matrix(centroids(rows).orderBy("cluster").toArrow().column("centre"))


def _assigned(rows):
    return rows.select("row_id", "cluster", *[num6(F.col(f"distance_cluster_{i}")).alias(f"distance_cluster_{i}") for i in range(3)])


@query("o10_batch_assignment", _ASSIGN_SQL)
def o10(spark, d):
    from segmentry.streaming.assignment import assign_with_distances

    return _assigned(assign_with_distances(fx.v_vec(spark, d).select("row_id", "v"), _three_centres(spark, d)))


@query("q1_stream_assignment", _ASSIGN_SQL)
def q1(spark, d):
    from segmentry.streaming.assignment import stream_assignments

    layer = stage_path(spark, "stream-in")
    rows = src.write_layer(fx.v_vec(spark, d).select("row_id", "v"), layer)
    source = spark.readStream.schema(rows.schema).parquet(layer)
    out = stage_path(spark, "stream-out")
    stream_assignments(source, _three_centres(spark, d), out, stage_path(spark, "stream-state")).awaitTermination()
    return _assigned(spark.read.parquet(out))


# --- P. Monitoring --------------------------------------------------------------------------------

_HALVES = fx.V_VEC + """, hv AS (SELECT row_id, v, row_number() OVER (ORDER BY row_id) <= (SELECT count(*) // 2 FROM v_vec) AS ref FROM v_vec), dl AS MATERIALIZED (SELECT 'PC' || dim AS feature, ref, x FROM (
  SELECT ref, unnest(v[1:10]) AS x, unnest(range(1, 11)) AS dim FROM hv))"""


def _psi_sql(source: str, keys: str) -> str:
    """PSI per ``keys`` of ``source(keys, ref, x)``."""
    return f"""ed AS MATERIALIZED (SELECT {keys}, list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FILTER (ref))) AS e FROM {source} GROUP BY {keys}),
  bn AS (SELECT {keys}, len([y for y in e[2:len(e) - 1] if y <= x]) AS bin, count(*) FILTER (ref) AS a, count(*) FILTER (NOT ref) AS b FROM {source} JOIN ed USING ({keys}) GROUP BY 1, 2),
  gr AS (SELECT {keys}, unnest(range(0, len(e) - 1)) AS bin FROM ed), sh AS (SELECT gr.{keys}, greatest(coalesce(a, 0) / (sum(a) OVER (PARTITION BY gr.{keys}))::DOUBLE, 1e-6) AS a, greatest(coalesce(b, 0) / (sum(b) OVER (PARTITION BY gr.{keys}))::DOUBLE, 1e-6) AS b FROM gr LEFT JOIN bn USING ({keys}, bin)),
  psi AS (SELECT {keys}, sum((b - a) * ln(b / a)) AS psi FROM sh GROUP BY 1)"""


_EVENT_HALVES = "ev AS MATERIALIZED (SELECT 1 AS g, value AS x, row_number() OVER (ORDER BY ts, event_id) <= (SELECT count(*) // 2 FROM events) AS ref FROM events)"


@query("p1_population_stability", f"WITH {_EVENT_HALVES}, {_psi_sql('ev', 'g')} SELECT {r('psi')} AS psi FROM psi")
def p1(spark, d):
    halves = cut_lineage(ordering.split_halves(_event_order(spark, d), "place"))
    return monitoring.population_stability(halves, "value", F.col("half") == 1, []).select(num6(F.col("psi")).alias("psi"))


_KS = """kc AS (SELECT feature, x, sum(ref::INT) AS a, sum((NOT ref)::INT) AS b FROM dl GROUP BY 1, 2), kr AS (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY feature) AS na, sum(b) OVER (PARTITION BY feature) AS nb FROM kc WINDOW w AS (PARTITION BY feature ORDER BY x)),
  ks AS (SELECT feature, max(abs(ca / na::DOUBLE - cb / nb::DOUBLE)) AS ks FROM kr GROUP BY 1)"""


@query("p2_ks_statistic", f"WITH {_HALVES}, {_KS} SELECT feature, {r('ks')} AS ks_statistic FROM ks")
def p2(spark, d):
    rows = cut_lineage(ordering.split_halves(fx.v_vec(spark, d), "row_id"))
    long = rows.select("half", F.posexplode(vec.head(F.col("v"), 10)).alias("i", "x")).select("half", F.concat(F.lit("PC"), (F.col("i") + 1).cast("string")).alias("feature"), "x")
    return monitoring.ks_statistic(long, "x", F.col("half") == 1, ["feature"]).select("feature", num6(F.col("ks_statistic")).alias("ks_statistic"))


@query("p3_drift_table", f"WITH {_HALVES}, {_psi_sql('dl', 'feature')}, {_KS} SELECT feature, {r('psi')} AS psi, {r('ks')} AS ks_statistic, psi > 0.2 OR ks > 0.1 AS alert FROM psi JOIN ks USING (feature)")
def p3(spark, d):
    rows = ordering.split_halves(fx.v_vec(spark, d), "row_id")
    table = monitoring.drift_table(rows, F.col("half") == 1)
    return table.select("feature", num6(F.col("psi")).alias("psi"), num6(F.col("ks_statistic")).alias("ks_statistic"), "alert")


@query("p4_release_gate", """SELECT 'rows' AS "check", count(*)::DOUBLE AS observed, count(*) > 0 AS passed FROM orders UNION ALL SELECT 'unique_keys', count(DISTINCT o_orderkey) - count(*), count(DISTINCT o_orderkey) = count(*) FROM orders
  UNION ALL SELECT 'lowest_price', min(o_totalprice), min(o_totalprice) >= 0 FROM orders UNION ALL SELECT 'statuses', count(DISTINCT o_orderstatus), count(DISTINCT o_orderstatus) = 3 FROM orders""")
def p4(spark, d):
    seen = F.col("observed")
    return monitoring.enforce(monitoring.expectations(src.table(spark, d, "orders"), {
        "rows": (F.count("*"), seen > 0), "unique_keys": (F.count_distinct(F.col("o_orderkey")) - F.count("*"), seen == 0),
        "lowest_price": (F.min("o_totalprice"), seen >= 0), "statuses": (F.count_distinct(F.col("o_orderstatus")), seen == 3)}))


@query("p5_registry_record", f"WITH {fx.V_VEC} SELECT 'centroids' AS model, count(*) AS rows, bit_xor(h) AS hash_xor FROM (SELECT ('0x' || substr(sha256(row_id::VARCHAR || '|' || cluster::VARCHAR), 1, 15))::BIGINT AS h FROM v_vec)")
def p5(spark, d):
    rows = labelled(spark, d)
    facts = src.fingerprint(rows.select("row_id", "cluster"))
    record = facts.select(F.lit("centroids").alias("model"), F.struct("rows", "hash_sum", "hash_xor").alias("data"))
    path = stage_path(spark, "registry")
    append_record(record, path, expected=0)
    return append_record(record, path, expected=0).select("model", "data.rows", "data.hash_xor")


@query("p5_registry_versions", f"""WITH {fx.V_VEC}, h AS (SELECT cluster, ('0x' || substr(sha256(row_id::VARCHAR || '|' || cluster::VARCHAR), 1, 15))::BIGINT AS h FROM v_vec)
  SELECT 'centroids' AS model, 1 AS version, count(*) AS rows, bit_xor(h) AS hash_xor FROM h UNION ALL SELECT 'centroids', 2, count(*), bit_xor(h) FROM h WHERE cluster > 0""")
def p5v(spark, d):
    """A model, its successor on other rows, and the successor once more, as a retried job would append it."""
    rows, path = labelled(spark, d).select("row_id", "cluster"), stage_path(spark, "registry")
    for part, latest in ((rows, 0), (rows.filter("cluster > 0"), 1), (rows.filter("cluster > 0"), 1)):
        held = append_record(src.fingerprint(part).withColumn("model", F.lit("centroids")), path, expected=latest)
    return held.select("model", "version", "rows", "hash_xor")


@query("p4_result_gate", f"""WITH {fx.V_VEC}, {fx.V_BUNDLE}, z AS (SELECT cluster, count(*) AS n FROM v_vec GROUP BY 1), b AS (SELECT candidate, count(*) AS n, count(DISTINCT row_id) AS u FROM v_bundle GROUP BY 1)
  SELECT 'sizes.cover_all' AS "check", (sum(n) - (SELECT count(*) FROM embeddings))::DOUBLE AS observed, sum(n) = (SELECT count(*) FROM embeddings) AS passed FROM z
  UNION ALL SELECT 'sizes.smallest', min(n)::DOUBLE, min(n) > 0 FROM z UNION ALL SELECT 'labelings.unique', (count(DISTINCT candidate) - count(*))::DOUBLE, count(DISTINCT candidate) = count(*) FROM b
  UNION ALL SELECT 'labelings.rows_once', max(n - u)::DOUBLE, max(n - u) = 0 FROM b UNION ALL SELECT 'labelings.rows_alike', (max(n) - min(n))::DOUBLE, max(n) = min(n) FROM b""")
def p4r(spark, d):
    """Result tables hang together: sizes add up to the rows, labelings are unique and cover the same rows once."""
    seen, rows = F.col("observed"), src.table(spark, d, "embeddings").count()
    sizes = labelled(spark, d).groupBy("cluster").agg(F.count("*").alias("n"))
    per = fx.v_bundle(spark, d).groupBy("candidate").agg(F.count("*").alias("n"), F.count_distinct(F.col("row_id")).alias("u"))
    return monitoring.enforce(monitoring.result_gate({
        "sizes": (sizes, {"cover_all": (F.sum("n") - rows, seen == 0), "smallest": (F.min("n"), seen > 0)}),
        "labelings": (per, {"unique": (F.count_distinct(F.col("candidate")) - F.count("*"), seen == 0), "rows_once": (F.max(F.col("n") - F.col("u")), seen == 0),
                            "rows_alike": (F.max("n") - F.min("n"), seen == 0)})}))


# --- Flagship -------------------------------------------------------------------------------------


def customer_features(spark, d):
    """Order count, mean price and label breadth per customer with orders, and the labels themselves."""
    from segmentry.functions import text as txt

    orders = src.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("row_id"), "o_totalprice")
    facts = orders.groupBy("row_id").agg(F.count("*").cast("double").alias("orders"), F.avg("o_totalprice").alias("price"))
    lines = src.table(spark, d, "lineitem").join(src.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    owned = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("row_id").agg(F.collect_set("p_type").alias("t"))
    joined = facts.join(owned, "row_id", "left").withColumn("types", F.array_join(F.array_sort("t"), ";")).drop("t")
    return joined.withColumn("breadth", txt.label_breadth(F.col("types")).cast("double"))


_FLAG = fx.V_LABELS + f""", f0 AS MATERIALIZED (SELECT o_custkey AS row_id, count(*)::DOUBLE AS orders, avg(o_totalprice) AS price FROM orders GROUP BY 1),
  ft AS MATERIALIZED (SELECT o_custkey AS row_id, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS types FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1),
  f1 AS MATERIALIZED (SELECT f0.row_id, orders, price, types, len({LABEL_LIST.format(c='types')})::DOUBLE AS breadth FROM f0 LEFT JOIN ft ON ft.row_id = f0.row_id),
  sc AS (SELECT {', '.join(f"quantile_cont({c}, 0.5) AS {c}_m, CASE WHEN quantile_cont({c}, 0.75) = quantile_cont({c}, 0.25) THEN 1.0::DOUBLE ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS {c}_s" for c in ('orders', 'price', 'breadth'))} FROM f1),
  fv AS MATERIALIZED (SELECT row_id, [(orders - orders_m) / orders_s, (price - price_m) / price_s, (breadth - breadth_m) / breadth_s]::DOUBLE[] AS v FROM f1, sc), {lloyd_ctes('fv', 3, 5, SEED)},
  g AS MATERIALIZED (SELECT assigned.cluster, f1.* FROM f1 JOIN assigned USING (row_id)),
  pr AS (SELECT cluster, count(*) AS respondents, 100 * count(*) / (SELECT count(*) FROM g)::DOUBLE AS share_pct, median(orders) AS orders_median, median(price) AS price_median, median(breadth) AS breadth_median FROM g GROUP BY 1),
  lb AS (SELECT cluster, label, count(*) AS n FROM (SELECT cluster, unnest({LABEL_LIST.format(c='types')}) AS label FROM g) GROUP BY 1, 2), lr AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS rank FROM lb)"""


@query("flagship_segments", f"""WITH {_FLAG} SELECT cluster::INT AS cluster, pr.respondents AS cluster_rows, {r('share_pct')} AS share_pct, {r('orders_median')} AS orders_median, {r('price_median', 3)} AS price_median, {r('breadth_median')} AS breadth_median,
  rank, label, n AS respondents, {r('100 * n / pr.respondents')} AS pct_cluster FROM pr JOIN lr USING (cluster) WHERE rank <= 8""")
def flagship(spark, d):
    from segmentry.operators.encoding import apply_scaler, scaler

    columns = ["orders", "price", "breadth"]
    rows = cut_lineage(customer_features(spark, d))
    scaled = apply_scaler(rows, columns, scaler(rows, columns, "robust"))
    vectors = cut_lineage(scaled.select("row_id", F.array(*columns).alias("v")))
    marked = kmeans.assign(vectors, kmeans.fixed_lloyd(vectors, 3, 5, SEED)).select("row_id", "cluster")
    joined = cut_lineage(rows.join(marked, "row_id"))
    profile = _flag_profile(joined, columns)
    top = explain.top_labels_per_cluster(joined.select("row_id", "cluster", "types"), ["types"])
    both = profile.join(top, "cluster")
    return both.select(
        "cluster", "cluster_rows", num6(F.col("share_pct")).alias("share_pct"), num6(F.col("orders_median")).alias("orders_median"), num6(F.col("price_median"), 3).alias("price_median"),
        num6(F.col("breadth_median")).alias("breadth_median"), "rank", "label", "respondents", num6(F.col("pct_cluster")).alias("pct_cluster"))


def _flag_profile(rows, columns):
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("cluster_rows"))
    shares = prof.with_share_of(sizes, "cluster_rows", prof.row_counts(rows), [], "share_pct")
    return shares.join(ordering.medians(rows, columns, ["cluster"]), "cluster")
