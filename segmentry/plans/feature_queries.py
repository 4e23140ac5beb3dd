"""Queries for sampling, feature encoding, reduction and factorisation."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from segmentry.functions import numeric as num
from segmentry.functions import text as txt
from segmentry.functions import vectors as vec
from segmentry.operators import encoding as enc
from segmentry.operators import factorisation as fac
from segmentry.operators import sampling as samp
from segmentry.operators.moments import bounding_box
from segmentry.plans import fixtures as fx
from segmentry.plans.fixtures import draw_sql, uniform_sql
from segmentry.plans.registry import query, r
from segmentry.plans.table_queries import LABEL_LIST
from segmentry.session import cut_lineage, stage_path
from segmentry.sources import tables as src

SEED = 42


def num6(c, digits=6):
    return num.rounded(c, digits)


# --- I. Sampling and splitting --------------------------------------------------------------------


@query("i1_sample_n", f"SELECT o_orderkey FROM orders ORDER BY {draw_sql(SEED, 'sample', 'o_orderkey')} LIMIT 500")
def i1(spark, d):
    return samp.sample_n(src.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500, SEED)


_BOOT_SQL = f"""b AS (SELECT i // n AS repeat, i % n AS draw, n FROM (SELECT unnest(range(0, n * 20)) AS i, n FROM (SELECT count(*) AS n FROM embeddings))),
  p AS (SELECT repeat, floor({uniform_sql(SEED, 'bootstrap', 'repeat', 'draw')} * n)::BIGINT AS position, count(*) AS weight FROM b GROUP BY 1, 2),
  o AS (SELECT vec_id AS row_id, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM embeddings)"""


@query("i2_bootstrap", f"WITH {_BOOT_SQL} SELECT repeat::INT AS repeat, row_id, weight FROM p JOIN o USING (position)")
def i2(spark, d):
    rows = fx.v_vec(spark, d).select("row_id")
    return samp.bootstrap(rows, "row_id", rows.count(), 20, SEED)


@query("i3_nested_bootstrap", f"""WITH k AS (SELECT repeat, row_id, position FROM (SELECT repeat, vec_id AS row_id,
    row_number() OVER (PARTITION BY repeat ORDER BY {draw_sql(SEED, 'nested-base', 'repeat', 'vec_id')}) - 1 AS position FROM embeddings, (SELECT unnest(range(0, 10)) AS repeat)) WHERE position < 300),
  n AS (SELECT repeat, count(*) AS n FROM k GROUP BY 1), b AS (SELECT repeat, n, unnest(range(1, floor(0.7::DOUBLE * n)::BIGINT + 1)) AS draw FROM n),
  p AS (SELECT repeat, floor({uniform_sql(SEED, 'nested-draw', 'repeat', 'draw')} * n)::BIGINT AS position, count(*) AS weight FROM b GROUP BY 1, 2)
  SELECT repeat::INT AS repeat, row_id, weight FROM k JOIN p USING (repeat, position)""")
def i3(spark, d):
    return samp.nested_bootstrap(fx.v_vec(spark, d), "row_id", 300, 0.7, 10, SEED)


@query("i4_stratified_sample", f"""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {draw_sql(SEED, 'strata', 'doc_id')}) AS i FROM documents) WHERE i <= 50""")
def i4(spark, d):
    return samp.sample_per_group(src.table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 50, SEED)


@query("i5_stratified_split", f"""SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {uniform_sql(SEED, 'split', 'o_orderkey')}) - 1
  < floor(0.75::DOUBLE * count(*) OVER (PARTITION BY o_orderstatus)) AS is_train FROM orders""")
def i5(spark, d):
    return samp.split(src.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 0.75, SEED, ["o_orderstatus"])


@query("i6_plain_split", f"SELECT o_orderkey, row_number() OVER (ORDER BY {uniform_sql(SEED, 'split', 'o_orderkey')}) - 1 < floor(0.75::DOUBLE * count(*) OVER ()) AS is_train FROM orders")
def i6(spark, d):
    return samp.split(src.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.75, SEED)


@query("i7_uniform_box", f"""WITH {fx.V_LONG}, b AS (SELECT dim, min(x) AS low, max(x) AS high FROM v_long GROUP BY 1), n AS (SELECT count(*) AS n FROM embeddings),
  p AS (SELECT i // n AS repeat, i % n AS point FROM (SELECT unnest(range(0, n * 2)) AS i, n FROM n))
  SELECT repeat::INT AS repeat, point, {r(f"sum(low + {uniform_sql(SEED, 'box', 'repeat', 'point', 'dim')} * (high - low))")} AS total FROM p, b GROUP BY 1, 2""")
def i7(spark, d):
    rows = fx.v_vec(spark, d)
    box = samp.uniform_box(bounding_box(rows), rows.count(), SEED, 2)
    return box.select("repeat", "point", num6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("i8_split_at_median", f"WITH {fx.V_RESPONDENT} SELECT row_id, (balance > (SELECT median(balance) FROM v_respondent))::INT AS side FROM v_respondent")
def i8(spark, d):
    return samp.split_at_median(fx.v_respondent(spark, d), "balance").select("row_id", "side")


# --- J. Encoding ----------------------------------------------------------------------------------

_WORDS = f"""w AS (SELECT row_number() OVER (ORDER BY place, item) - 1 AS feature_id, block, item FROM (
  SELECT DISTINCT 0 AS place, 'types' AS block, unnest({LABEL_LIST.format(c='types')}) AS item FROM v_labels UNION ALL
  SELECT DISTINCT 1, 'brands', unnest({LABEL_LIST.format(c='brands')}) FROM v_labels))"""


def _blocks():
    return {c: txt.split_labels(F.col(c)) for c in ("types", "brands")}


@query("j1_multi_hot", f"""WITH {fx.V_LABELS}, {_WORDS}, x AS (SELECT row_id, 'types' AS block, unnest({LABEL_LIST.format(c='types')}) AS item FROM v_labels UNION ALL
  SELECT row_id, 'brands', unnest({LABEL_LIST.format(c='brands')}) FROM v_labels) SELECT row_id, feature_id, 1.0::DOUBLE AS value FROM x JOIN w USING (block, item)""")
def j1(spark, d):
    rows = fx.v_labels(spark, d)
    return enc.encode_long(rows, "row_id", _blocks(), enc.dictionary(rows, _blocks()))


@query("j2_one_hot", f"""WITH {fx.V_RESPONDENT}, w AS (SELECT row_number() OVER (ORDER BY place, item) - 1 AS feature_id, block, item FROM (
  SELECT DISTINCT 0 AS place, 'segment' AS block, segment AS item FROM v_respondent UNION ALL SELECT DISTINCT 1, 'country', country FROM v_respondent))
  SELECT row_id, feature_id, 1.0::DOUBLE AS value FROM v_respondent JOIN w ON (block = 'segment' AND item = segment) OR (block = 'country' AND item = country)""")
def j2(spark, d):
    rows = fx.v_respondent(spark, d)
    blocks = {c: F.array_compact(F.array(c)) for c in ("segment", "country")}
    return enc.encode_long(rows, "row_id", blocks, enc.dictionary(rows, blocks))


def _scaled(kind):
    def run(spark, d):
        rows = src.table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") * 0).alias("flat"))
        facts = enc.scaler(rows, ["o_totalprice", "flat"], kind)
        scaled = enc.apply_scaler(rows, ["o_totalprice", "flat"], facts)
        return scaled.select("o_orderkey", num6(F.col("o_totalprice")).alias("price"), num6(F.col("flat")).alias("flat"))

    return run


query("j3_standard_scale", f"SELECT o_orderkey, {r('(o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()')} AS price, 0.0::DOUBLE AS flat FROM orders")(_scaled("standard"))
query("j4_robust_scale", f"""WITH q AS (SELECT quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS s FROM orders)
  SELECT o_orderkey, {r('(o_totalprice - m) / s')} AS price, 0.0::DOUBLE AS flat FROM orders, q""")(_scaled("robust"))
query("j5_minmax_scale", f"""SELECT o_orderkey, {r('(o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ())')} AS price, 0.0::DOUBLE AS flat FROM orders""")(_scaled("minmax"))


def mixed_rows(spark, d):
    """Customers with a number, a category and delimited labels (all part types a customer has ordered), written once."""
    orders = src.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("row_id"))
    lines = src.table(spark, d, "lineitem").join(src.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    owned = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("row_id").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ";").alias("types"))
    return cut_lineage(fx.v_respondent(spark, d).join(owned, "row_id", "left"))


_MIXED = fx.V_LABELS + ", " + fx.V_RESPONDENT + """, v_mixed AS (SELECT r.*, t.types FROM v_respondent r LEFT JOIN (
  SELECT o_custkey AS k, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS types FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1) t ON t.k = r.row_id)"""

_ASSEMBLED = f"""WITH {_MIXED}, q AS (SELECT quantile_cont(balance, 0.5) AS m, quantile_cont(balance, 0.75) - quantile_cont(balance, 0.25) AS s FROM v_mixed),
  w AS (SELECT row_number() OVER (ORDER BY place, item) AS feature_id, block, item FROM (
    SELECT DISTINCT 0 AS place, 'segment' AS block, segment AS item FROM v_mixed UNION ALL SELECT DISTINCT 1, 'types', unnest(string_split(types, ';')) FROM v_mixed)),
  x AS (SELECT row_id, 'segment' AS block, segment AS item FROM v_mixed UNION ALL SELECT row_id, 'types', unnest(string_split(types, ';')) FROM v_mixed)
  SELECT row_id, 0::BIGINT AS feature_id, {r('(balance - m) / s')} AS value FROM v_mixed, q WHERE {r('(balance - m) / s')} <> 0
  UNION ALL SELECT row_id, feature_id, 1.0::DOUBLE FROM x JOIN w USING (block, item)"""


def _nonzero(df):
    cells = F.posexplode(vector_to_array("features")).alias("feature_id", "value")
    long = df.select("row_id", cells).withColumn("value", num6(F.col("value"))).filter("value <> 0")
    return long.select("row_id", F.col("feature_id").cast("bigint").alias("feature_id"), "value")


@query("j6_assemble_features", _ASSEMBLED)
def j6(spark, d):
    rows = mixed_rows(spark, d)
    model, _ = enc.fit_encoder(rows, ["balance"], ["segment"], ["types"], "robust")
    return _nonzero(model.transform(rows))


@query("j7_label_matrix", f"""WITH {fx.V_LABELS}, t AS (SELECT row_id, {LABEL_LIST.format(c='types')} AS l FROM v_labels),
  q AS (SELECT quantile_cont(len(l), 0.5) AS m, CASE WHEN quantile_cont(len(l), 0.75) = quantile_cont(len(l), 0.25) THEN 1 ELSE quantile_cont(len(l), 0.75) - quantile_cont(len(l), 0.25) END AS s FROM t),
  w AS (SELECT row_number() OVER (ORDER BY item) AS feature_id, item FROM (SELECT DISTINCT unnest(l) AS item FROM t))
  SELECT row_id, 0::BIGINT AS feature_id, {r('(len(l) - m) / s')} AS value FROM t, q WHERE len(l) <> m
  UNION ALL SELECT row_id, feature_id, 1.0::DOUBLE FROM (SELECT row_id, unnest(l) AS item FROM t) JOIN w USING (item)""")
def j7(spark, d):
    rows = cut_lineage(fx.v_labels(spark, d).select("row_id", "types", txt.label_breadth(F.col("types")).alias("breadth")))
    model, _ = enc.fit_encoder(rows, ["breadth"], [], ["types"], "robust")
    return _nonzero(model.transform(rows))


@query("j8_feature_dictionary", f"WITH {fx.V_LABELS}, {_WORDS} SELECT feature_id, block, item FROM w")
def j8(spark, d):
    words = enc.dictionary(fx.v_labels(spark, d), _blocks())
    return src.write_layer(words, stage_path(spark, "words"))


@query("j9_saved_encoder", _ASSEMBLED)
def j9(spark, d):
    rows = mixed_rows(spark, d)
    model, _ = enc.fit_encoder(rows, ["balance"], ["segment"], ["types"], "robust")
    path = stage_path(spark, "encoder")
    model.write().overwrite().save(path)
    return _nonzero(PipelineModel.load(path).transform(rows))


@query("j9_table_encoder", _ASSEMBLED)
def j9t(spark, d):
    rows = mixed_rows(spark, d)
    # No vocabulary is small enough here, so rows meet their words by a join.
    encoder, _ = enc.fit_encoder(rows, ["balance"], ["segment"], ["types"], "robust", key="row_id", vocabulary_bytes=0)
    path = stage_path(spark, "table-encoder")
    encoder.save(path)
    return _nonzero(enc.TableEncoder.load(spark, path).transform(rows))


@query("a9_sparse_layer", f"WITH {fx.V_LABELS} SELECT row_id, len({LABEL_LIST.format(c='types')})::BIGINT AS filled FROM v_labels")
def a9(spark, d):
    rows = fx.v_labels(spark, d)
    model, _ = enc.fit_encoder(rows, [], [], ["types"])
    layer = src.write_layer(model.transform(rows).select("row_id", "features"), stage_path(spark, "sparse"))
    return layer.select("row_id", F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, x: s + x).cast("bigint").alias("filled"))


@query("e21_block_inventory", f"WITH {fx.V_LABELS}, {_WORDS} SELECT block, count(*) AS features FROM w GROUP BY 1")
def e21(spark, d):
    return enc.block_inventory(enc.dictionary(fx.v_labels(spark, d), _blocks()))


# --- K. Reduction ---------------------------------------------------------------------------------


def _dense_features(spark, d):
    from pyspark.ml.functions import array_to_vector

    return fx.v_vec(spark, d).select("row_id", array_to_vector("v").alias("features"))


@query("k1_pca_scores")
def k1(spark, d):
    rows = _dense_features(spark, d)
    model = fac.pca(rows, 10)
    return model.transform(rows).select("row_id", *[num6(F.col("v")[i]).alias(f"PC{i + 1}") for i in range(10)])


# With all components kept, the summed squared scores equal the summed squared centred values, which SQL can state.
@query("k1_pca_energy", f"WITH {fx.V_LONG} SELECT row_id, {r('sum((x - m) * (x - m))', 5)} AS energy FROM (SELECT row_id, x, avg(x) OVER (PARTITION BY dim) AS m FROM v_long) GROUP BY 1")
def k1e(spark, d):
    rows = _dense_features(spark, d)
    scores = fac.pca(rows, 64).transform(rows)
    return scores.select("row_id", num6(vec.dot(F.col("v"), F.col("v")), 5).alias("energy"))


@query("k2_truncated_svd")
def k2(spark, d):
    rows = _label_features(spark, d)
    model = fac.truncated_svd(rows, 3)
    return model.transform(rows).select("row_id", *[num6(F.col("v")[i]).alias(f"SV{i + 1}") for i in range(3)])


def _label_features(spark, d):
    rows = cut_lineage(fx.v_labels(spark, d))
    return enc.fit_encoder(rows, [], [], ["types", "brands"])[0].transform(rows).select("row_id", "features")


@query("k3_explained_variance")
def k3(spark, d):
    dense = _dense_features(spark, d)
    tables = [(fac.pca(dense, 10).variance_table(dense), "pca")]
    sparse = _label_features(spark, d)
    tables.append((fac.truncated_svd(sparse, 5).variance_table(sparse), "svd"))
    both = [t.select(F.lit(n).alias("method"), "component", num6(F.col("explained_variance_ratio")).alias("ratio"), num6(F.col("cumulative_explained_variance")).alias("total")) for t, n in tables]
    return both[0].unionByName(both[1])


def indicator_rows(spark, d):
    """Order label sets as sorted feature ids, with the dictionary."""
    rows = fx.v_labels(spark, d).filter(F.col("types").isNotNull())
    words = enc.dictionary(rows, _blocks())
    long = enc.encode_long(rows, "row_id", _blocks(), words)
    return long.groupBy("row_id").agg(F.array_sort(F.collect_list(F.col("feature_id").cast("int"))).alias("features")), words


@query("k4_nmf_scores")
def k4(spark, d):
    rows, words = indicator_rows(spark, d)
    width, table = words.count(), []
    rows = cut_lineage(rows)
    for k in (2, 3, 4):
        fit = fac.nmf(rows, k, width, SEED)
        labels = fac.nmf_weights(rows, fit)
        sizes = labels.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.count("*").alias("clusters"), (F.min("n") / F.sum("n")).alias("smallest"))
        table.append(sizes.select(F.lit(k).alias("components"), F.lit(fit.errors[0]).alias("first_error"), F.lit(fit.errors[-1]).alias("last_error"), F.lit(len(fit.errors)).alias("iterations"), "clusters", "smallest"))
    return table[0].unionByName(table[1]).unionByName(table[2])


_FIXED_KS = (2, 3, 4, 5, 6)


def _fixed_factors(k, width):
    """Components that are strong on every k-th feature; no two rows of a component are alike, so that weights do not tie."""
    c, j = np.indices((k, width))
    return np.where(j % k == c, 1.0 + c / 100, 0.1 + (7 * j + 3 * c) % 5 / 100)


_STEPS = 3
_WEIGHT_STEPS = ", ".join(f"""w{i + 1} AS (SELECT w.k, w.row_id, w.c, w.w * cr.x / greatest(den.den, 1e-12) AS w FROM w{i} w JOIN cr USING (k, row_id, c)
  JOIN (SELECT w.k, w.row_id, g.b AS c, sum(w.w * g.g) AS den FROM w{i} w JOIN g ON g.k = w.k AND g.a = w.c GROUP BY 1, 2, 3) den USING (k, row_id, c))""" for i in range(_STEPS))


@query("k4_nmf_choice", f"""WITH {fx.V_LABELS}, {_WORDS}, x AS MATERIALIZED (SELECT DISTINCT row_id, feature_id AS j FROM (SELECT row_id, 'types' AS block, unnest({LABEL_LIST.format(c='types')}) AS item FROM v_labels WHERE types IS NOT NULL
    UNION ALL SELECT row_id, 'brands', unnest({LABEL_LIST.format(c='brands')}) FROM v_labels WHERE types IS NOT NULL) JOIN w USING (block, item)),
  h AS (SELECT k, c, feature_id AS j, CASE WHEN feature_id % k = c THEN 1 + c / 100 ELSE 0.1 + (7 * feature_id + 3 * c) % 5 / 100 END AS h FROM w, (SELECT k, unnest(range(0, k)) AS c FROM (SELECT unnest({list(_FIXED_KS)}) AS k))),
  g AS MATERIALIZED (SELECT a.k, a.c AS a, b.c AS b, sum(a.h * b.h) AS g FROM h a JOIN h b USING (k, j) GROUP BY 1, 2, 3),
  cr AS MATERIALIZED (SELECT k, row_id, c, sum(h) AS x FROM x JOIN h USING (j) GROUP BY 1, 2, 3), w0 AS (SELECT k, row_id, c, 1 / k AS w FROM cr), {_WEIGHT_STEPS},
  wf AS MATERIALIZED (FROM w{_STEPS}),
  lab AS MATERIALIZED (SELECT k, row_id, c FROM (SELECT *, row_number() OVER (PARTITION BY k, row_id ORDER BY w DESC, c) AS i FROM wf) WHERE i = 1),
  size AS MATERIALIZED (SELECT k, c, count(*) AS n FROM lab GROUP BY 1, 2),
  total AS (SELECT k, count(*) AS clusters, sum(n) AS n, CASE WHEN count(*) < k THEN 0 ELSE min(n) / sum(n) END AS smallest FROM size GROUP BY 1),
  err AS (SELECT k, sqrt(sum(q) + (SELECT count(*) FROM x)) AS e FROM (SELECT k, -2 * sum(w * x) AS q FROM wf JOIN cr USING (k, row_id, c) GROUP BY 1
    UNION ALL SELECT a.k, sum(a.w * b.w * g.g) FROM wf a JOIN wf b USING (k, row_id) JOIN g ON g.k = a.k AND g.a = a.c AND g.b = b.c GROUP BY 1) GROUP BY 1),
  u AS MATERIALIZED (SELECT row_id, j, 1 / sqrt(count(*) OVER (PARTITION BY row_id)) AS u FROM x),
  sums AS (SELECT k, c, j, sum(u) AS s FROM lab JOIN u USING (row_id) GROUP BY 1, 2, 3),
  far AS (SELECT size.k, r.row_id, size.c, size.n, size.n - coalesce(d.d, 0) AS t FROM size, (SELECT DISTINCT row_id FROM x) r LEFT JOIN (SELECT k, row_id, c, sum(u * s) AS d FROM u JOIN sums USING (j) GROUP BY 1, 2, 3) d
    ON d.k = size.k AND d.row_id = r.row_id AND d.c = size.c),
  sil AS (SELECT k, avg(CASE WHEN n = 1 THEN 0 WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM (
    SELECT far.k, far.row_id, max(far.n) FILTER (far.c = lab.c) AS n, max(t / nullif(far.n - 1, 0)) FILTER (far.c = lab.c) AS a, min(t / far.n) FILTER (far.c <> lab.c) AS b
    FROM far JOIN lab ON lab.k = far.k AND lab.row_id = far.row_id GROUP BY 1, 2) GROUP BY 1),
  cell AS (SELECT k, row_id % 3 AS a, c AS b, count(*) AS n FROM lab GROUP BY 1, 2, 3), ra AS (SELECT k, a, sum(n) AS n FROM cell GROUP BY 1, 2), rb AS (SELECT k, b, sum(n) AS n FROM cell GROUP BY 1, 2),
  pc AS (SELECT k, sum(n * (n - 1) / 2) AS p FROM cell GROUP BY 1), pa AS (SELECT k, sum(n * (n - 1) / 2) AS p FROM ra GROUP BY 1), pb AS (SELECT k, sum(n * (n - 1) / 2) AS p FROM rb GROUP BY 1),
  ha AS (SELECT k, -sum(ra.n / t.n * ln(ra.n / t.n)) AS h FROM ra JOIN total t USING (k) GROUP BY 1), hb AS (SELECT k, -sum(rb.n / t.n * ln(rb.n / t.n)) AS h FROM rb JOIN total t USING (k) GROUP BY 1),
  mi AS (SELECT cell.k, sum(cell.n / t.n * ln(cell.n * t.n / (ra.n * rb.n))) AS m FROM cell JOIN total t USING (k) JOIN ra ON ra.k = cell.k AND ra.a = cell.a JOIN rb ON rb.k = cell.k AND rb.b = cell.b GROUP BY 1),
  f AS (SELECT total.k, sil.s, smallest, e / n AS e, (pc.p - pa.p * pb.p / (n * (n - 1) / 2)) / ((pa.p + pb.p) / 2 - pa.p * pb.p / (n * (n - 1) / 2)) AS ari, m / ((ha.h + hb.h) / 2) AS nmi,
    clusters > 1 AND smallest >= 0.02 AS valid FROM total JOIN sil USING (k) JOIN err USING (k) JOIN pc USING (k) JOIN pa USING (k) JOIN pb USING (k) JOIN ha USING (k) JOIN hb USING (k) JOIN mi USING (k))
  SELECT k::INT AS components, {r('s')} AS cosine_silhouette, {r('smallest')} AS minimum_cluster_fraction, {r('e')} AS error_per_row, {r('ari')} AS ari_vs_reference, {r('nmi')} AS nmi_vs_reference, valid,
    coalesce(k = (SELECT k FROM f WHERE valid ORDER BY s DESC, k LIMIT 1), false) AS selected FROM f""")
def k4c(spark, d):
    rows, words = indicator_rows(spark, d)
    rows, width = cut_lineage(rows), words.count()
    fits = {k: fac.Factors(_fixed_factors(k, width), []) for k in _FIXED_KS}
    table = fac.nmf_choice(rows, fits, rows.select("row_id", (F.col("row_id") % 3).alias("cluster")), inner=_STEPS)
    values = ("cosine_silhouette", "minimum_cluster_fraction", "error_per_row", "ari_vs_reference", "nmi_vs_reference")
    return table.withColumns({c: num6(F.col(c)) for c in values})


@query("k5_component_top_terms")
def k5(spark, d):
    rows, words = indicator_rows(spark, d)
    fit = fac.nmf(rows, 3, words.count(), SEED)
    top = fac.top_terms(fac.loadings_table(rows, fit.components), 15)
    named = top.join(words, F.col("feature") == F.col("feature_id"))
    return named.select("component", "rank", txt.feature_name("tech", F.col("block"), F.col("item")).alias("feature"), F.col("item").alias("label"), num6(F.col("loading")).alias("loading"))
