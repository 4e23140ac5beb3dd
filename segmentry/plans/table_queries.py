"""Queries for sources, cleaning, scalar functions, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from segmentry.functions import numeric as num
from segmentry.functions import text as txt
from segmentry.functions import vectors as vec
from segmentry.operators import cleaning as clean
from segmentry.operators import order as ordering
from segmentry.operators import profiling as prof
from segmentry.operators import sampling as samp
from segmentry.plans import fixtures as fx
from segmentry.plans.registry import query, r
from segmentry.session import cut_lineage, stage_path
from segmentry.sources import tables as src



def num6(c, digits=6):
    return num.rounded(c, digits)


# --- A. Sources and sinks -------------------------------------------------------------------------

RESPONDENT_SCHEMA = "row_id bigint, country string, segment string, balance double, region int"


@query("a1_csv_scan", f"WITH {fx.V_RESPONDENT} SELECT row_id, country, {r('balance', 2)} AS balance FROM v_respondent")
def a1(spark, d):
    path = stage_path(spark, "csv")
    src.write_csv(fx.v_respondent(spark, d), path)
    return src.scan_csv(spark, path, RESPONDENT_SCHEMA, ["row_id", "country", "balance"]).withColumn("balance", num6(F.col("balance"), 2))


@query("a2_source_contract", "SELECT count(*) AS rows, 2::BIGINT AS absent FROM orders")
def a2(spark, d):
    orders = src.require_columns(src.table(spark, d, "orders"), ["o_orderkey", "o_totalprice"])
    absent = src.missing_columns(orders.columns, ["o_orderkey", "no_such_a", "no_such_b"])
    return orders.agg(F.count("*").alias("rows")).withColumn("absent", F.lit(len(absent)).cast("bigint"))


@query("a3_schema_dictionary", """SELECT p_brand AS qname, p_type AS question, 'part' AS type, p_size::VARCHAR AS selector
  FROM part""")
def a3(spark, d):
    path = stage_path(spark, "dictionary")
    src.write_csv(src.table(spark, d, "part").select(
        F.col("p_brand").alias("qname"), F.col("p_type").alias("question"), F.lit("part").alias("type"),
        F.col("p_size").cast("string").alias("selector")), path)
    return src.scan_dictionary(spark, path)


@query("a4_non_empty_guard", "SELECT count(*) AS rows, count(o_orderkey) AS keyed_rows FROM orders")
def a4(spark, d):
    return src.require_non_empty(src.table(spark, d, "orders"), "o_orderkey")


@query("a5_parquet_layer", f"WITH {fx.V_LABELS} SELECT row_id, types FROM v_labels WHERE types IS NOT NULL")
def a5(spark, d):
    layer = src.write_layer(fx.v_labels(spark, d), stage_path(spark, "labels"))
    return layer.filter(F.col("types").isNotNull()).select("row_id", "types")


@query("a6_csv_sink_a7_rescan", "SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1")
def a6(spark, d):
    path = stage_path(spark, "result")
    src.write_csv(src.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n")), path)
    return src.read_csv_back(spark, path, "priority string, n bigint")


@query("a8_json_manifest", f"SELECT 'orders' AS name, count(*) AS rows, {r('max(o_totalprice)', 2)} AS top FROM orders")
def a8(spark, d):
    facts = src.table(spark, d, "orders").agg(
        F.struct(F.count("*").alias("rows"), num6(F.max("o_totalprice"), 2).alias("top")).alias("facts"), F.max(F.lit("orders")).alias("name"))
    back = src.write_manifest(facts, stage_path(spark, "manifest"))
    return back.select("name", "facts.rows", "facts.top")


@query("a10_dense_layer", f"WITH {fx.V_VEC} SELECT row_id, {r('v[1]')} AS first, {r('v[64]')} AS last FROM v_vec")
def a10(spark, d):
    layer = src.write_layer(fx.v_vec(spark, d).select("row_id", F.col("v").cast("array<float>").alias("v")), stage_path(spark, "dense"))
    return layer.select("row_id", num6(F.col("v")[0]).alias("first"), num6(F.col("v")[63]).alias("last"))


@query("a11_label_bundle", f"WITH {fx.V_BUNDLE} SELECT row_id, cluster FROM v_bundle WHERE candidate = 'label_mod3'")
def a11(spark, d):
    layer = src.write_layer(fx.v_bundle(spark, d), stage_path(spark, "bundle"), ["candidate"])
    return layer.filter(F.col("candidate") == "label_mod3").select("row_id", "cluster")


@query("a13_fingerprint", """SELECT count(*) AS rows, sum(h::DECIMAL(38,0))::VARCHAR AS hash_sum, bit_xor(h) AS hash_xor FROM (
  SELECT ('0x' || substr(sha256(o_orderkey::VARCHAR || '|' || o_orderstatus || '|' || o_orderpriority), 1, 15))::BIGINT AS h FROM orders)""")
def a13(spark, d):
    return src.fingerprint(src.table(spark, d, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("a14_union_chunks", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def a14(spark, d):
    lines = src.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_linestatus")
    both = lines.filter(F.col("l_linestatus") == "O").unionByName(lines.filter(F.col("l_linestatus") != "O"))
    return both.groupBy("flag").agg(F.count("*").alias("n"))


@query("a15_vector_upload", f"WITH {fx.V_LONG} SELECT row_id, {r('sum(x * x)', 4)} AS norm FROM v_long WHERE dim <= 8 GROUP BY 1")
def a15(spark, d):
    path = stage_path(spark, "upload")
    src.write_csv(fx.v_vec(spark, d).select("row_id", *[F.col("v")[i].alias(f"PC{i + 1}") for i in range(8)]), path)
    back = src.scan_vectors_csv(spark, path, 8)
    return back.select(F.col("row_id").cast("bigint"), num6(vec.dot(F.col("v"), F.col("v")), 4).alias("norm"))


# --- B. Projections, filters, predicates ----------------------------------------------------------


@query("b1_normalize_text", f"""WITH {fx.V_EXPERIENCE}
  SELECT row_id, nullif(trim(years_text), '') AS years_text FROM v_experience""")
def b1(spark, d):
    return clean.normalize_text(fx.v_experience(spark, d), ["years_text"]).select("row_id", "years_text")


@query("b1_normalize_report", f"""WITH {fx.V_EXPERIENCE}
  SELECT 'brand' AS "column", 0::BIGINT AS changed_rows UNION ALL
  SELECT 'years_text', count(*) FILTER (years_text IS NOT NULL AND years_text <> trim(years_text)) FROM v_experience""")
def b1r(spark, d):
    return clean.normalize_report(fx.v_experience(spark, d), ["brand", "years_text"])


@query("b2_drop_failed_check", f"""WITH {fx.V_SURVEY}
  SELECT row_id, trim("Check") AS "check" FROM v_survey WHERE "Check" IS NULL OR lower(trim("Check")) = 'apples'""")
def b2(spark, d):
    checked = clean.normalize_text(fx.v_survey(spark, d).select("row_id", F.col("Check").alias("check")), ["check"])
    return clean.drop_failed_check(checked, "check")


@query("b3_range_to_null", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 5 AND 45 THEN l_quantity END AS quantity FROM lineitem")
def b3(spark, d):
    return src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", num.in_range(F.col("l_quantity"), 5, 45).alias("quantity"))


@query("b4_missing_indicator", f"WITH {fx.V_LABELS} SELECT row_id, (types IS NULL)::INT AS missing FROM v_labels")
def b4(spark, d):
    return fx.v_labels(spark, d).select("row_id", num.missing_flag(F.col("types")).cast("int").alias("missing"))


@query("b5_require_any", f"WITH {fx.V_LABELS} SELECT row_id FROM v_labels WHERE coalesce(types, brands) IS NOT NULL")
def b5(spark, d):
    return clean.require_any(fx.v_labels(spark, d), ["types", "brands"]).select("row_id")


@query("b6_fill_constants", f"WITH {fx.V_LABELS} SELECT row_id, coalesce(types, '') AS types, coalesce(brands, 'Missing') AS brands FROM v_labels")
def b6(spark, d):
    return fx.v_labels(spark, d).fillna({"types": "", "brands": "Missing"}).select("row_id", "types", "brands")


@query("b7_positive_or_null", f"WITH {fx.V_RESPONDENT} SELECT row_id, CASE WHEN balance > 0 THEN balance END AS balance FROM v_respondent")
def b7(spark, d):
    return fx.v_respondent(spark, d).select("row_id", num.positive(F.col("balance")).alias("balance"))


@query("b8_role_projection", f"WITH {fx.V_SURVEY} SELECT row_id, DevType, EdLevel, AISelect, Country AS CountryOriginal FROM v_survey")
def b8(spark, d):
    return fx.v_survey(spark, d).select("row_id", "DevType", "EdLevel", "AISelect", F.col("Country").alias("CountryOriginal"))


@query("b9_assert_finite", "SELECT row_id, place FROM (SELECT event_id AS row_id, 0 AS place FROM events WHERE value = 0) WHERE false")
def b9(spark, d):
    events = src.table(spark, d, "events").select(F.col("event_id").alias("row_id"), F.array("value", F.lit(0.0)).alias("v"))
    exploded = events.select("row_id", F.posexplode("v").alias("place", "x"))
    return exploded.filter(num.finite(F.col("x")).isNull()).select("row_id", "place")


SCORES_SQL = """scores AS (
  SELECT source AS family, lang AS algorithm, count(*)::BIGINT AS k_requested, avg(n_chars) / 1000.0::DOUBLE AS silhouette,
    count(*) / (sum(count(*)) OVER (PARTITION BY source))::DOUBLE AS minimum_cluster_fraction,
    count(*) FILTER (n_chars < 300) / count(*)::DOUBLE AS noise_fraction FROM documents GROUP BY 1, 2)"""


def scores(spark, d):
    """Score table in the role of a configuration comparison: one row per document source and language."""
    docs = src.table(spark, d, "documents")
    rows = docs.groupBy(F.col("source").alias("family"), F.col("lang").alias("algorithm")).agg(
        F.count("*").alias("k_requested"), (F.avg("n_chars") / 1000.0).alias("silhouette"),
        (F.count_if(F.col("n_chars") < 300) / F.count("*")).alias("noise_fraction"))
    whole = F.sum("k_requested").over(Window.partitionBy("family"))
    return rows.withColumn("minimum_cluster_fraction", F.col("k_requested") / whole)


@query("b10_eligible_configurations", f"""WITH {SCORES_SQL} SELECT family, algorithm, {r('silhouette')} AS silhouette FROM scores
  WHERE minimum_cluster_fraction >= 0.02 AND silhouette IS NOT NULL""")
def b10(spark, d):
    from segmentry.operators.selection import eligible

    return eligible(scores(spark, d), 0.02).select("family", "algorithm", num6(F.col("silhouette")).alias("silhouette"))


@query("b11_density_validity", f"""WITH {SCORES_SQL} SELECT family, algorithm, {r('silhouette * (1 - noise_fraction)')} AS selection_score
  FROM scores WHERE noise_fraction <= 0.5""")
def b11(spark, d):
    from segmentry.operators.selection import density_score

    return density_score(scores(spark, d)).select("family", "algorithm", num6(F.col("selection_score")).alias("selection_score"))


@query("b12_drop_noise", "SELECT vec_id AS row_id, label::INT - 1 AS cluster FROM embeddings WHERE label - 1 >= 0")
def b12(spark, d):
    return fx.v_vec(spark, d).select("row_id", (F.col("cluster").cast("int") - 1).alias("cluster")).filter(F.col("cluster") >= 0)


@query("b13_interactive_slice", f"""WITH {fx.V_RESPONDENT} SELECT row_id, country, balance FROM v_respondent
  WHERE region IN (1, 3) AND balance BETWEEN 0 AND 5000""")
def b13(spark, d):
    rows = fx.v_respondent(spark, d).filter(F.col("region").isin(1, 3) & F.col("balance").between(0, 5000))
    return rows.select("row_id", "country", "balance")


@query("b14_prefix", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'STANDARD%'")
def b14(spark, d):
    return src.table(spark, d, "part").filter(F.col("p_type").startswith("STANDARD")).select("p_partkey", "p_type")


@query("b15_vector_slice", f"WITH {fx.V_VEC} SELECT row_id, {r('list_sum(v[1:10])')} AS head_sum, {r('list_sum(v[1:63])')} AS body_sum FROM v_vec")
def b15(spark, d):
    def total(v):
        return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)

    return fx.v_vec(spark, d).select("row_id", num6(total(vec.head(F.col("v"), 10))).alias("head_sum"), num6(total(vec.drop_last(F.col("v")))).alias("body_sum"))


@query("b16_finite_only", "SELECT event_id, value FROM events WHERE isfinite(value)")
def b16(spark, d):
    return src.table(spark, d, "events").filter(num.finite(F.col("value")).isNotNull()).select("event_id", "value")


@query("b17_drop_degenerate", f"""WITH {fx.V_BUNDLE}, b AS (SELECT * FROM v_bundle UNION ALL SELECT vec_id, 'constant', 0 FROM embeddings),
  s AS (SELECT candidate, cluster, count(*) AS n FROM b GROUP BY 1, 2)
  SELECT candidate, count(*) AS n FROM b WHERE candidate IN (SELECT candidate FROM s GROUP BY 1 HAVING count(*) > 1 AND min(n) >= 2) GROUP BY 1""")
def b17(spark, d):
    bundle = fx.v_bundle(spark, d)
    constant = fx.v_vec(spark, d).select("row_id", F.lit("constant").alias("candidate"), F.lit(0).alias("cluster"))
    return prof.drop_degenerate(bundle.unionByName(constant)).groupBy("candidate").agg(F.count("*").alias("n"))


@query("b18_non_negative", f"SELECT {r('min(l_quantity)')} AS lowest, min(l_quantity) >= 0 AS passed FROM lineitem")
def b18(spark, d):
    from segmentry.operators.factorisation import require_non_negative

    return require_non_negative(src.table(spark, d, "lineitem"), "l_quantity")


# --- C. Scalar functions --------------------------------------------------------------------------


@query("c1_parse_experience", f"WITH {fx.V_YEARS} SELECT row_id, CASE WHEN years BETWEEN 0 AND 51 THEN years END AS years FROM v_years")
def c1(spark, d):
    return fx.v_experience(spark, d).select("row_id", txt.parse_experience(F.col("years_text")).alias("years"))


@query("c2_to_number", f"WITH {fx.V_EXPERIENCE} SELECT row_id, TRY_CAST(trim(years_text) AS DOUBLE) AS number FROM v_experience")
def c2(spark, d):
    return fx.v_experience(spark, d).select("row_id", txt.to_number(F.col("years_text")).alias("number"))


@query("c3_map_ordinal", f"WITH {fx.V_ORDINAL} SELECT row_id, {fx.PRIORITY_CASE} AS points FROM v_ordinal")
def c3(spark, d):
    return fx.v_ordinal(spark, d).select("row_id", txt.lookup(F.col("priority"), fx.PRIORITY_POINTS).alias("points"))


@query("c4_log1p", f"SELECT o_orderkey, {r('ln(1 + o_totalprice)')} AS log_price FROM orders")
def c4(spark, d):
    return src.table(spark, d, "orders").select("o_orderkey", num6(F.log1p("o_totalprice")).alias("log_price"))


@query("c5_clipped_ratio", f"""SELECT l_orderkey, l_linenumber, {r('least(greatest(l_quantity / greatest(l_tax * 100, 0.5), 0), 2)')} AS ratio
  FROM lineitem""")
def c5(spark, d):
    ratio = num.clipped_ratio(F.col("l_quantity"), F.col("l_tax") * 100)
    return src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", num6(ratio).alias("ratio"))


C67_SQL = """t AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, CASE WHEN l_quantity > 10 THEN l_discount * 100 END AS b,
  CASE WHEN l_linestatus = 'O' THEN l_tax * 100 END AS c FROM lineitem)"""


def _three(spark, d):
    return src.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.when(F.col("l_quantity") > 10, F.col("l_discount") * 100).alias("b"),
        F.when(F.col("l_linestatus") == "O", F.col("l_tax") * 100).alias("c"))


@query("c6_row_median", f"WITH {C67_SQL} SELECT l_orderkey, l_linenumber, {r('list_median([x for x in [a, b, c] if x is not null])')} AS middle FROM t")
def c6(spark, d):
    return _three(spark, d).select("l_orderkey", "l_linenumber", num6(num.row_median(F.col("a"), F.col("b"), F.col("c"))).alias("middle"))


@query("c7_row_spread", f"WITH {C67_SQL} SELECT l_orderkey, l_linenumber, {r('greatest(a, b, c) - least(a, b, c)')} AS spread FROM t")
def c7(spark, d):
    return _three(spark, d).select("l_orderkey", "l_linenumber", num6(num.row_spread(F.col("a"), F.col("b"), F.col("c"))).alias("spread"))


@query("c8_row_sum", f"WITH {C67_SQL} SELECT l_orderkey, l_linenumber, ((b IS NULL)::INT + (c IS NULL)::INT)::BIGINT AS gaps FROM t")
def c8(spark, d):
    gaps = num.missing_flag(F.col("b")).cast("bigint") + num.missing_flag(F.col("c")).cast("bigint")
    return _three(spark, d).select("l_orderkey", "l_linenumber", gaps.alias("gaps"))


LABEL_LIST = "list_sort(list_distinct([trim(x) for x in string_split(coalesce({c}, ''), ';') if trim(x) <> '']))"


@query("c9_split_labels", f"WITH {fx.V_LABELS} SELECT row_id, array_to_string({LABEL_LIST.format(c='types')}, '|') AS labels FROM v_labels")
def c9(spark, d):
    return fx.v_labels(spark, d).select("row_id", F.array_join(txt.split_labels(F.col("types")), "|").alias("labels"))


@query("c10_label_breadth", f"""WITH {fx.V_LABELS} SELECT row_id, len({LABEL_LIST.format(c='types')})::BIGINT AS types_n,
  (len({LABEL_LIST.format(c='types')}) + len({LABEL_LIST.format(c='brands')}))::BIGINT AS total FROM v_labels""")
def c10(spark, d):
    rows = clean.label_breadths(fx.v_labels(spark, d), ["types", "brands"], "total")
    return rows.select("row_id", F.col("typesBreadth").cast("bigint").alias("types_n"), F.col("total").cast("bigint").alias("total"))


@query("c11_feature_names", """SELECT DISTINCT 'tech__Part__' || p_type AS feature, p_type AS label FROM part""")
def c11(spark, d):
    named = src.table(spark, d, "part").select(txt.feature_name("tech", F.lit(txt.domain_of("PartHaveWorkedWith")), F.col("p_type")).alias("feature"))
    return named.distinct().withColumn("label", txt.label_of_feature(F.col("feature")))


C12_SQL = f"""WITH {fx.V_VEC}, o AS (SELECT * FROM v_vec WHERE row_id = (SELECT min(row_id) FROM v_vec))
  SELECT v.row_id, {r('list_distance(v.v, o.v)')} AS euclid, {r('1 - list_cosine_similarity(v.v, o.v)')} AS cosine FROM v_vec v, o"""


@query("c12_vector_distance", C12_SQL)
def c12(spark, d):
    rows = fx.v_vec(spark, d)
    origin = rows.orderBy("row_id").limit(1).select(F.col("v").alias("o"), F.lit(0).alias("one"))
    both = rows.withColumn("one", F.lit(0)).join(F.broadcast(origin), "one")
    return both.select("row_id", num6(vec.euclidean(F.col("v"), F.col("o"))).alias("euclid"), num6(vec.cosine_distance(F.col("v"), F.col("o"))).alias("cosine"))


@query("c13_entropy", f"""SELECT l_orderkey, l_linenumber, {r("-(p * ln(greatest(p, 1e-12::DOUBLE)) + (1 - p) * ln(greatest(1 - p, 1e-12::DOUBLE)))")} AS entropy
  FROM (SELECT l_orderkey, l_linenumber, l_discount AS p FROM lineitem)""")
def c13(spark, d):
    p = F.array(F.col("l_discount"), 1 - F.col("l_discount"))
    return src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", num6(vec.entropy(p)).alias("entropy"))


@query("c14_arg_max", f"WITH {fx.V_VEC} SELECT row_id, (list_position(v, list_max(v)) - 1)::INT AS top FROM v_vec")
def c14(spark, d):
    return fx.v_vec(spark, d).select("row_id", vec.arg_max(F.col("v")).alias("top"))


@query("c15_safe_log", f"SELECT event_id, {r('ln(greatest(value, 2.2250738585072014e-308::DOUBLE))')} AS log_value FROM events")
def c15(spark, d):
    return src.table(spark, d, "events").select("event_id", num6(num.safe_log(F.col("value"))).alias("log_value"))


@query("c16_percent_text", "SELECT o_orderkey, printf('%.1f%%', round(o_custkey % 97 / 97.0::DOUBLE * 100, 1)) AS pct FROM orders")
def c16(spark, d):
    return src.table(spark, d, "orders").select("o_orderkey", txt.percent_text(F.col("o_custkey") % 97 / 97.0).alias("pct"))


C17_SQL = f"""WITH {fx.V_LABELS}, t AS (SELECT row_id, {LABEL_LIST.format(c='types')} AS a, {LABEL_LIST.format(c="replace(types, 'STANDARD', 'SMALL')")} AS b FROM v_labels)
  SELECT row_id, array_to_string(list_sort(list_intersect(a, b)), ';') AS shared,
    {r('len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0)')} AS jaccard FROM t"""


@query("c17_set_jaccard", C17_SQL)
def c17(spark, d):
    rows = fx.v_labels(spark, d).select(
        "row_id", txt.split_labels(F.col("types")).alias("a"), txt.split_labels(F.replace("types", F.lit("STANDARD"), F.lit("SMALL"))).alias("b"))
    both, either = F.array_intersect("a", "b"), F.array_union("a", "b")
    return rows.select("row_id", F.array_join(F.array_sort(both), ";").alias("shared"), num6(num.share(F.size(both), F.size(either))).alias("jaccard"))


@query("c18_utc_stamp", "SELECT count(*) AS rows, true AS is_utc_stamp FROM orders")
def c18(spark, d):
    rows = src.table(spark, d, "orders").count()
    stamp = F.col("created_at_utc")
    return src.manifest(spark, {"rows": rows}).select(F.col("rows").cast("bigint").alias("rows"), stamp.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$").alias("is_utc_stamp"))


@query("c19_safe_casts", f"WITH {fx.V_EXPERIENCE} SELECT row_id, TRY_CAST(years_text AS INT) AS as_int, row_id::VARCHAR AS as_text, row_id::DOUBLE AS as_double FROM v_experience")
def c19(spark, d):
    return fx.v_experience(spark, d).select(
        "row_id", F.col("years_text").try_cast("int").alias("as_int"), F.col("row_id").cast("string").alias("as_text"), F.col("row_id").cast("double").alias("as_double"))


@query("c20_lookup_label", "SELECT c_custkey, n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey")
def c20(spark, d):
    names = src.table(spark, d, "nation")
    return src.table(spark, d, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("label"))


# --- D. Equi-joins --------------------------------------------------------------------------------


@query("d1_join_on_k", """SELECT k, n, total FROM (SELECT l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1)
  JOIN (SELECT l_linenumber AS k, sum(l_quantity) AS total FROM lineitem GROUP BY 1) USING (k)""")
def d1(spark, d):
    lines = src.table(spark, d, "lineitem").withColumnRenamed("l_linenumber", "k")
    return lines.groupBy("k").agg(F.count("*").alias("n")).join(lines.groupBy("k").agg(F.sum("l_quantity").alias("total")), "k")


@query("d2_attach_labels", f"""WITH {fx.V_RESPONDENT} SELECT r.row_id, r.country, label::INT AS cluster FROM v_respondent r
  JOIN embeddings ON vec_id = r.row_id""")
def d2(spark, d):
    return fx.v_respondent(spark, d).join(fx.v_vec(spark, d), "row_id").select("row_id", "country", F.col("cluster").cast("int").alias("cluster"))


@query("d3_sample_restriction", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT doc_id FROM documents)")
def d3(spark, d):
    docs = src.table(spark, d, "documents").select(F.col("doc_id").alias("o_orderkey"))
    return src.table(spark, d, "orders").join(docs, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("d4_rare_membership", f"""WITH {fx.V_RESPONDENT} SELECT row_id FROM v_respondent WHERE country NOT IN (
  SELECT country FROM v_respondent GROUP BY 1 HAVING count(*) < 60)""")
def d4(spark, d):
    rows = fx.v_respondent(spark, d)
    return rows.join(clean.rare_values(rows, "country", 60), "country", "left_anti").select("row_id")


@query("d5_dimension_lookup", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def d5(spark, d):
    return src.table(spark, d, "nation").join(src.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", "r_name")


@query("d12_column_pairs", f"""WITH {fx.V_RESPONDENT} SELECT 'country' AS column_a, 'segment' AS column_b, country AS a, segment AS b, count(*) AS n FROM v_respondent GROUP BY 3, 4
  UNION ALL SELECT 'country', 'region', country, region::VARCHAR, count(*) FROM v_respondent GROUP BY 3, 4
  UNION ALL SELECT 'segment', 'region', segment, region::VARCHAR, count(*) FROM v_respondent GROUP BY 3, 4""")
def d12(spark, d):
    return prof.paired_categories(fx.v_respondent(spark, d), ["country", "segment", "region"])


# --- E. Aggregations ------------------------------------------------------------------------------

PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS missing_count, "
    f"{r(f'100 * (count(*) - count({c})) / count(*)', 3)} AS missing_pct, count(DISTINCT {c}) AS unique_non_null FROM v_labels"
    for c, t in (("row_id", "bigint"), ("types", "string"), ("brands", "string")))


@query("e1_column_profile", f"WITH {fx.V_LABELS} {PROFILE_SQL}")
def e1(spark, d):
    return prof.column_profile(fx.v_labels(spark, d).select("row_id", "types", "brands"))


@query("e2_missingness", f"""WITH {fx.V_LABELS} SELECT * FROM (SELECT 'types' AS "column", count(*) - count(types) AS missing_count FROM v_labels UNION ALL
  SELECT 'brands', count(*) - count(brands) FROM v_labels UNION ALL SELECT 'row_id', count(*) - count(row_id) FROM v_labels)""")
def e2(spark, d):
    profile = prof.column_profile(fx.v_labels(spark, d).select("row_id", "types", "brands"), approximate=True)
    return profile.select("column", "missing_count").orderBy(F.desc("missing_count"), "column")


SPEC = {
    "key": "row_id", "order": "row_id", "check": "Check", "country": "Country", "experience": ["YearsCode", "YearsCodePro"], "work": "WorkExp",
    "size": "OrgSize", "sizes": txt.ORGANISATION_SIZES, "technology": fx.SURVEY_TECHNOLOGY,
    "fill": ["Employment", "RemoteWork", "DevType", "EdLevel", "AISelect"], "target": "ConvertedCompYearly", "min_count": 200,
}

_SURVEY_CLEAN = f"""WITH {fx.V_SURVEY}, s0 AS (SELECT * REPLACE (trim("Check") AS "Check", trim(YearsCode) AS YearsCode, trim(YearsCodePro) AS YearsCodePro) FROM v_survey),
  s1 AS (SELECT * FROM s0 WHERE "Check" IS NULL OR lower("Check") = 'apples'),
  s2 AS (SELECT *, coalesce(Country, 'Missing') AS c0, CASE WHEN YearsCode = 'Less than 1 year' THEN 0.5::DOUBLE WHEN YearsCode = 'More than 50 years' THEN 51 ELSE TRY_CAST(YearsCode AS DOUBLE) END AS y1,
    CASE WHEN YearsCodePro = 'Less than 1 year' THEN 0.5::DOUBLE WHEN YearsCodePro = 'More than 50 years' THEN 51 ELSE TRY_CAST(YearsCodePro AS DOUBLE) END AS y2,
    CASE WHEN WorkExp::DOUBLE BETWEEN 0 AND 50 THEN WorkExp::DOUBLE END AS y3 FROM s1),
  s3 AS (SELECT *, CASE WHEN c0 <> 'Missing' AND count(*) OVER (PARTITION BY c0) < 200 THEN 'Other' ELSE c0 END AS c1 FROM s2)"""


def _said(decision):
    return ", ".join(f"'{text}' AS {name}" for name, text in zip(("issue", "action", "rationale"), clean.DECISIONS[decision]))


@query("e3_decision_log", f"""{_SURVEY_CLEAN}
  SELECT * FROM (
  SELECT c AS "column", {_said('text')}, n AS affected_rows FROM (
    SELECT 'Check' AS c, count(*) FILTER ("Check" <> trim("Check")) AS n FROM v_survey UNION ALL SELECT 'YearsCode', count(*) FILTER (YearsCode <> trim(YearsCode)) FROM v_survey
    UNION ALL SELECT 'YearsCodePro', count(*) FILTER (YearsCodePro <> trim(YearsCodePro)) FROM v_survey
    UNION ALL SELECT unnest(['WorkExp', 'OrgSize', 'Employment', 'RemoteWork', 'Country', 'DevType', 'EdLevel', 'AISelect', 'LanguageHaveWorkedWith', 'DatabaseHaveWorkedWith', 'ToolsTechHaveWorkedWith']), 0)
  UNION ALL SELECT 'row_id', {_said('repeat')}, 0
  UNION ALL SELECT 'Check', {_said('check')}, count(*) FROM s0 WHERE lower("Check") <> 'apples'
  UNION ALL SELECT 'Country', {_said('rare')}, count(*) FROM s3 WHERE c1 <> c0
  UNION ALL SELECT 'YearsCode', {_said('number')}, count(*) FROM s3 WHERE YearsCode IS NOT NULL AND y1 IS NULL
  UNION ALL SELECT 'YearsCodePro', {_said('number')}, count(*) FROM s3 WHERE YearsCodePro IS NOT NULL AND y2 IS NULL
  UNION ALL SELECT 'YearsCodeNumeric', {_said('gap')}, count(*) FROM s3 WHERE y1 IS NULL
  UNION ALL SELECT 'YearsCodeProNumeric', {_said('gap')}, count(*) FROM s3 WHERE y2 IS NULL
  UNION ALL SELECT 'WorkExpNumeric', {_said('gap')}, count(*) FROM s3 WHERE y3 IS NULL
  UNION ALL SELECT 'OrgSize', {_said('range')}, count(*) FROM s3 WHERE OrgSize IS NULL
  UNION ALL SELECT 'technology', {_said('silent')}, count(*) FROM s3 WHERE LanguageHaveWorkedWith IS NULL AND DatabaseHaveWorkedWith IS NULL AND ToolsTechHaveWorkedWith IS NULL
  UNION ALL SELECT 'ConvertedCompYearly', {_said('target')}, count(*) FROM s3 WHERE ConvertedCompYearly <= 0 AND LanguageHaveWorkedWith IS NOT NULL)""")
def e3(spark, d):
    return clean.clean_cohort(_raw_layer(spark, d), SPEC)[1]


def _raw_layer(spark, d):
    """The survey view written once, as an ingest stage leaves it."""
    return src.write_layer(fx.v_survey(spark, d), stage_path(spark, "raw"))


@query("e3_clean_cohort", f"""{_SURVEY_CLEAN}, m AS (SELECT c1, median(y1) AS m1, median(y2) AS m2, median(y3) AS m3 FROM s3 GROUP BY 1),
  g AS (SELECT median(y1) AS g1, median(y2) AS g2, median(y3) AS g3 FROM s3),
  s4 AS (SELECT s3.*, coalesce(y1, m1, g1) AS i1, coalesce(y2, m2, g2) AS i2, coalesce(y3, m3, g3) AS i3, list_median([x for x in [y1, y2, y3] if x is not null]) AS e0,
    coalesce(greatest(y1, y2, y3) - least(y1, y2, y3), 0) AS spread,
    CASE OrgSize WHEN '2 to 9 employees' THEN 5.5::DOUBLE WHEN '10 to 19 employees' THEN 14.5::DOUBLE WHEN '100 to 499 employees' THEN 299.5::DOUBLE END AS o0 FROM s3 JOIN m USING (c1) CROSS JOIN g),
  s5 AS (SELECT *, coalesce(e0, (SELECT median(e0) FROM s4)) AS e1, coalesce(o0, (SELECT median(o0) FROM s4)) AS o1 FROM s4)
  SELECT row_id, c1 AS Country, {r('i1')} AS years, {r('i2')} AS years_pro, {r('i3')} AS work, {r('e1')} AS consensus, {r('spread')} AS spread,
    {r('least(greatest(i2 / greatest(i1, 0.5), 0), 2)')} AS ratio, {r('ln(1 + o1)')} AS org_log, (OrgSize IS NULL)::INT AS org_missing,
    len(string_split(LanguageHaveWorkedWith, ';'))::BIGINT AS languages, coalesce(RemoteWork, 'Missing') AS RemoteWork,
    CASE WHEN ConvertedCompYearly > 0 THEN ConvertedCompYearly END AS target
  FROM s5 WHERE LanguageHaveWorkedWith IS NOT NULL OR DatabaseHaveWorkedWith IS NOT NULL OR ToolsTechHaveWorkedWith IS NOT NULL""")
def e3c(spark, d):
    cohort = clean.clean_cohort(_raw_layer(spark, d), SPEC)[0]
    return cohort.select(
        "row_id", "Country", num6(F.col("YearsCodeNumericImputed")).alias("years"), num6(F.col("YearsCodeProNumericImputed")).alias("years_pro"),
        num6(F.col("WorkExpNumericImputed")).alias("work"), num6(F.col("ExperienceConsensus")).alias("consensus"), num6(F.col("ExperienceSpread")).alias("spread"),
        num6(F.col("ProfessionalExperienceRatio")).alias("ratio"), num6(F.col("OrgSizeLog")).alias("org_log"), F.col("OrgSizeMissing").cast("int").alias("org_missing"),
        F.col("LanguageBreadth").cast("bigint").alias("languages"), "RemoteWork", F.col("ConvertedCompYearly").alias("target"))


@query("e4_group_rare", f"""WITH {fx.V_RESPONDENT} SELECT row_id, CASE WHEN count(*) OVER (PARTITION BY country) < 60 THEN 'Other' ELSE country END AS country
  FROM v_respondent""")
def e4(spark, d):
    return clean.group_rare(fx.v_respondent(spark, d), "country", 60).select("row_id", "country")


@query("e5_impute_group_median", f"""WITH {fx.V_YEARS}, g AS (SELECT brand, median(years) AS m FROM v_years GROUP BY 1)
  SELECT row_id, (years IS NULL)::INT AS missing, {r('coalesce(years, m, (SELECT median(years) FROM v_years))')} AS imputed FROM v_years JOIN g USING (brand)""")
def e5(spark, d):
    parsed = fx.v_experience(spark, d).withColumn("years", txt.parse_experience(F.col("years_text")))
    filled = clean.impute_group_median(parsed, ["years"], "brand")
    return filled.select("row_id", F.col("yearsMissing").cast("int").alias("missing"), num6(F.col("yearsImputed")).alias("imputed"))


@query("e6_impute_median", f"""WITH {fx.V_ORDINAL}, t AS (SELECT row_id, priority, {fx.PRIORITY_CASE} AS points FROM v_ordinal), u AS (
  SELECT row_id, priority, coalesce(points, (SELECT median(points) FROM t)) AS points FROM t)
  SELECT row_id, (priority IS NULL)::INT AS missing, {r('points')} AS points, {r('ln(1 + points)')} AS log_points FROM u""")
def e6(spark, d):
    coded = clean.map_ordinal(fx.v_ordinal(spark, d), "priority", fx.PRIORITY_POINTS, "Size")
    return coded.select("row_id", F.col("SizeMissing").cast("int").alias("missing"), num6(F.col("SizeNumeric")).alias("points"), num6(F.col("SizeLog")).alias("log_points"))


@query("e7_label_prevalence", f"""WITH {fx.V_LABELS}, x AS (SELECT 'types' AS domain, unnest({LABEL_LIST.format(c='types')}) AS label FROM v_labels UNION ALL
  SELECT 'brands', unnest({LABEL_LIST.format(c='brands')}) FROM v_labels)
  SELECT domain, label, count(*) AS respondents, {r('100 * count(*) / (SELECT count(*) FROM v_labels)')} AS pct_of_cohort FROM x GROUP BY 1, 2""")
def e7(spark, d):
    labels = fx.v_labels(spark, d)
    counts = prof.label_prevalence(labels, ["types", "brands"])
    shares = prof.with_share_of(counts, "respondents", prof.row_counts(labels), [], "pct_of_cohort")
    return shares.withColumn("pct_of_cohort", num6(F.col("pct_of_cohort"))).orderBy("domain", F.desc("respondents"), "label")


E8_PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
E8_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, {r(f'min({c})')} AS min, {r(f'max({c})')} AS max, "
    + ", ".join(f"{r(f'quantile_cont({c}, {p})')} AS p{round(100 * p):02d}" for p in E8_PERCENTILES) + " FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount"))


@query("e8_numeric_summary", E8_SQL)
def e8(spark, d):
    summary = prof.numeric_summary(src.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], E8_PERCENTILES)
    rounded = {c: num6(F.col(c)) for c in summary.columns if c not in ("column", "count")} | {c: num6(F.col(c), 4) for c in ("mean", "std")}
    return summary.withColumns(rounded)


@query("e9_category_distribution", f"""WITH {fx.V_SURVEY}, x AS (SELECT 'RemoteWork' AS "column", coalesce(RemoteWork, 'Missing') AS category FROM v_survey UNION ALL
  SELECT 'Country', coalesce(Country, 'Missing') FROM v_survey UNION ALL SELECT 'AISelect', AISelect FROM v_survey)
  SELECT "column", category, count(*) AS count, {r('100 * count(*) / (SELECT count(*) FROM v_survey)')} AS pct FROM x GROUP BY 1, 2""")
def e9(spark, d):
    rows = prof.category_distribution(fx.v_survey(spark, d), ["RemoteWork", "Country", "AISelect"])
    return rows.withColumn("pct", num6(F.col("pct")))


_CRAMER = """SELECT '{x}' AS column_a, '{y}' AS column_b, CASE WHEN least(r, c) >= 2 AND least(cc, rc) - 1 > 0 THEN sqrt(greatest(0, phi2 - (c - 1) * (r - 1) / greatest(n - 1, 1)) / (least(cc, rc) - 1)) ELSE 0 END AS v FROM (
  SELECT n, r, c, phi2, r - (r - 1) * (r - 1) / greatest(n - 1, 1)::DOUBLE AS rc, c - (c - 1) * (c - 1) / greatest(n - 1, 1)::DOUBLE AS cc FROM (
    SELECT sum(o) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS c, sum(o * o / (ra * cb)::DOUBLE) - 1 AS phi2 FROM (
      SELECT a, b, o, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb FROM (
        SELECT {x}::VARCHAR AS a, {y}::VARCHAR AS b, count(*) AS o FROM v_respondent GROUP BY 1, 2))))"""


@query("e10_cramers_v", f"WITH {fx.V_RESPONDENT} SELECT column_a, column_b, {r('v', 5)} AS cramers_v FROM (" + " UNION ALL ".join(
    _CRAMER.format(x=x, y=y) for x, y in (("country", "segment"), ("country", "region"), ("segment", "region"))) + ")")
def e10(spark, d):
    return prof.cramers_v(fx.v_respondent(spark, d), ["country", "segment", "region"]).withColumn("cramers_v", num6(F.col("cramers_v"), 5))


_RANKED = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}_r"


@query("e11_spearman", f"""WITH t AS (SELECT {', '.join(_RANKED.format(c=c) for c in ('l_quantity', 'l_discount', 'l_extendedprice'))} FROM lineitem)
  SELECT 'l_quantity' AS column_a, 'l_discount' AS column_b, {r('corr(l_quantity_r, l_discount_r)', 5)} AS spearman FROM t UNION ALL
  SELECT 'l_quantity', 'l_extendedprice', {r('corr(l_quantity_r, l_extendedprice_r)', 5)} FROM t UNION ALL
  SELECT 'l_discount', 'l_extendedprice', {r('corr(l_discount_r, l_extendedprice_r)', 5)} FROM t""")
def e11(spark, d):
    return prof.spearman(src.table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"]).withColumn("spearman", num6(F.col("spearman"), 5))


@query("e12_repeat_summary", f"""SELECT event_type AS representation, {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std, {r('min(value)')} AS min, {r('max(value)')} AS max
  FROM events GROUP BY 1""")
def e12(spark, d):
    from segmentry.operators.tendency import repeat_summary

    summary = repeat_summary(src.table(spark, d, "events").withColumnRenamed("event_type", "representation"), "value")
    return summary.withColumns({c: num6(F.col(c)) for c in ("mean", "std", "min", "max")})


@query("e13_cluster_profile", f"""WITH {fx.V_RESPONDENT}, p AS (SELECT region AS cluster, count(*) AS respondents, {r('100 * count(*) / (SELECT count(*) FROM v_respondent)')} AS share_pct,
  {r('median(balance)')} AS balance_median, {r('median(row_id)')} AS row_id_median FROM v_respondent GROUP BY 1),
  m AS (SELECT region AS cluster, segment, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, segment) AS i FROM v_respondent GROUP BY 1, 2)
  SELECT p.*, segment AS segment_mode, CASE WHEN row_number() OVER (ORDER BY balance_median DESC, cluster DESC) = 1 THEN 'Broad-stack polyglots'
    WHEN row_number() OVER (ORDER BY balance_median, cluster) = 1 THEN 'Focused-stack practitioners' END AS profile_name FROM p JOIN m USING (cluster) WHERE i = 1""")
def e13(spark, d):
    rows = fx.v_respondent(spark, d).withColumnRenamed("region", "cluster")
    profile = prof.cluster_profile(rows, "cluster", ["balance", "row_id"], ["segment"], "balance", PROFILE_NAMES)
    return profile.withColumns({c: num6(F.col(c)) for c in ("share_pct", "balance_median", "row_id_median")})


# Names of the clusters with the fewest and the most labels per row.
PROFILE_NAMES = ("Focused-stack practitioners", "Broad-stack polyglots")


@query("e14_composition", f"""WITH {fx.V_RESPONDENT}, c AS (SELECT 'country' AS attribute, country AS category, region AS cluster FROM v_respondent UNION ALL SELECT 'segment', segment, region FROM v_respondent),
  g AS (SELECT * FROM (SELECT DISTINCT attribute, category FROM c) CROSS JOIN (SELECT DISTINCT cluster FROM c)), n AS (SELECT attribute, category, cluster, count(*) AS k FROM c GROUP BY 1, 2, 3),
  s AS (SELECT region AS cluster, count(*) AS total FROM v_respondent GROUP BY 1)
  SELECT attribute, cluster, category, {r('coalesce(k, 0) / total')} AS share FROM g LEFT JOIN n USING (attribute, category, cluster) JOIN s USING (cluster)""")
def e14(spark, d):
    rows = fx.v_respondent(spark, d).withColumnRenamed("region", "cluster")
    return prof.composition(rows, "cluster", ["country", "segment"]).withColumn("share", num6(F.col("share")))


@query("e15_cluster_sizes", "SELECT label::INT AS cluster, count(*) AS rows FROM embeddings GROUP BY 1")
def e15(spark, d):
    return prof.row_counts(fx.v_vec(spark, d).withColumn("cluster", F.col("cluster").cast("int")), ["cluster"])


@query("e16_balance", f"""WITH {fx.V_BUNDLE}, s AS (SELECT candidate, cluster, count(*) AS n FROM v_bundle GROUP BY 1, 2)
  SELECT candidate, min(n) AS minimum_cluster_size, {r('min(n) / sum(n)')} AS minimum_cluster_fraction, {r('max(n) / sum(n)')} AS largest_cluster_fraction, count(*) AS clusters_found FROM s GROUP BY 1""")
def e16(spark, d):
    rows = prof.balance(fx.v_bundle(spark, d), ["candidate"], ignore_noise=True)
    return rows.withColumns({c: num6(F.col(c)) for c in ("minimum_cluster_fraction", "largest_cluster_fraction")})


@query("e17_centroids", f"WITH {fx.V_LONG} SELECT cluster::INT AS cluster, dim::INT AS dim, {r('avg(x)')} AS centre FROM v_long GROUP BY 1, 2")
def e17(spark, d):
    from segmentry.operators.moments import centroids_long

    rows = centroids_long(fx.v_vec(spark, d))
    return rows.select(F.col("cluster").cast("int").alias("cluster"), F.col("dim").cast("int").alias("dim"), num6(F.col("centre")).alias("centre"))


@query("e18_bounding_box", f"""WITH {fx.V_LONG} SELECT dim::INT AS dim, {r('min(x)')} AS low, {r('CASE WHEN max(x) <= min(x) THEN min(x) + 1e-12 ELSE max(x) END')} AS high
  FROM v_long GROUP BY 1""")
def e18(spark, d):
    from segmentry.operators.moments import bounding_box

    return bounding_box(fx.v_vec(spark, d)).select(F.col("dim").cast("int").alias("dim"), num6(F.col("low")).alias("low"), num6(F.col("high")).alias("high"))


@query("e19_mae_accuracy", f"""SELECT {r('avg(abs(l_quantity - 25))')} AS mae, {r("avg((l_returnflag = 'N')::INT)")} AS accuracy FROM lineitem""")
def e19(spark, d):
    from segmentry.operators.supervised import accuracy, mean_absolute_error

    lines = src.table(spark, d, "lineitem")
    return lines.agg(num6(mean_absolute_error(F.col("l_quantity"), F.lit(25.0))).alias("mae"), num6(accuracy(F.col("l_returnflag"), F.lit("N"))).alias("accuracy"))


@query("e20_arg_extremes", "SELECT max_by(c_custkey, c_acctbal) AS richest, min_by(c_custkey, c_acctbal) AS poorest FROM customer")
def e20(spark, d):
    return src.table(spark, d, "customer").agg(F.max_by("c_custkey", "c_acctbal").alias("richest"), F.min_by("c_custkey", "c_acctbal").alias("poorest"))


@query("e22_label_prevalence_by_cluster", f"""WITH {fx.V_LABELS}, o AS (SELECT row_id, types, o_orderpriority AS cluster FROM v_labels JOIN orders ON o_orderkey = row_id),
  s AS (SELECT cluster, count(*) AS n FROM o GROUP BY 1), x AS (SELECT cluster, unnest({LABEL_LIST.format(c='types')}) AS label FROM o)
  SELECT cluster, label, {r('count(*) / any_value(n)')} AS prevalence FROM x JOIN s USING (cluster) GROUP BY 1, 2""")
def e22(spark, d):
    rows = _labelled_orders(spark, d)
    counts = prof.label_prevalence(rows, ["types"], ["cluster"])
    shares = prof.with_share_of(counts, "respondents", prof.row_counts(rows, ["cluster"]), ["cluster"], "pct")
    return shares.select("cluster", "label", num6(F.col("pct") / 100).alias("prevalence"))


def _labelled_orders(spark, d):
    orders = src.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("cluster"))
    return fx.v_labels(spark, d).join(orders, "row_id")


@query("e23_histogram", f"""WITH t AS (SELECT value, (SELECT min(value) FROM events) AS lo, (SELECT max(value) FROM events) AS hi FROM events)
  SELECT least(floor((value - lo) * 35 / (hi - lo)), 34)::INT AS bin, count(*) AS rows, {r('min(lo)')} AS low, {r('min((hi - lo) / 35)')} AS width FROM t GROUP BY 1""")
def e23(spark, d):
    return prof.histogram(src.table(spark, d, "events"), "value", 35).withColumns({c: num6(F.col(c)) for c in ("low", "width")})


@query("e24_density_grid", f"""WITH t AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM t)
  SELECT least(floor((x - lx) * 20 / (hx - lx)), 19)::INT AS x_bin, least(floor((y - ly) * 20 / (hy - ly)), 19)::INT AS y_bin, count(*) AS rows, {r('log10(count(*))')} AS log10_rows FROM t, b GROUP BY 1, 2""")
def e24(spark, d):
    points = fx.v_vec(spark, d).select(F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    return prof.density_grid(points, "x", "y", 20).withColumn("log10_rows", num6(F.col("log10_rows")))


@query("e25_quantiles", f"SELECT {', '.join(f'{r(f'quantile_cont(l_extendedprice, {p})')} AS q{round(100 * p)}' for p in (0.85, 0.9, 0.95))} FROM lineitem")
def e25(spark, d):
    found = ordering.exact_quantiles(src.table(spark, d, "lineitem"), "l_extendedprice", [0.85, 0.9, 0.95])
    return found.select(*[num6(F.col("quantiles")[i]).alias(n) for i, n in enumerate(("q85", "q90", "q95"))])


@query("e26_percentile_interval", f"SELECT {r('quantile_cont(value, 0.025)')} AS ci_lower, {r('quantile_cont(value, 0.975)')} AS ci_upper FROM events WHERE isfinite(value)")
def e26(spark, d):
    return prof.percentile_interval(src.table(spark, d, "events"), "value").select(num6(F.col("ci_lower")).alias("ci_lower"), num6(F.col("ci_upper")).alias("ci_upper"))


@query("e27_distinct_count", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def e27(spark, d):
    profile = prof.column_profile(src.table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])
    n = {c: F.max(F.when(F.col("column") == c, F.col("unique_non_null"))) for c in ("l_partkey", "l_suppkey")}
    return profile.agg(n["l_partkey"].alias("parts"), n["l_suppkey"].alias("suppliers"))


@query("e28_family_best", f"""WITH {SCORES_SQL} SELECT family, algorithm, {r('silhouette')} AS silhouette FROM (
  SELECT *, row_number() OVER (PARTITION BY family ORDER BY silhouette DESC, algorithm) AS i FROM scores WHERE minimum_cluster_fraction >= 0.02 AND silhouette IS NOT NULL) WHERE i = 1""")
def e28(spark, d):
    from segmentry.operators.selection import family_best

    return family_best(scores(spark, d), 0.02).select("family", "algorithm", num6(F.col("silhouette")).alias("silhouette"))


# --- F. Windows -----------------------------------------------------------------------------------

GAPS_SQL = """g AS (SELECT l_linenumber AS k, avg(l_extendedprice) AS gap, stddev_samp(l_extendedprice) / 100 AS gap_standard_error FROM lineitem GROUP BY 1)"""


def gaps(spark, d):
    lines = src.table(spark, d, "lineitem")
    return lines.groupBy(F.col("l_linenumber").alias("k")).agg(F.avg("l_extendedprice").alias("gap"), (F.stddev_samp("l_extendedprice") / 100).alias("gap_standard_error"))


@query("f1_lead_one_se", f"""WITH {GAPS_SQL} SELECT k, coalesce(gap >= lead(gap) OVER (ORDER BY k) - lead(gap_standard_error) OVER (ORDER BY k), false) AS one_se_rule_satisfied FROM g""")
def f1(spark, d):
    return ordering.lead_one_se(gaps(spark, d)).select("k", "one_se_rule_satisfied")


@query("f2_average_rank", "SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS rank FROM part")
def f2(spark, d):
    return ordering.average_rank(src.table(spark, d, "part"), "p_size", ascending=False).select("p_partkey", "rank")


@query("f3_cumulative", f"""WITH {fx.V_LONG}, t AS (SELECT dim, var_samp(x) AS s FROM v_long GROUP BY 1)
  SELECT dim::INT AS component, {r('sum(s) OVER (ORDER BY dim)')} AS total FROM t""")
def f3(spark, d):
    from segmentry.operators.moments import dimension_moments

    spread = dimension_moments(fx.v_vec(spark, d)).select(F.col("dim").cast("int").alias("component"), F.col("variance"))
    return ordering.cumulative(spread, "component", "variance", "total").select("component", num6(F.col("total")).alias("total"))


@query("f4_top_n_per_group", """SELECT o_custkey, o_orderkey, i AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) WHERE i <= 3""")
def f4(spark, d):
    return ordering.top_per_group(src.table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("f5_dedupe_first", f"WITH {fx.V_DUP} SELECT row_id, price, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY ordinal) AS i FROM v_dup) WHERE i = 1")
def f5(spark, d):
    return clean.dedupe_first(fx.v_dup(spark, d), "row_id", "ordinal")


@query("f6_group_transform", f"WITH {fx.V_RESPONDENT} SELECT row_id, {r('median(balance) OVER (PARTITION BY country)')} AS middle FROM v_respondent")
def f6(spark, d):
    rows = fx.v_respondent(spark, d)
    return rows.join(ordering.medians(rows, ["balance"], ["country"]), "country").select("row_id", num6(F.col("balance_median")).alias("middle"))


@query("f7_rank_curve", f"SELECT row_number() OVER (ORDER BY p_retailprice) AS rank, {r('p_retailprice', 4)} AS price FROM part")
def f7(spark, d):
    prices = src.table(spark, d, "part").select(F.col("p_retailprice").alias("price"))
    counted = ordering.running_counts(ordering.value_counts(prices, "price"), "price", ["n"])
    ranks = F.sequence(F.col("n_before") + 1, F.col("n_before") + F.col("n"))
    return counted.select(F.explode(ranks).alias("rank"), num6(F.col("price"), 4).alias("price"))


@query("f8_top_labels_per_cluster", f"""WITH {fx.V_LABELS}, o AS (SELECT types, o_orderpriority AS cluster FROM v_labels JOIN orders ON o_orderkey = row_id), s AS (SELECT cluster, count(*) AS n FROM o GROUP BY 1),
  x AS (SELECT cluster, label, count(*) AS respondents FROM (SELECT cluster, unnest({LABEL_LIST.format(c='types')}) AS label FROM o) GROUP BY 1, 2),
  y AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY respondents DESC, label) AS rank FROM x)
  SELECT cluster, 'types' AS domain, rank, label, respondents, {r('100 * respondents / n')} AS pct_cluster FROM y JOIN s USING (cluster) WHERE rank <= 8""")
def f8(spark, d):
    from segmentry.operators.explain import top_labels_per_cluster

    return top_labels_per_cluster(_labelled_orders(spark, d), ["types"]).withColumn("pct_cluster", num6(F.col("pct_cluster")))


@query("f9_ecdf_difference", f"""WITH t AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) <= (SELECT count(*) // 2 FROM events) AS first FROM events),
  c AS (SELECT value, sum(first::INT) AS a, sum((NOT first)::INT) AS b FROM t GROUP BY 1), s AS (SELECT sum(a) OVER (ORDER BY value) AS ca, sum(b) OVER (ORDER BY value) AS cb, (SELECT sum(a) FROM c) AS na, (SELECT sum(b) FROM c) AS nb FROM c)
  SELECT {r('max(abs(ca / na::DOUBLE - cb / nb::DOUBLE))')} AS ks_statistic FROM s""")
def f9(spark, d):
    from segmentry.operators.monitoring import ks_statistic

    halves = cut_lineage(ordering.split_halves(_event_order(spark, d), "place"))
    return ks_statistic(halves, "value", F.col("half") == 1, []).select(num6(F.col("ks_statistic")).alias("ks_statistic"))


def _event_order(spark, d):
    """Events with a unique order column: the time in microseconds, which no two events share."""
    return src.table(spark, d, "events").select("event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("place"))


KNEE_SQL = """c AS (SELECT k, y, (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ())::DOUBLE AS xs, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ())::DOUBLE AS ys
  FROM (SELECT l_linenumber AS k, count(*) AS y FROM lineitem GROUP BY 1))"""


def knee_sql(curve: str) -> str:
    """CTEs after ``curve`` (k, xs, ys): ``kp`` (points with peaks and thresholds) and ``kk`` (the knee, one row)."""
    return f"""kp AS (SELECT k, 1 - ys - xs AS d, coalesce(1 - ys - xs >= lag(1 - ys - xs) OVER (ORDER BY k) AND 1 - ys - xs >= lead(1 - ys - xs) OVER (ORDER BY k), false) AS peak,
    1 - ys - xs - (max(xs) OVER () - min(xs) OVER ()) / (count(*) OVER () - 1) AS t FROM {curve}),
  kn AS (SELECT *, min(CASE WHEN peak THEN k END) OVER (ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM kp),
  kk AS (SELECT min(p.k) AS knee FROM kn p WHERE p.peak AND EXISTS (SELECT 1 FROM kp q WHERE q.k > p.k AND q.d < p.t AND q.k < coalesce(p.next, q.k + 1)))"""


# A falling convex curve with a knee that the line counts only scale: few lines have a high number.
_FALLING = """y0 AS (SELECT l_linenumber AS k, count(*)::DOUBLE / l_linenumber AS y FROM lineitem GROUP BY 1),
  c2 AS (SELECT k, (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ())::DOUBLE AS xs, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS ys FROM y0)"""


@query("f10_knee", f"WITH {_FALLING}, {knee_sql('c2')} SELECT k, {r('d')} AS difference, peak AS is_peak, {r('t')} AS threshold, coalesce(k = knee, false) AS is_knee FROM kp, kk")
def f10k(spark, d):
    lines = src.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg((F.count("*") / F.col("k")).alias("inertia"))
    return ordering.knee(lines).select("k", num6(F.col("difference")).alias("difference"), "is_peak", num6(F.col("threshold")).alias("threshold"), "is_knee")


@query("b9_non_finite_places", "SELECT event_id AS row_id, place FROM (SELECT event_id, 0 AS place, isnan(value) OR isinf(value) AS bad FROM events UNION ALL SELECT event_id, 1, value > (SELECT avg(value) FROM events) FROM events) WHERE bad")
def b9p(spark, d):
    """Places of what is not finite, where values above the mean overflow to infinity."""
    events = src.table(spark, d, "events")
    mean = events.agg(F.avg("value").alias("m"), F.lit(0).alias("__all"))
    grown = events.withColumn("__all", F.lit(0)).join(F.broadcast(mean), "__all").select(F.col("event_id").alias("row_id"), F.array("value", F.when(F.col("value") > F.col("m"), F.lit(float("inf"))).otherwise(F.lit(0.0))).alias("v"))
    places = grown.select("row_id", F.posexplode("v").alias("place", "x")).filter(F.col("x").isNotNull())
    return places.filter(num.finite(F.col("x")).isNull()).select("row_id", "place")


@query("f10_difference_curve", f"WITH {KNEE_SQL} SELECT k, {r('1 - ys - xs')} AS difference FROM c")
def f10(spark, d):
    curve = src.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.count("*").alias("inertia"))
    return ordering.knee(curve).select("k", num6(F.col("difference")).alias("difference"))


@query("f11_split_halves", "SELECT vec_id AS row_id, CASE WHEN row_number() OVER (ORDER BY vec_id) <= (SELECT count(*) // 2 FROM embeddings) THEN 1 ELSE 2 END AS half FROM embeddings")
def f11(spark, d):
    return ordering.split_halves(fx.v_vec(spark, d).select("row_id"), "row_id")


# --- G. Sorts and top-k ---------------------------------------------------------------------------


@query("g1_best_row", f"WITH {SCORES_SQL} SELECT family, algorithm FROM scores ORDER BY silhouette DESC, noise_fraction, algorithm LIMIT 1")
def g1(spark, d):
    return ordering.best_row(scores(spark, d), F.desc("silhouette"), F.asc("noise_fraction"), F.asc("algorithm")).select("family", "algorithm")


@query("g2_top_fraction", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT (SELECT greatest(1, count(*) // 100) FROM orders)")
def g2(spark, d):
    return ordering.take_extreme(src.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 0.01)


@query("g3_lowest_fraction", """SELECT p_partkey, p_size FROM part ORDER BY p_size, p_partkey LIMIT (SELECT greatest(1, floor(count(*) * 0.05::DOUBLE)::BIGINT) FROM part)""")
def g3(spark, d):
    return ordering.take_extreme(src.table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "p_partkey", 0.05, largest=False)


@query("g4_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def g4(spark, d):
    return src.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("g5_top_terms", f"""WITH {fx.V_LONG}, c AS (SELECT cluster, dim, avg(x) AS loading FROM v_long GROUP BY 1, 2)
  SELECT cluster::INT AS component, dim::INT AS feature, i AS rank, {r('loading')} AS loading FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY loading DESC, dim) AS i FROM c) WHERE i <= 15""")
def g5(spark, d):
    from segmentry.operators.factorisation import top_terms
    from segmentry.operators.moments import centroids_long

    loadings = centroids_long(fx.v_vec(spark, d)).select(F.col("cluster").cast("int").alias("component"), F.col("dim").cast("int").alias("feature"), F.col("centre").alias("loading"))
    return top_terms(loadings, 15).withColumn("loading", num6(F.col("loading")))


@query("g6_category_order", "SELECT p_type AS category, row_number() OVER (ORDER BY p_type) - 1 AS place FROM (SELECT DISTINCT p_type FROM part)")
def g6(spark, d):
    from segmentry.operators.encoding import dictionary

    return dictionary(src.table(spark, d, "part"), {"type": F.array("p_type")}).select(F.col("item").alias("category"), F.col("feature_id").alias("place"))


@query("g7_alert_order", f"WITH {SCORES_SQL} SELECT family, algorithm FROM scores ORDER BY noise_fraction > 0.2 DESC, silhouette DESC, algorithm LIMIT 5")
def g7(spark, d):
    rows = scores(spark, d).withColumn("alert", F.col("noise_fraction") > 0.2)
    return rows.orderBy(F.desc("alert"), F.desc("silhouette"), "algorithm").limit(5).select("family", "algorithm")


# --- H. Set operations ----------------------------------------------------------------------------


@query("h1_union_scores", """SELECT 'nation' AS kind, n_name AS name, n_regionkey AS parent FROM nation UNION ALL SELECT 'region', r_name, NULL FROM region""")
def h1(spark, d):
    from segmentry.operators.selection import union_scores

    nations = src.table(spark, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    return union_scores(nations, src.table(spark, d, "region").select(F.lit("region").alias("kind"), F.col("r_name").alias("name")))


@query("h2_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def h2(spark, d):
    return src.table(spark, d, "customer").select("c_custkey").subtract(src.table(spark, d, "orders").select("o_custkey"))


@query("h3_intersect", "SELECT vec_id AS row_id FROM embeddings INTERSECT SELECT doc_id FROM documents")
def h3(spark, d):
    return src.table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id")).intersect(src.table(spark, d, "documents").select("doc_id"))


@query("h4_distinct_union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def h4(spark, d):
    return src.table(spark, d, "nation").select(F.col("n_name").alias("name")).union(src.table(spark, d, "region").select("r_name")).distinct()
