"""Derived views that give the driver tables the roles of a survey, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.sources.tables import table


def hex_int(purpose: str, key: Column, digits: int = 4) -> Column:
    text = F.md5(F.concat(F.lit(f"{purpose}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("int")


def hex_int_sql(purpose: str, key: str, digits: int = 4) -> str:
    return f"('0x' || substr(md5('{purpose}:' || ({key})::VARCHAR), 1, {digits}))::INT"


def uniform_sql(seed: int, purpose: str, *parts: str) -> str:
    joined = " || ':' || ".join([f"'{seed}:{purpose}'"] + [f"({p})::VARCHAR" for p in parts])
    return f"(('0x' || substr(md5({joined}), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"


def draw_sql(seed: int, purpose: str, *parts: str) -> str:
    joined = " || ':' || ".join([f"'{seed}:{purpose}'"] + [f"({p})::VARCHAR" for p in parts])
    return f"md5({joined})"


def v_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Delimited part types, brands and line states of every order; NULL for orders without lines."""
    lines = table(spark, folder, "lineitem").join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))

    def joined(c: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(c)), ";")

    per_order = lines.groupBy("l_orderkey").agg(
        joined(F.col("p_type")).alias("types"), joined(F.col("p_brand")).alias("brands"),
        joined(F.concat("l_returnflag", "l_linestatus")).alias("states"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"))
    return orders.join(per_order, F.col("row_id") == F.col("l_orderkey"), "left").select("row_id", "types", "brands", "states")


V_LABELS = """v_labels AS (
  SELECT o.o_orderkey AS row_id, t.types, t.brands, t.states FROM orders o LEFT JOIN (
    SELECT l_orderkey AS k, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS types,
           string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS brands,
           string_agg(DISTINCT l_returnflag || l_linestatus, ';' ORDER BY l_returnflag || l_linestatus) AS states
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) t ON t.k = o.o_orderkey)"""


def v_respondent(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return customers.select(
        F.col("c_custkey").alias("row_id"), F.col("n_name").alias("country"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"), F.col("n_regionkey").alias("region"))


V_RESPONDENT = """v_respondent AS (
  SELECT c_custkey AS row_id, n_name AS country, c_mktsegment AS segment, c_acctbal AS balance, n_regionkey AS region
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def v_experience(spark: SparkSession, folder: str) -> DataFrame:
    """Experience text of every part, with NULL, bad and boundary values and leading blanks."""
    chance = hex_int("null", F.col("p_partkey")) % 10
    text = (
        F.when(chance == 1, F.lit("bad")).when(F.col("p_size") == 1, F.lit("Less than 1 year"))
        .when(F.col("p_size") == 50, F.lit("More than 50 years")).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"))))
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("row_id"), F.when(chance != 0, text).alias("years_text"), F.col("p_brand").alias("brand"))


V_EXPERIENCE = f"""v_experience AS (
  SELECT p_partkey AS row_id, CASE {hex_int_sql('null', 'p_partkey')} % 10 WHEN 0 THEN NULL WHEN 1 THEN 'bad' ELSE
    CASE p_size WHEN 1 THEN 'Less than 1 year' WHEN 50 THEN 'More than 50 years' ELSE ' ' || p_size::VARCHAR END END AS years_text,
    p_brand AS brand FROM part)"""

V_YEARS = V_EXPERIENCE + """, v_years AS (
  SELECT row_id, brand, years_text, CASE trim(years_text) WHEN 'Less than 1 year' THEN 0.5::DOUBLE WHEN 'More than 50 years' THEN 51.0::DOUBLE
    ELSE TRY_CAST(trim(years_text) AS DOUBLE) END AS years FROM v_experience)"""


def v_ordinal(spark: SparkSession, folder: str) -> DataFrame:
    """Priority label of every order, NULL for finished low-priority orders."""
    hidden = (F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "F")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.when(~hidden, F.col("o_orderpriority")).alias("priority"))


V_ORDINAL = """v_ordinal AS (
  SELECT o_orderkey AS row_id, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS priority
  FROM orders)"""

# Midpoints for the priority labels; the fourth label stays unknown.
PRIORITY_POINTS = {"1-URGENT": 1.0, "2-HIGH": 5.5, "3-MEDIUM": 14.5, "5-LOW": 299.5}
PRIORITY_CASE = "CASE priority WHEN '1-URGENT' THEN 1.0::DOUBLE WHEN '2-HIGH' THEN 5.5::DOUBLE WHEN '3-MEDIUM' THEN 14.5::DOUBLE WHEN '5-LOW' THEN 299.5::DOUBLE END"


def v_dup(spark: SparkSession, folder: str) -> DataFrame:
    """Orders plus late copies of every tenth order."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("ordinal"))
    copies = orders.filter(F.col("row_id") % 10 == 0).select(
        "row_id", (F.col("price") + 1).alias("price"), (F.col("ordinal") + 10000000).alias("ordinal"))
    return orders.unionByName(copies)


V_DUP = """v_dup AS (
  SELECT o_orderkey AS row_id, o_totalprice AS price, o_orderkey AS ordinal FROM orders UNION ALL
  SELECT o_orderkey, o_totalprice + 1, o_orderkey + 10000000 FROM orders WHERE o_orderkey % 10 = 0)"""


def v_vec(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("cluster"))


V_VEC = "v_vec AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS v, label AS cluster FROM embeddings)"
V_LONG = V_VEC + """, v_long AS (
  SELECT row_id, cluster, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS dim FROM v_vec)"""


def v_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Three labelings of the embeddings in long form."""
    from segmentry.operators.order import unpivot

    wide = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("label"), (F.col("label") % 3).cast("int").alias("label_mod3"),
        (F.col("embedding")[0] > 0).cast("int").alias("first_sign"))
    long = unpivot(wide, ["label", "label_mod3", "first_sign"], ["row_id"])
    return long.select("row_id", F.col("column").alias("candidate"), F.col("value").alias("cluster"))


V_BUNDLE = """v_bundle AS (
  SELECT vec_id AS row_id, 'label' AS candidate, label::INT AS cluster FROM embeddings UNION ALL
  SELECT vec_id, 'label_mod3', (label % 3)::INT FROM embeddings UNION ALL
  SELECT vec_id, 'first_sign', (embedding[1] > 0)::INT FROM embeddings)"""


def v_target(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("target"),
        F.col("o_orderpriority").alias("priority"))


V_TARGET = """v_target AS (
  SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS target, o_orderpriority AS priority FROM orders)"""


def v_survey(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in the full survey role: key, check, experience texts, ranges, labels, target."""
    key = F.col("o_orderkey")

    def years(purpose: str) -> Column:
        n = hex_int(purpose, key) % 54
        return (F.when(n == 0, "Less than 1 year").when(n == 51, "More than 50 years").when(n == 52, "bad")
                .when(n < 53, F.concat(F.lit(" "), n.cast("string"))))

    work = hex_int("work", key) % 60
    check = hex_int("check", key, 1)
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    wide = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    size = (F.when(priority == "1-URGENT", "2 to 9 employees").when(priority == "2-HIGH", "10 to 19 employees")
            .when(priority == "3-MEDIUM", "100 to 499 employees").when(priority == "4-NOT SPECIFIED", "I do not know"))
    base = wide.select(
        key.alias("row_id"),
        F.when(check == 0, "Oranges").when(check > 1, "  Apples ").alias("Check"),
        years("yc").alias("YearsCode"), years("yp").alias("YearsCodePro"), F.when(work < 59, work.cast("string")).alias("WorkExp"),
        size.alias("OrgSize"),
        F.when(status == "F", "Employed, full-time;Student").when(status == "O", "Employed, full-time").otherwise("Independent;Student").alias("Employment"),
        F.when(hex_int("remote", key, 1) > 0, F.col("c_mktsegment")).alias("RemoteWork"),
        F.when(hex_int("country", key, 1) > 0, F.col("n_name")).alias("Country"),
        F.col("r_name").alias("DevType"), F.col("c_mktsegment").alias("EdLevel"), priority.alias("AISelect"),
        F.when(status == "P", None).when(priority == "5-LOW", 0.0).otherwise(F.col("o_totalprice")).alias("ConvertedCompYearly"))
    labels = v_labels(spark, folder).select(
        "row_id", F.col("types").alias("LanguageHaveWorkedWith"), F.col("brands").alias("DatabaseHaveWorkedWith"),
        F.col("states").alias("ToolsTechHaveWorkedWith"))
    return base.join(labels, "row_id")


def _years_sql(purpose: str, name: str) -> str:
    n = f"{hex_int_sql(purpose, 'o_orderkey')} % 54"
    return (f"CASE {n} WHEN 0 THEN 'Less than 1 year' WHEN 51 THEN 'More than 50 years' WHEN 52 THEN 'bad' WHEN 53 THEN NULL "
            f"ELSE ' ' || ({n})::VARCHAR END AS {name}")


V_SURVEY = V_LABELS + f""", v_survey AS (
  SELECT o_orderkey AS row_id,
    CASE {hex_int_sql('check', 'o_orderkey', 1)} WHEN 0 THEN 'Oranges' WHEN 1 THEN NULL ELSE '  Apples ' END AS "Check",
    {_years_sql('yc', 'YearsCode')}, {_years_sql('yp', 'YearsCodePro')},
    CASE WHEN {hex_int_sql('work', 'o_orderkey')} % 60 < 59 THEN ({hex_int_sql('work', 'o_orderkey')} % 60)::VARCHAR END AS WorkExp,
    CASE o_orderpriority WHEN '1-URGENT' THEN '2 to 9 employees' WHEN '2-HIGH' THEN '10 to 19 employees'
      WHEN '3-MEDIUM' THEN '100 to 499 employees' WHEN '4-NOT SPECIFIED' THEN 'I do not know' END AS OrgSize,
    CASE o_orderstatus WHEN 'F' THEN 'Employed, full-time;Student' WHEN 'O' THEN 'Employed, full-time' ELSE 'Independent;Student' END AS Employment,
    CASE WHEN {hex_int_sql('remote', 'o_orderkey', 1)} > 0 THEN c_mktsegment END AS RemoteWork,
    CASE WHEN {hex_int_sql('country', 'o_orderkey', 1)} > 0 THEN n_name END AS Country,
    r_name AS DevType, c_mktsegment AS EdLevel, o_orderpriority AS AISelect,
    CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority = '5-LOW' THEN 0.0::DOUBLE ELSE o_totalprice END AS ConvertedCompYearly,
    types AS LanguageHaveWorkedWith, brands AS DatabaseHaveWorkedWith, states AS ToolsTechHaveWorkedWith
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey JOIN v_labels ON v_labels.row_id = o_orderkey)"""

# Column roles of the survey view.
SURVEY_TECHNOLOGY = ["LanguageHaveWorkedWith", "DatabaseHaveWorkedWith", "ToolsTechHaveWorkedWith"]
