"""Cleaning and encoding queries."""

from pyspark.sql import functions as F

from catalog.inputs import table
from tessera.functions.rows import dict_text, key_value_text
from tessera.operators import checks, clean, presets


def p1_drop(spark, sf):
    return clean.drop_columns(table(spark, sf, "orders"), ["o_totalprice", "o_orderdate"], strict=True)


def _gappy(spark, sf):
    """Orders with gaps: two values of two columns count as missing."""
    return table(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"))


def p2_dropna(spark, sf):
    return clean.drop_incomplete(_gappy(spark, sf))


def p2_counts(spark, sf):
    return clean.completeness(_gappy(spark, sf))


def p3_sentinel(spark, sf):
    return clean.null_sentinel(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "F")


def p4_replace(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") > 150000).alias("large"), "o_orderstatus")
    return clean.replace_values(rows, {"F": 1, "O": 0})


def p5_fixed(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type")
    return clean.encode_fixed(rows, {"event_type": {"click": 0, "view": 1, "purchase": 5}})


def p6_learned(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    holes = rows.withColumn("p_type", F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")))
    return clean.encode_learned(holes, ["p_brand", "p_type", "p_name"])


def p6_learned_wide(spark, sf):
    """A dictionary with an entry per row goes through a join."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return clean.encode_learned(rows, ["c_name", "c_mktsegment"])


def o1_sorted_distinct(spark, sf):
    return clean.learn_codes(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"])


def p7_onehot(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return clean.one_hot(rows, ["c_mktsegment"])


def p8_coerce(spark, sf):
    user = F.col("user_id").cast("string")
    text = (F.when(F.col("event_type") == "error", F.lit("n/a"))
            .when(F.col("event_type") == "view", F.concat(F.lit(" "), user, F.lit(" ")))
            .when(F.col("event_type") == "click", F.concat(user, F.lit("e1")))
            .when(F.col("event_type") == "signup", F.concat(user, F.lit("d"))).otherwise(F.concat(user, F.lit(".5"))))
    return clean.coerce_numeric(table(spark, sf, "events").select("event_id", text.alias("amount"), "props"))


def p9_cast(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.col("l_suppkey").cast("string").alias("supplier"))
    return clean.strict_bigint(rows)


def p10_features(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), "c_nationkey", "c_mktsegment", "c_acctbal")
    return rows.select("idx", *clean.features_of(rows, "c_mktsegment"))


def p11_mask(spark, sf):
    rows = table(spark, sf, "customer").withColumnRenamed("c_custkey", "idx")
    return clean.mask_columns(rows, clean.mask_names(rows.columns))


def p13_first_seen(spark, sf):
    return clean.first_seen(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey")


def p14_text(spark, sf):
    rows = table(spark, sf, "lineitem")
    names = ["l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]
    return rows.select("l_orderkey", "l_linenumber", key_value_text(rows, names).alias("text"))


def p15_dict(spark, sf):
    rows = table(spark, sf, "customer")
    return rows.select(F.col("c_custkey").alias("idx"), dict_text(["c_nationkey", "c_mktsegment"]).alias("text"))


def p16_titanic(spark, sf):
    status = F.col("o_orderstatus")
    return presets.titanic(table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("idx"), F.col("o_orderkey").alias("PassengerId"),
        (status == "F").cast("int").cast("string").alias("Survived"),
        F.substring("o_orderpriority", 1, 1).alias("Pclass"), F.col("o_orderpriority").alias("Name"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("male")).when(F.col("o_custkey") % 5 > 0, F.lit("female"))
        .otherwise(F.lit("?")).alias("Sex"),
        F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey") % 80).cast("string").alias("Age"),
        F.lit(None).cast("string").alias("Cabin"),
        F.when(status == "F", F.lit("S")).when(status == "O", F.lit("C")).otherwise(F.lit("Q")).alias("Embarked")))


def p17_diabetes(spark, sf):
    return presets.diabetes(table(spark, sf, "part").select(
        F.col("p_partkey").alias("idx"), F.col("p_size").cast("string").alias("Glucose"),
        F.when(F.col("p_size") % 10 > 0, F.col("p_partkey").cast("string")).otherwise(F.lit("low")).alias("Insulin"),
        (F.col("p_size") > 25).cast("int").alias("Outcome")))


def p18_loan(spark, sf):
    return presets.loan(table(spark, sf, "customer").select(
        F.col("c_custkey").alias("idx"), F.col("c_custkey").alias("loan_id"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit(" Graduate")).otherwise(F.lit(" Not Graduate")).alias(" education"),
        F.when(F.col("c_nationkey") % 3 == 0, F.lit(" Yes")).when(F.col("c_nationkey") % 3 == 1, F.lit(" No"))
        .alias(" self_employed"),
        F.floor("c_acctbal").cast("string").alias(" income_annum"),
        F.when(F.col("c_acctbal") > 0, F.lit(" Approved")).otherwise(F.lit(" Rejected")).alias(" loan_status")))


def _mushrooms(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("idx"),
        F.when(F.col("o_orderstatus") == "F", F.lit("e")).when(F.col("o_orderstatus") == "O", F.lit("p"))
        .otherwise(F.lit("x")).alias("class"),
        F.substring(F.lit("bcxfks?"), (F.col("o_custkey") % 7 + 1).cast("int"), F.lit(1)).alias("cap-shape"),
        F.substring(F.lit("tf"), (F.col("o_orderkey") % 2 + 1).cast("int"), F.lit(1)).alias("bruises"),
        F.substring(F.lit("glmpuwd"), (F.year("o_orderdate") % 7 + 1).cast("int"), F.lit(1)).alias("habitat"))


def p19_mushroom(spark, sf):
    return presets.mushroom(_mushrooms(spark, sf))


def p20_mushroom_fixed(spark, sf):
    return presets.mushroom_fixed(_mushrooms(spark, sf))


SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def p21_zscore(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *SCALED).withColumn("flat", F.lit(3.0))
    scaled = clean.zscore(rows, [*SCALED, "flat"])
    return scaled.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in [*SCALED, "flat"]])


def o5_preview(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    head = orders.orderBy("o_orderkey").limit(5).withColumn("part", F.lit("first"))
    return head.unionByName(orders.orderBy(F.desc("o_orderkey")).limit(5).withColumn("part", F.lit("last")))


def d1_contract(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("idx"),
        F.when(F.col("event_type") != "error", F.col("user_id") % 3).alias("y"))
    return checks.dataset_contract(rows, "y", [0, 1])


QUERIES = {f.__name__: f for f in (
    p1_drop, p2_dropna, p2_counts, p3_sentinel, p4_replace, p5_fixed, p6_learned, p6_learned_wide, o1_sorted_distinct, p7_onehot,
    p8_coerce, p9_cast, p10_features, p11_mask, p13_first_seen, p14_text, p15_dict, p16_titanic, p17_diabetes,
    p18_loan, p19_mushroom, p20_mushroom_fixed, p21_zscore, o5_preview, d1_contract)}

GAPPY = """gappy AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status,
    nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority FROM orders)"""
MUSHROOMS = """m AS (SELECT o_orderkey AS idx, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS class,
    nullif(substr('bcxfks?', CAST(o_custkey % 7 + 1 AS INT), 1), '?') AS cap,
    CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS bruises,
    substr('glmpuwd', CAST(year(o_orderdate) % 7 + 1 AS INT), 1) AS habitat FROM orders)"""


def number_sql(column: str) -> str:
    return f"regexp_replace(CAST({column} AS VARCHAR), '\\.0$', '')"


def zscore_sql(column: str) -> str:
    return (f"round(({column} - (SELECT avg({column}) FROM lineitem)) / "
            f"(SELECT stddev_pop({column}) FROM lineitem), 6) AS {column}")


SQL = {
    "p1_drop": "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders",
    "p2_dropna": f"WITH {GAPPY} SELECT * FROM gappy WHERE status IS NOT NULL AND priority IS NOT NULL",
    "p2_counts": f"""WITH {GAPPY}, c AS (SELECT count(*) AS before,
        count(*) FILTER (WHERE status IS NOT NULL AND priority IS NOT NULL) AS kept FROM gappy)
        SELECT before, kept, before - kept AS dropped FROM c""",
    "p3_sentinel": "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS o_orderstatus, o_orderpriority FROM orders",
    "p4_replace": """SELECT o_orderkey, CAST(o_totalprice > 150000 AS INT) AS large,
        CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '0' ELSE o_orderstatus END AS o_orderstatus FROM orders""",
    "p5_fixed": """SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 5 END
        AS event_type FROM events""",
    "p6_learned": """WITH t AS (SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS c FROM part WHERE p_partkey % 3 > 0)
        SELECT p.p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand, t.c AS p_type,
        dense_rank() OVER (ORDER BY p_name) - 1 AS p_name FROM part p LEFT JOIN t USING (p_partkey)""",
    "p6_learned_wide": """SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name,
        dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment FROM customer""",
    "o1_sorted_distinct": """WITH v AS (SELECT DISTINCT 'p_brand' AS "column", p_brand AS value FROM part
          UNION SELECT 'p_type', p_type FROM part UNION SELECT 'p_name', p_name FROM part)
        SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS code FROM v""",
    "p7_onehot": """SELECT c_custkey, c_nationkey, CAST(c_mktsegment = 'BUILDING' AS INT) AS c_mktsegment_BUILDING,
        CAST(c_mktsegment = 'FURNITURE' AS INT) AS c_mktsegment_FURNITURE,
        CAST(c_mktsegment = 'HOUSEHOLD' AS INT) AS c_mktsegment_HOUSEHOLD,
        CAST(c_mktsegment = 'MACHINERY' AS INT) AS c_mktsegment_MACHINERY FROM customer""",
    "p8_coerce": """SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN user_id
        WHEN 'click' THEN user_id * 10 WHEN 'signup' THEN NULL ELSE user_id + 0.5 END::DOUBLE AS amount,
        NULL::DOUBLE AS props FROM events""",
    "p9_cast": """SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS l_quantity,
        CAST(trunc(l_extendedprice) AS BIGINT) AS l_extendedprice, l_suppkey AS supplier FROM lineitem""",
    "p10_features": "SELECT c_custkey AS idx, c_nationkey, c_acctbal FROM customer",
    "p11_mask": """SELECT c_custkey AS idx, c_name AS x0, c_nationkey AS x1, c_acctbal AS x2,
        c_mktsegment AS x3 FROM customer""",
    "p13_first_seen": "SELECT o_orderpriority AS value, min(o_orderkey) AS first_pos FROM orders GROUP BY 1",
    "p14_text": f"""SELECT l_orderkey, l_linenumber, 'l_partkey: ' || l_partkey || chr(10) || 'l_quantity: ' ||
        {number_sql('l_quantity')} || chr(10) || 'l_extendedprice: ' || {number_sql('l_extendedprice')} || chr(10) ||
        'l_discount: ' || {number_sql('l_discount')} || chr(10) || 'l_returnflag: ' || l_returnflag AS text FROM lineitem""",
    "p15_dict": """SELECT c_custkey AS idx, '{"c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}'
        AS text FROM customer""",
    "p16_titanic": """SELECT o_orderkey AS idx, CAST(o_orderstatus = 'F' AS DOUBLE) AS Survived,
        CAST(o_orderpriority[1] AS DOUBLE) AS Pclass, CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 1 END AS Sex,
        CAST(o_orderkey % 80 AS DOUBLE) AS Age, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS Embarked
        FROM orders WHERE o_orderkey % 7 > 0 AND (o_custkey % 2 = 0 OR o_custkey % 5 > 0)""",
    "p17_diabetes": """SELECT p_partkey AS idx, CAST(p_size AS DOUBLE) AS Glucose, CAST(p_partkey AS DOUBLE) AS Insulin,
        CAST(p_size > 25 AS INT) AS Outcome FROM part WHERE p_size % 10 > 0""",
    "p18_loan": """SELECT c_custkey AS idx, CAST(floor(c_acctbal) AS BIGINT) AS income_annum,
        CAST(c_acctbal > 0 AS BIGINT) AS loan_status, CAST(c_nationkey % 2 <> 0 AS BIGINT) AS "education_Not Graduate",
        CAST(c_nationkey % 3 = 0 AS BIGINT) AS self_employed_Yes FROM customer WHERE c_nationkey % 3 < 2""",
    "p19_mushroom": f"""WITH {MUSHROOMS} SELECT * FROM (SELECT idx, class, bruises,
        CASE WHEN cap IS NOT NULL THEN (SELECT count(DISTINCT cap) FROM m x WHERE x.cap < m.cap) END AS "cap-shape",
        dense_rank() OVER (ORDER BY habitat) - 1 AS habitat FROM m)
        WHERE class IS NOT NULL AND "cap-shape" IS NOT NULL""",
    "p20_mushroom_fixed": f"""WITH {MUSHROOMS} SELECT idx, class, bruises, strpos('bcxfks', cap) - 1 AS "cap-shape",
        strpos('glmpuwd', habitat) - 1 AS habitat FROM m WHERE class IS NOT NULL AND cap IS NOT NULL""",
    "p21_zscore": f"""SELECT l_orderkey, l_linenumber, {', '.join(zscore_sql(c) for c in SCALED)}, CAST(0.0 AS DOUBLE) AS flat
        FROM lineitem""",
    "o5_preview": """SELECT * FROM (SELECT o_orderkey, o_custkey, 'first' AS part FROM orders ORDER BY o_orderkey LIMIT 5)
        UNION ALL SELECT * FROM (SELECT o_orderkey, o_custkey, 'last' FROM orders ORDER BY o_orderkey DESC LIMIT 5)""",
    "d1_contract": """WITH t AS (SELECT event_id AS idx, CASE WHEN event_type <> 'error' THEN user_id % 3 END AS y FROM events)
        SELECT count(*) AS "rows", count(DISTINCT idx) AS keys, count(*) FILTER (WHERE y IS NULL) AS null_targets,
        count(*) FILTER (WHERE y = 0) AS first_label, count(*) FILTER (WHERE y = 1) AS second_label,
        count(*) FILTER (WHERE y NOT IN (0, 1)) AS other_labels FROM t""",
}
