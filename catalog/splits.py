"""Split, fold, trial and join queries."""

from pyspark.sql import functions as F

from catalog.inputs import table
from tessera.operators import joins, split, trials
from tessera.operators.trials import clean_params, typed_params


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("status"))


def x1_split(spark, sf):
    return split.exact_split(_orders(spark, sf))


def x1_approx(spark, sf):
    return split.hashed_split(_orders(spark, sf))


def x2_folds(spark, sf):
    return split.stratified_folds(_orders(spark, sf), "status")


def x3_sets(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), "c_mktsegment")
    return split.example_sets(rows, 10)


SPACE = {
    "learning_rate": {"distribution": "log_uniform_values", "min": 0.005, "max": 0.3},
    "max_depth": {"distribution": "int_uniform", "min": 3, "max": 8},
    "subsample": {"distribution": "uniform", "min": 0.6, "max": 1.0},
    "min_child_weight": {"values": [1, 3, 5]},
    "n_estimators": {"distribution": "int_uniform", "min": 100, "max": 500},
    "random_state": {"value": 42},
}


def x4_trials(spark, sf):
    """A trial for every customer."""
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("trial"))
    drawn = trials.sample_trials(keys, SPACE)
    return drawn.withColumns({c: F.round(c, 9) for c in ("learning_rate", "subsample")})


def x5_params(spark, sf):
    size = F.col("p_size").cast("string")
    logged = F.create_map(
        F.lit("_step"), size, F.lit("wandb"), size, F.lit("max_depth"), size,
        F.lit("n_estimators"), F.concat(size, F.lit(".7")),
        F.lit("learning_rate"), F.concat(F.lit('{"value": 0.0'), size, F.lit("}")),
        F.lit("note"), F.col("p_brand"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("trial"), logged.alias("params"))
    cleaned = clean_params(rows)
    types = {"max_depth": "int", "n_estimators": "int", "learning_rate": "double", "note": "string"}
    return typed_params(cleaned.withColumn("left", F.size("params")), types)


def j1_select(spark, sf):
    returned = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("idx"))
    return joins.select_rows(_orders(spark, sf), returned)


def j1_ordered(spark, sf):
    keys = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("idx"), (F.col("c_custkey") * 7919 % 1000003).alias("pos"))
    return joins.select_rows_ordered(_orders(spark, sf), keys).withColumn("pos", F.col("pos"))


def j1_missing(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_id").alias("idx"))
    return joins.missing_keys(table(spark, sf, "customer").select(F.col("c_custkey").alias("idx")), events)


def _by_customer(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("idx"))
    predictions = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("idx"), (F.col("c_acctbal") > 0).cast("bigint").alias("prediction"))
    return rows, predictions


def j2_predictions(spark, sf):
    rows, predictions = _by_customer(spark, sf)
    return rows.join(predictions, "idx")


def j2_hot_keys(spark, sf):
    """The way taken for predictions too many to broadcast: a shuffle whose hot keys Spark splits."""
    rows, predictions = _by_customer(spark, sf)
    return rows.join(predictions.hint("merge"), "idx")


def j6_reason(spark, sf):
    """Examples without a reasoning drop out."""
    rows, predictions = _by_customer(spark, sf)
    reasons = predictions.filter("prediction = 1").select("idx", F.concat(F.lit("because "), "idx").alias("reasoning"))
    return joins.attach(predictions, reasons)


def j7_attach(spark, sf):
    attributions = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("idx")).agg(
        F.round(F.sum("l_tax"), 6).alias("tax"))
    return joins.attach(_orders(spark, sf), attributions)


def j5_cross(spark, sf):
    """Every customer once per agent; the agents' blocks are the regions."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"))
    blocks = table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("agent"), F.col("r_name").alias("block"))
    return joins.per_agent(rows, blocks)


QUERIES = {f.__name__: f for f in (
    x1_split, x1_approx, x2_folds, x3_sets, x4_trials, x5_params, j1_select, j1_ordered, j1_missing,
    j2_predictions, j2_hot_keys, j5_cross, j6_reason, j7_attach)}


def uniform_sql(name: str) -> str:
    return (f"(CAST('0x' || substr(md5('42:{name}:' || c_custkey), 1, 13) AS BIGINT)"
            " / CAST(4503599627370496 AS DOUBLE))")


SQL = {
    "x1_split": """SELECT idx, status, CASE WHEN r <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split
        FROM (SELECT o_orderkey AS idx, o_orderstatus AS status, count(*) OVER () AS n,
          row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r FROM orders)""",
    "x1_approx": """SELECT o_orderkey AS idx, o_orderstatus AS status, CASE WHEN
        CAST('0x' || substr(md5('42:' || o_orderkey), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < 0.2
        THEN 'test' ELSE 'train' END AS split FROM orders""",
    "x2_folds": """SELECT o_orderkey AS idx, o_orderstatus AS status, CAST((row_number() OVER (PARTITION BY o_orderstatus
        ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1) % 5 AS INT) AS fold FROM orders""",
    "x3_sets": """SELECT idx, c_mktsegment, r // 10 AS agent, r % 10 AS pos FROM (SELECT c_custkey AS idx, c_mktsegment,
        row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) - 1 AS r FROM customer)""",
    "x4_trials": f"""SELECT c_custkey AS trial,
        round(exp({uniform_sql('learning_rate')} * (ln(CAST(0.3 AS DOUBLE)) - ln(CAST(0.005 AS DOUBLE))) + ln(CAST(0.005 AS DOUBLE))), 9) AS learning_rate,
        CAST(floor({uniform_sql('max_depth')} * 6) AS INT) + 3 AS max_depth,
        round({uniform_sql('subsample')} * CAST(0.4 AS DOUBLE) + CAST(0.6 AS DOUBLE), 9) AS subsample,
        [1, 3, 5][CAST(floor({uniform_sql('min_child_weight')} * 3) AS INT) + 1] AS min_child_weight,
        CAST(floor({uniform_sql('n_estimators')} * 401) AS INT) + 100 AS n_estimators, 42 AS random_state FROM customer""",
    "x5_params": """SELECT p_partkey AS trial, 4 AS "left", p_size AS max_depth, p_size AS n_estimators,
        CAST('0.0' || p_size AS DOUBLE) AS learning_rate, p_brand AS note FROM part""",
    "j1_select": """SELECT o_orderkey AS idx, o_orderstatus AS status FROM orders
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "j1_ordered": """SELECT o_orderkey AS idx, o_orderstatus AS status, c_custkey * 7919 % 1000003 AS pos
        FROM orders JOIN customer ON o_orderkey = c_custkey""",
    "j1_missing": "SELECT event_id AS idx FROM events WHERE event_id NOT IN (SELECT c_custkey FROM customer)",
    "j2_predictions": """SELECT o_orderkey, o_custkey AS idx, CAST(c_acctbal > 0 AS BIGINT) AS prediction
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "j2_hot_keys": """SELECT o_orderkey, o_custkey AS idx, CAST(c_acctbal > 0 AS BIGINT) AS prediction
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "j5_cross": """SELECT c_custkey AS idx, CAST(r_regionkey AS BIGINT) AS agent, r_name AS block FROM customer, region""",
    "j6_reason": """SELECT c_custkey AS idx, 1 AS prediction, 'because ' || c_custkey AS reasoning FROM customer
        WHERE c_acctbal > 0""",
    "j7_attach": """SELECT o_orderkey AS idx, o_orderstatus AS status, round(sum(l_tax), 6) AS tax
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""",
}
