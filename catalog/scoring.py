"""Scoring queries."""

from pyspark.sql import functions as F

from catalog.inputs import SQL_TRUTH, sql_votes, table, truth, vote_lines
from tessera.operators import joins, parse, scoring
from tessera.sources import responses as source


def _voted(spark, sf, label="user_id"):
    return parse.agent_labels(source.candidates(vote_lines(spark, sf, label)))


def _scored(spark, sf):
    return joins.attach_truth(_voted(spark, sf), truth(spark, sf), "y")


def _pairs(spark, sf):
    return joins.common_rows(_voted(spark, sf), _voted(spark, sf, "event_id"), truth(spark, sf))


def v1_evaluate(spark, sf):
    """Two strategies and the order status scored in one job."""
    first = _voted(spark, sf).withColumn("strategy", F.lit("guided-few-shot"))
    second = _voted(spark, sf, "event_id").withColumn("strategy", F.lit("zero-shot-cot"))
    scored = joins.attach_truth(first.unionByName(second), truth(spark, sf), "y")
    return rounded(scoring.evaluate(scored, ["strategy"]))


def rounded(df, names=("accuracy", "macro_f1")):
    return df.withColumns({n: F.round(n, 6) for n in names})


def a1_accuracy(spark, sf):
    return rounded(scoring.accuracy(scoring.confusion(_scored(spark, sf))), ["accuracy"])


def a2_macro_f1(spark, sf):
    return rounded(scoring.macro_f1(scoring.confusion(_scored(spark, sf))), ["macro_f1"])


def a2_label_f1(spark, sf):
    return rounded(scoring.label_f1(scoring.confusion(_scored(spark, sf))), ["f1"])


def a3_contingency(spark, sf):
    return scoring.contingency(_pairs(spark, sf))


def a4_mcnemar(spark, sf):
    found = scoring.mcnemar(_pairs(spark, sf))
    return found.select("a", "b", "c", "d", F.round("statistic", 6).alias("statistic"),
                        F.round("p_value", 8).alias("p_value"), "significant")


def j3_truth(spark, sf):
    return _scored(spark, sf).select("idx", "prediction", "y")


def j4_common(spark, sf):
    return _pairs(spark, sf)


def e1_intersect(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("idx"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("idx"))
    return joins.common_keys(customers, orders)


def _line_folds(spark, sf):
    """Each line's ship year is a trial and its line number modulo 5 a fold."""
    hit = (F.col("l_returnflag") == "N").cast("bigint")
    guess = (F.col("l_linestatus") == "O").cast("bigint")
    rows = table(spark, sf, "lineitem").select(
        F.year("l_shipdate").cast("bigint").alias("trial"), (F.col("l_linenumber") % 5).alias("fold"),
        hit.alias("y"), guess.alias("prediction"))
    return scoring.evaluate(rows, ["trial", "fold"])


def a9_fold_stats(spark, sf):
    return rounded(scoring.fold_summary(_line_folds(spark, sf)),
                   ["accuracy", "accuracy_std", "f1_macro", "f1_macro_std"])


def a10_best_trial(spark, sf):
    best = scoring.best_trial(scoring.fold_summary(_line_folds(spark, sf)))
    return best.select("trial", F.round("f1_macro", 6).alias("f1_macro"))


QUERIES = {f.__name__: f for f in (
    v1_evaluate, a1_accuracy, a2_macro_f1, a2_label_f1, a3_contingency, a4_mcnemar, j3_truth, j4_common,
    e1_intersect, a9_fold_stats, a10_best_trial)}

USER, EVENT = sql_votes("user_id"), sql_votes("event_id")


def f1_sql(rows: str, by: str) -> str:
    """CTE ``f1({by}, label, f1)`` over rows with y and prediction."""
    return f"""labels AS (SELECT DISTINCT {by}, unnest([y, prediction]) AS label FROM {rows}),
f1 AS (SELECT l.{by} AS {by}, label, 2.0 * count(*) FILTER (WHERE y = label AND prediction = label)
    / (count(*) FILTER (WHERE y = label) + count(*) FILTER (WHERE prediction = label)) AS f1
  FROM labels l JOIN {rows} r ON l.{by} = r.{by} GROUP BY ALL)"""


SCORED = f"{USER}, {SQL_TRUTH}, scored AS (SELECT 'x' AS strategy, idx, prediction, y FROM voted_user_id JOIN truth USING (idx))"
PAIRS = f"""{USER}, {EVENT}, {SQL_TRUTH}, pairs AS (SELECT u.idx, y, u.prediction AS p1, e.prediction AS p2
  FROM voted_user_id u JOIN voted_event_id e USING (idx) JOIN truth USING (idx))"""
COUNTS = """counts AS (SELECT count(*) FILTER (WHERE p1 = y AND p2 = y) AS a,
  count(*) FILTER (WHERE p1 = y AND p2 <> y) AS b, count(*) FILTER (WHERE p1 <> y AND p2 = y) AS c,
  count(*) FILTER (WHERE p1 <> y AND p2 <> y) AS d FROM pairs)"""
FOLD_ROWS = """folded AS (SELECT year(l_shipdate) * 10 + l_linenumber % 5 AS cell, year(l_shipdate) AS trial,
  CAST(l_returnflag = 'N' AS BIGINT) AS y, CAST(l_linestatus = 'O' AS BIGINT) AS prediction FROM lineitem)"""
FOLDS = f"""{FOLD_ROWS}, {f1_sql('folded', 'cell')},
  folds AS (SELECT trial, cell, avg(CAST(y = prediction AS INT)) AS acc FROM folded GROUP BY ALL),
  folds_f1 AS (SELECT cell, avg(f1) AS mf FROM f1 GROUP BY cell),
  summary AS (SELECT trial, avg(acc) AS accuracy, stddev_pop(acc) AS accuracy_std, avg(mf) AS f1_macro,
    stddev_pop(mf) AS f1_macro_std FROM folds JOIN folds_f1 USING (cell) GROUP BY trial)"""

SQL = {
    "v1_evaluate": f"""WITH {USER}, {EVENT}, {SQL_TRUTH},
        stacked AS (SELECT 'guided-few-shot' AS strategy, * FROM voted_user_id
          UNION ALL SELECT 'zero-shot-cot', * FROM voted_event_id),
        scored AS (SELECT strategy, prediction, y FROM stacked JOIN truth USING (idx)),
        {f1_sql('scored', 'strategy')}
        SELECT strategy, round(avg(CAST(y = prediction AS INT)), 6) AS accuracy,
          round((SELECT avg(f1) FROM f1 WHERE f1.strategy = s.strategy), 6) AS macro_f1, count(*) AS n
        FROM scored s GROUP BY strategy""",
    "a1_accuracy": f"""WITH {SCORED} SELECT round(avg(CAST(y = prediction AS INT)), 6) AS accuracy,
        count(*) AS n FROM scored""",
    "a2_macro_f1": f"WITH {SCORED}, {f1_sql('scored', 'strategy')} SELECT round(avg(f1), 6) AS macro_f1 FROM f1",
    "a2_label_f1": f"WITH {SCORED}, {f1_sql('scored', 'strategy')} SELECT label, round(f1, 6) AS f1 FROM f1",
    "a3_contingency": f"WITH {PAIRS}, {COUNTS} SELECT * FROM counts",
    # 3.841459 is the 95% quantile of the chi-square distribution with one degree of freedom
    "a4_mcnemar": f"""WITH {PAIRS}, {COUNTS}, s AS (SELECT *, (abs(b - c) - 1) * (abs(b - c) - 1)
        / CAST(b + c AS DOUBLE) AS statistic FROM counts)
        SELECT a, b, c, d, round(statistic, 6) AS statistic, statistic > 3.841458820694124 AS significant,
          round((SELECT 2 / sqrt(pi()) * 0.005 / 3 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
            * exp(-power(sqrt(statistic / 2) + i * 0.005, 2))) FROM range(0, 2001) AS steps(i)), 8) AS p_value FROM s""",
    "j3_truth": f"WITH {SCORED} SELECT idx, prediction, y FROM scored",
    "j4_common": f"WITH {PAIRS} SELECT idx, y, p1, p2 FROM pairs",
    "e1_intersect": "SELECT c_custkey AS idx FROM customer INTERSECT SELECT o_custkey FROM orders",
    "a9_fold_stats": f"""WITH {FOLDS} SELECT trial, round(accuracy, 6) AS accuracy,
        round(accuracy_std, 6) AS accuracy_std, round(f1_macro, 6) AS f1_macro,
        round(f1_macro_std, 6) AS f1_macro_std FROM summary""",
    "a10_best_trial": f"""WITH {FOLDS} SELECT trial, round(f1_macro, 6) AS f1_macro FROM summary
        ORDER BY summary.f1_macro DESC, trial LIMIT 1""",
}
