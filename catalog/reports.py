"""Report queries: result documents and tables derived from the events."""

from pyspark.sql import functions as F

from catalog.inputs import SQL_JUDGE, judge_lines, table
from tessera.operators import parse, reports, scoring
from tessera.session import shared_path
from tessera.sources import jsonl
from tessera.sources import responses as source

DATASETS = ["click", "purchase", "view"]
STRATEGY = ["tree-model", "guided-few-shot", "zero-shot-cot", "zero-shot-prompting"]


def _scores(spark, sf):
    """Each event type is a dataset; users of even number form the masked run, and the user's
    number modulo 4 picks the strategy, whose score is the largest value modulo 1000. One
    type's masked runs and one strategy of another are missing."""
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("dataset"), (F.floor(F.col("user_id") / 4) % 2 == 0).alias("masked"),
        F.get(F.array(*[F.lit(s) for s in STRATEGY]), (F.col("user_id") % 4).cast("int")).alias("strategy"),
        (F.col("event_id") % 1000 / 1000).alias("v"))
    kept = rows.filter(~(F.col("masked") & (F.col("dataset") == "view"))
                       & ~((F.col("dataset") == "click") & (F.col("strategy") == "zero-shot-cot")))
    return kept.groupBy("dataset", "masked", "strategy").agg(F.max("v").alias("macro_f1"))


def _flat(spark, sf):
    return reports.flat_scores(_scores(spark, sf))


def e2_union(spark, sf):
    """Documents of every run are written, read back together and flattened."""
    path = shared_path(spark, "runs")
    jsonl.write_scores(_scores(spark, sf), path)
    schema = "dataset string, masked boolean, strategy string, macro_f1 double"
    return reports.flat_scores(spark.read.schema(schema).json(path))


def v2_consolidate(spark, sf):
    """A result document per customer, flattened to scores and, where unmasked, judge means."""
    key = F.col("c_custkey")

    def scores(*parts):
        cells = [x for name, k in parts for x in (F.lit(name), F.struct(
            (key % k / 100).alias("accuracy"), (key % (k + 1) / 100).alias("macro_f1_score")))]
        return F.create_map(*cells)
    judged = F.create_map(
        F.lit("3"), F.create_map(F.lit("faithfulness"), F.lit(4.5), F.lit("consistency"), key % 5 + F.lit(0.0)),
        F.lit("8"), F.create_map(F.lit("faithfulness"), F.lit(4.0), F.lit("coherence"), F.lit(1.0)))
    docs = table(spark, sf, "customer").select(
        F.col("c_name").alias("dataset"), (F.col("c_nationkey") % 2 == 1).alias("masked"),
        scores(("tree-model", 71), ("zero-shot-prompting", 61)).alias("zero_shot_baseline"),
        scores(("tree-model", 71), ("zero-shot-cot", 51)).alias("zero_shot_cot_ablation"),
        scores(("tree-model", 71), ("guided-few-shot", 41)).alias("cot"), judged.alias("llm_as_judge"))
    path = shared_path(spark, "documents")
    jsonl.write_scores(docs, path)
    runs = spark.read.schema(f"dataset string, masked boolean, {jsonl.RUN_SCHEMA}").json(path)
    means = scoring.judge_means(jsonl.run_judgements(runs), ["dataset"])
    flat = reports.flat_scores(jsonl.run_scores(runs))
    return flat.unionByName(means.select("dataset", F.col("metric").alias("approach"), F.col("score").alias("value")))


def v3_pivot(spark, sf):
    return reports.approach_table(_flat(spark, sf), DATASETS)


def v4_long(spark, sf):
    names = [*DATASETS, *["masked_" + d for d in DATASETS]]
    wide = reports.approach_table(_flat(spark, sf), names)
    return reports.long_table(wide, reports.APPROACHES)


def v5_mask(spark, sf):
    return reports.mask_effect(_flat(spark, sf)).withColumn("delta", F.round("delta", 6))


def _means(spark, sf):
    """Judge means per parity of the row id, as two datasets."""
    scores = parse.judge_scores(source.evaluations(judge_lines(spark, sf)))
    named = scores.withColumn("dataset", F.when(F.col("idx") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")))
    return scoring.judge_means(named, ["dataset"])


def v6_matrix(spark, sf):
    matrix = reports.judge_matrix(_means(spark, sf), ["even", "odd"])
    return matrix.withColumns({c: F.round(c, 6) for c in ("even", "odd")})


QUERIES = {f.__name__: f for f in (e2_union, v2_consolidate, v3_pivot, v4_long, v5_mask, v6_matrix)}

SCORES = """picked AS (SELECT event_type AS dataset, floor(user_id / 4) % 2 = 0 AS masked,
    ['tree-model', 'guided-few-shot', 'zero-shot-cot', 'baseline'][CAST(user_id % 4 AS INT) + 1] AS approach,
    CAST(event_id % 1000 AS DOUBLE) / 1000 AS v FROM events),
  runs AS (SELECT dataset, masked, approach, max(v) AS value FROM picked
    WHERE NOT (masked AND dataset = 'view') AND NOT (dataset = 'click' AND approach = 'zero-shot-cot') GROUP BY ALL),
  flat AS (SELECT CASE WHEN masked THEN 'masked_' || dataset ELSE dataset END AS dataset, approach, value FROM runs)"""

SQL = {
    "e2_union": f"WITH {SCORES} SELECT dataset, approach, value FROM flat",
    "v2_consolidate": """WITH d AS (SELECT *, CASE WHEN c_nationkey % 2 = 1 THEN 'masked_' || c_name ELSE c_name END AS dataset
          FROM customer)
        SELECT dataset, 'tree-model' AS approach, CAST(c_custkey % 72 AS DOUBLE) / 100 AS value FROM d
        UNION ALL SELECT dataset, 'baseline', CAST(c_custkey % 62 AS DOUBLE) / 100 FROM d
        UNION ALL SELECT dataset, 'zero-shot-cot', CAST(c_custkey % 52 AS DOUBLE) / 100 FROM d
        UNION ALL SELECT dataset, 'guided-few-shot', CAST(c_custkey % 42 AS DOUBLE) / 100 FROM d
        UNION ALL SELECT c_name, 'faithfulness', 4.25 FROM customer WHERE c_nationkey % 2 = 0
        UNION ALL SELECT c_name, 'consistency', CAST(c_custkey % 5 AS DOUBLE) FROM customer WHERE c_nationkey % 2 = 0
        UNION ALL SELECT c_name, 'coherence', 1.0 FROM customer WHERE c_nationkey % 2 = 0""",
    "v3_pivot": f"""WITH {SCORES} SELECT dataset, max(value) FILTER (WHERE approach = 'tree-model') AS "tree-model",
        max(value) FILTER (WHERE approach = 'guided-few-shot') AS "guided-few-shot",
        max(value) FILTER (WHERE approach = 'zero-shot-cot') AS "zero-shot-cot",
        max(value) FILTER (WHERE approach = 'baseline') AS baseline
        FROM flat WHERE dataset IN ('click', 'purchase', 'view') GROUP BY dataset""",
    "v4_long": f"""WITH {SCORES} SELECT CASE dataset WHEN 'click' THEN 'Click' WHEN 'purchase' THEN 'Purchase'
        WHEN 'view' THEN 'View' WHEN 'masked_click' THEN 'Masked_Click' WHEN 'masked_purchase' THEN 'Masked_Purchase' END AS dataset,
        CASE approach WHEN 'tree-model' THEN 'Tree Model' WHEN 'guided-few-shot' THEN 'Guided Few Shot'
        WHEN 'zero-shot-cot' THEN 'Zero Shot Cot' ELSE 'Baseline' END AS approach, value AS performance FROM flat
        WHERE dataset IN ('click', 'purchase', 'view', 'masked_click', 'masked_purchase')""",
    "v5_mask": f"""WITH {SCORES} SELECT u.dataset, u.approach, u.value AS unmasked, m.value AS masked,
        round(m.value - u.value, 6) AS delta FROM runs u JOIN runs m ON u.dataset = m.dataset AND u.approach = m.approach
        WHERE NOT u.masked AND m.masked""",
    "v6_matrix": f"""WITH {SQL_JUDGE}, kept AS (SELECT *, idx % 2 AS side FROM judged WHERE event_type IN ('click', 'view')),
        m AS (SELECT 'faithfulness' AS metric, side, CAST(q AS DOUBLE) AS s FROM kept
          UNION ALL SELECT 'consistency', side, CAST(q2 AS DOUBLE) FROM kept
          UNION ALL SELECT 'coherence', side, 4.0 FROM kept WHERE event_type = 'click')
        SELECT metric, round(avg(s) FILTER (WHERE side = 0), 6) AS even, round(avg(s) FILTER (WHERE side = 1), 6) AS odd
        FROM m GROUP BY metric""",
}
