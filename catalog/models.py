"""Model, attribution and selection queries, and whole jobs."""

from dataclasses import replace

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.inputs import FEATURES, candidate_line, choice_line, order_features, result_line, table
from catalog.scoring import f1_sql, rounded
from tessera.config import TRIALS, ModelSpec
from tessera.operators import attribution, models, representatives, requests, trials
from tessera.operators.split import exact_split
from tessera.plans import run as runs
from tessera.plans.explain import explain
from tessera.session import cut_lineage, spread

PARAMS = {"n_estimators": 20, "max_depth": 5, "learning_rate": 0.1}
SWEEP = {
    "max_depth": {"distribution": "int_uniform", "min": 2, "max": 6},
    "n_estimators": {"values": [10, 20, 30]},
    "subsample": {"distribution": "uniform", "min": 0.5, "max": 1.0},
    "min_child_weight": {"values": [1, 2, 4, 8]},
    "random_state": {"value": 42},
}
FOREST = "RandomForestClassifier"
CELL_FOREST = "RandomForest"


def _split(spark, sf):
    rows = exact_split(spread(cut_lineage(order_features(spark, sf), "features")))
    return spread(cut_lineage(rows, "split"))


def _fitted(spark, sf, kind="GBTClassifier", params=None):
    rows = _split(spark, sf)
    train = rows.filter("split = 'train'")
    return rows, train, models.fit(models.make_estimator(kind, params or PARAMS), train, FEATURES, "y")


def m1_fit(spark, sf):
    """Per split: rows, and predictions that are not the sign of the model's margin."""
    rows, _, model = _fitted(spark, sf)
    found = models.predict(model, rows, FEATURES, ["idx", "split"]).join(
        attribution.margins(model, rows, FEATURES), "idx")
    wrong = F.count_if((F.col("margin") > 0).cast("long") != F.col("prediction"))
    return found.groupBy("split").agg(F.count(F.lit(1)).alias("n"), wrong.alias("off"))


NEWTON = {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.3, "reg_lambda": 2.0, "min_child_weight": 1, "subsample": 0.8}


def m1_newton(spark, sf):
    """Second-order boosting: prediction and log-odds of every row, from the training rows."""
    rows = _split(spark, sf)
    model = models.make_estimator("NewtonBoost", NEWTON).fit(
        models.with_vector(rows.filter("split = 'train'"), FEATURES, "y"), key="idx")
    found = model.transform(models.with_vector(rows, FEATURES))
    return found.select("idx", "split", "y", F.col("prediction").cast("bigint").alias("prediction"), F.round("margin", 6).alias("margin"))


def m1_newton_stump(spark, sf):
    """One cut by the number of lines, with and without regularisation: the cut's sides, their rows and payments."""
    rows = order_features(spark, sf).select("idx", "lines", "y")
    rows = models.with_vector(spread(cut_lineage(rows, "features")), ["lines"], "y")
    parts = None
    for reg_lambda in (0.0, 50.0):
        model = models.make_estimator("NewtonBoost", {"n_estimators": 1, "max_depth": 1, "learning_rate": 1.0,
                                                      "reg_lambda": reg_lambda}).fit(rows, key="idx")
        part = model.transform(rows).groupBy(F.round("margin", 6).alias("margin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("lines").alias("least"), F.max("lines").alias("most"))
        part = part.withColumn("reg_lambda", F.lit(reg_lambda))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def _classified(spark, sf, kind, params):
    """Prediction and margin of every row, from the training rows."""
    rows = _split(spark, sf)
    model = models.make_estimator(kind, params).fit(models.with_vector(rows.filter("split = 'train'"), FEATURES, "y"))
    found = model.transform(models.with_vector(rows, FEATURES))
    return found.select("idx", "split", "y", F.col("prediction").cast("bigint").alias("prediction"), F.round("margin", 6).alias("margin"))


def m1_adaboost(spark, sf):
    """Boosting by reweighted rows: prediction and difference of the votes of every row."""
    return _classified(spark, sf, "AdaBoost", {"n_estimators": 10})


def m1_extra_trees(spark, sf):
    """Extremely randomised trees: prediction and mean share of class 1 of every row."""
    return _classified(spark, sf, "ExtraTrees", {"n_estimators": 10, "max_depth": 5})


ADA_ROUNDS = 3


def m1_ada_rounds(spark, sf):
    """Rounds of stumps by the number of lines: cut, error, vote, and the rows that a round's stump and the votes so far call 1."""
    rows = order_features(spark, sf).select("idx", "lines", "y")
    rows = models.with_vector(spread(cut_lineage(rows, "features")), ["lines"], "y")
    model = models.make_estimator("AdaBoost", {"n_estimators": ADA_ROUNDS}).fit(rows)
    parts = None
    for i, (tree, vote, error) in enumerate(zip(model.trees, model.votes, model.errors)):
        alone, so_far = (replace(model, trees=model.trees[j:i + 1], votes=model.votes[j:i + 1]) for j in (i, 0))
        both = alone.transform(rows).select("features", F.col("prediction").alias("own"))
        part = so_far.transform(both).agg(F.count_if(F.col("own") == 1).alias("own"), F.count_if(F.col("prediction") == 1).alias("voted"))
        part = part.select(F.lit(i + 1).alias("round"), F.lit(tree.cut[0]).alias("cut"), F.round(F.lit(error), 6).alias("error"),
                           F.round(F.lit(vote), 6).alias("vote"), "own", "voted")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def m2_importance(spark, sf):
    """A row for each feature, in order; none is negative and they add up to 1."""
    _, train, model = _fitted(spark, sf, FOREST, {"n_estimators": 20, "max_depth": 5})
    rows = models.importances(model, train, FEATURES)
    total = F.sum("importance").over(Window.partitionBy())  # a row for each feature
    return rows.select("feature", "position", (F.col("importance") >= 0).alias("valid"), F.round(total, 9).alias("total"))


def m3_shap(spark, sf):
    """The training rows, each with a number for every feature."""
    _, train, model = _fitted(spark, sf)
    found = attribution.attributions(model, train, FEATURES)
    whole = F.lit(True)
    for name in FEATURES:
        whole = whole & F.col(name).isNotNull() & ~F.isnan(name)
    return found.select("idx", whole.alias("whole"))


def m3_additivity(spark, sf):
    """Attributions and base value of 100 deep trees add up to the model's output on every training row."""
    _, train, model = _fitted(spark, sf, CELL_FOREST, {"n_estimators": 100, "max_depth": 6})
    leaves = attribution.leaves_of(model, spark)
    parts = attribution.attributions(model, train, FEATURES, leaves=leaves)
    total = sum((F.col(c) for c in FEATURES), F.lit(attribution.base_value(leaves)))
    gaps = parts.join(attribution.margins(model, train, FEATURES), "idx").select(F.abs(total - F.col("margin")).alias("gap"))
    return gaps.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") > 1e-9).alias("off"))


def m3_categories(spark, sf):
    """Attributions of a forest that splits two features by sets of categories add up, and how many of its leaves hold a set."""
    kinds = {"lines": 12, "late": 7}  # the last number of lines stands for more too, lateness by its place in the week
    train = _split(spark, sf).filter("split = 'train'").withColumns({
        "lines": F.least("lines", F.lit(11)), "late": F.pmod(F.col("late").cast("bigint"), F.lit(7))})
    model = models.fit(models.make_estimator(FOREST, {"n_estimators": 10, "max_depth": 5}), train, FEATURES, "y", kinds)
    leaves = attribution.leaves_of(model, spark)
    parts = attribution.attributions(model, train, FEATURES, leaves=leaves)
    total = sum((F.col(c) for c in FEATURES), F.lit(attribution.base_value(leaves)))
    gaps = parts.join(attribution.margins(model, train, FEATURES), "idx").select(F.abs(total - F.col("margin")).alias("gap"))
    sets = any(leaf.sets for leaf in leaves)
    return gaps.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") > 1e-9).alias("off")).withColumn("sets", F.lit(sets))


def m4_tune(spark, sf):
    """Ten trials on five folds each; scores are shares."""
    train = _split(spark, sf).filter("split = 'train'")
    drawn = trials.sample_trials(spark.range(TRIALS).withColumnRenamed("id", "trial"), SWEEP)
    found = models.tune(train, FEATURES, "y", drawn, CELL_FOREST)
    valid = F.col("accuracy").between(0, 1) & F.col("macro_f1").between(0, 1)
    return found.select("trial", "fold", valid.alias("valid"))


def _groups(spark, sf):
    """Two columns of each vector, shifted by its label so far that every label is a group of its own."""
    label = F.col("label").cast("double")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("idx"), (label % 4 * 40 + F.col("embedding")[0]).alias("a"),
        (F.floor(label / 4) * 40 + F.col("embedding")[1]).alias("b"))


def m5_k(spark, sf):
    """All numbers of clusters tried, and the best: that of the groups."""
    points = spread(cut_lineage(representatives.as_points(_groups(spark, sf), ["a", "b"]), "points"))
    scores = representatives.choose_k(points)
    best = representatives.best_k({r["k"]: r["silhouette"] for r in scores.collect()})
    return scores.select("k", (F.col("k") == best).alias("best"))


def _labelled(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("idx"), F.col("label").alias("cluster"),
        F.col("embedding").cast("array<double>").alias("point"))


def m6_medoid(spark, sf):
    """Medoids of the label groups around each group's mean; as many means as labels."""
    points = _labelled(spark, sf)
    means = points.groupBy("cluster").agg(vector_to_array(Summarizer.mean(array_to_vector("point"))).alias("centre"))
    found = representatives.medoids(points.join(means, "cluster"), F.col("centre"))
    return found.select("cluster", "idx", F.round("distance", 6).alias("distance"))


def a11_silhouette(spark, sf):
    """Silhouette of the label groups under squared distance."""
    value = representatives.silhouette(_labelled(spark, sf))
    return (table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("n"))
            .select("n", F.round(F.lit(value), 6).alias("silhouette")))


def m7_diverse(spark, sf):
    """The row nearest the centre of each group."""
    return representatives.diverse_examples(_groups(spark, sf)).select("idx", F.round("distance", 6).alias("distance"))


def _explained(spark, sf):
    return explain(order_features(spark, sf), "y", SWEEP, CELL_FOREST)


def m8_explain(spark, sf):
    """Per split: rows, predictions and attributed rows; only training rows are attributed."""
    found = _explained(spark, sf)
    parts = found.table.select("idx", "split").join(
        found.predictions.select("idx", F.col("split").alias("predicted_in"), "prediction"), "idx", "left").join(
        found.attributions.select("idx", F.lit(1).alias("attributed")), "idx", "left")
    return parts.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted_in") == F.col("split")).alias("predicted"),
        F.count("attributed").alias("attributed"))


def _idx(key):
    return F.regexp_extract(key, r"batch-(\d+)", 1).cast("bigint")


def offline_answers(lines):
    """Stands in for the services: the kind of request and the row id decide the answer."""
    key = F.col("key")
    label = F.concat(F.lit("So FINAL PREDICTION: "), (_idx(key) % 2).cast("string"))
    line = (F.when(key.startswith("reasoning"), choice_line(
                key, F.concat(F.lit("</think><REASONING>reason "), _idx(key).cast("string"), F.lit("</REASONING>"))))
            .when(key.startswith("judge"), result_line(key, F.lit("succeeded"), F.lit(
                'EVALUATION: {"metrics": {"faithfulness": 4.5, "consistency": 4.0, "coherence": 4.75}}')))
            .when(key.contains("zero-shot_"), candidate_line(key, F.lit("STOP"), (_idx(key) % 2).cast("string")))
            .otherwise(candidate_line(key, F.lit("STOP"), label)))
    return lines.select("key", line.alias("line"))


CLASSIFIER = ModelSpec("model-b", 0.0, 4096)


def v7_baseline(spark, sf):
    """Both strategies without examples, on the customers' test rows, from recorded answers of all customers."""
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("idx"), "c_nationkey", F.floor("c_acctbal").alias("balance"),
        (F.col("c_acctbal") > 0).cast("int").alias("y"))
    split = cut_lineage(exact_split(rows), "split")
    e = runs.Explanation(split, None, None, None)
    task = runs.Task("customers", "y", {0: "No", 1: "Yes"})
    kinds = F.explode(F.array(F.lit("zero-shot"), F.lit("zero-shot-cot"))).alias("kind")
    asked = table(spark, sf, "customer").select("c_custkey", kinds)
    key = F.concat(F.lit("baseline_"), "kind", F.lit("_batch-"), F.col("c_custkey").cast("string"))
    recorded = cut_lineage(offline_answers(asked.select(key.alias("key"))), "recorded")

    def replayed(lines):
        return requests.replay(lines, recorded).select("key", F.col("response").alias("line"))
    parts = [runs.baseline(e, task, CLASSIFIER, replayed, stepwise) for stepwise in (False, True)]
    return rounded(parts[0].unionByName(parts[1]))


def v8_run(spark, sf):
    """The end-to-end run with every option, under neutral names; the tree model has no scores here."""
    e, task = runs.mask(_explained(spark, sf), "y")
    specs = runs.Models(ModelSpec("model-a", 0.6, 4096), ModelSpec("model-c", 0.6, 4096), CLASSIFIER)
    found = runs.run(e, task, specs, offline_answers, with_baseline=True, with_judge=True, with_stepwise=True)
    own = F.col("strategy") == runs.MODEL  # follows from the fit alone
    scores = rounded(found.scores).withColumns({c: F.when(~own, F.col(c)) for c in ("accuracy", "macro_f1")})
    return scores.select("strategy", "accuracy", "macro_f1", "n")


QUERIES = {f.__name__: f for f in (
    m1_fit, m1_newton, m1_newton_stump, m1_adaboost, m1_ada_rounds, m1_extra_trees, m2_importance, m3_shap, m3_additivity, m3_categories,
    m4_tune, m5_k, m6_medoid, a11_silhouette, m7_diverse, m8_explain, v7_baseline, v8_run)}

SPLITS = """orders_y AS (SELECT l_orderkey AS idx, CAST(max(CAST(l_returnflag = 'R' AS INT)) AS BIGINT) AS y FROM lineitem GROUP BY 1),
  splits AS (SELECT idx, y, CASE WHEN r <= ceil(CAST(0.2 AS DOUBLE) * n) THEN 'test' ELSE 'train' END AS split FROM (
    SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('42:' || idx), idx) AS r FROM orders_y))"""
POINTS = "pts AS (SELECT vec_id AS idx, label AS cluster, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
SCORED = """rs AS (SELECT c_custkey AS idx, CAST(c_acctbal > 0 AS BIGINT) AS y FROM customer),
  scored AS (SELECT unnest(['zero-shot-prompting', 'zero-shot-cot']) AS strategy, idx % 2 AS prediction, y FROM (
    SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('42:' || idx), idx) AS r FROM rs)
    WHERE r <= ceil(CAST(0.2 AS DOUBLE) * n))"""



def _ada_round(i):
    """SQL of a round over cells of equal lines and label (k rows of weight w each, votes so far for class 1 less those for 0)."""
    return f"""s{i} AS (SELECT c.lines AS cut, r.lines <= c.lines AS l, y, sum(k * w) AS w
          FROM c{i} r, (SELECT DISTINCT lines FROM c{i}) c GROUP BY ALL),
        p{i} AS (SELECT cut, sum(p) AS p FROM (SELECT cut, l, sum(w * w) / sum(w) AS p FROM s{i} GROUP BY ALL)
          GROUP BY cut HAVING count(*) = 2),
        b{i} AS (SELECT cut FROM p{i}, (SELECT sum(w * w) / sum(w) AS t FROM (SELECT y, sum(k * w) AS w FROM c{i} GROUP BY y))
          ORDER BY round(p - t, 9) DESC, cut LIMIT 1),
        o{i} AS (SELECT l, y AS said FROM (SELECT l, y, row_number() OVER (PARTITION BY l ORDER BY round(w, 9) DESC, y) AS n
          FROM s{i} JOIN b{i} USING (cut)) WHERE n = 1),
        d{i} AS (SELECT r.lines, r.y, k, w, votes, o.said, b.cut FROM c{i} r, b{i} b, o{i} o WHERE o.l = (r.lines <= b.cut)),
        e{i} AS (SELECT sum(k * w) FILTER (WHERE said <> y) AS e FROM d{i}),
        c{i + 1} AS (SELECT lines, y, k, w * CASE WHEN said <> y THEN (1 - e) / e ELSE 1 END / (2 * (1 - e)) AS w,
          votes + CASE WHEN said = 1 THEN 1 ELSE -1 END * ln((1 - e) / e) AS votes, said, cut, e FROM d{i}, e{i})"""


SQL = {
    "m1_ada_rounds": f"""WITH rs AS (SELECT CAST(count(*) AS DOUBLE) AS lines, max(CAST(l_returnflag = 'R' AS INT)) AS y
          FROM lineitem GROUP BY l_orderkey),
        c1 AS (SELECT lines, y, count(*) AS k, 1.0::DOUBLE / (SELECT count(*) FROM rs) AS w, 0.0::DOUBLE AS votes FROM rs GROUP BY ALL),
        {", ".join(_ada_round(i) for i in range(1, ADA_ROUNDS + 1))},
        ends AS ({" UNION ALL ".join(f"SELECT {i} AS round, * FROM c{i + 1}" for i in range(1, ADA_ROUNDS + 1))})
        SELECT round, cut, round(e, 6) AS error, round(ln((1 - e) / e), 6) AS vote,
          CAST(coalesce(sum(k) FILTER (WHERE said = 1), 0) AS BIGINT) AS own,
          CAST(coalesce(sum(k) FILTER (WHERE votes > 1e-12), 0) AS BIGINT) AS voted FROM ends GROUP BY round, cut, e""",
    "m1_fit": f"""WITH {SPLITS} SELECT split, count(*) AS n, 0 AS off FROM splits GROUP BY split""",
    "m1_newton_stump": """WITH rs AS (SELECT CAST(count(*) AS DOUBLE) AS lines, max(CAST(l_returnflag = 'R' AS INT)) AS y
          FROM lineitem GROUP BY l_orderkey),
        sides AS (SELECT reg_lambda, c.lines AS cut, sum(CASE WHEN r.lines <= c.lines THEN 0.5 - y ELSE 0 END) AS gl,
            sum(CASE WHEN r.lines <= c.lines THEN 0.25 ELSE 0 END) AS hl, sum(0.5 - y) AS g, count(*) * 0.25 AS h
          FROM rs r, (SELECT DISTINCT lines FROM rs) c, (SELECT unnest([0.0, 50.0])::DOUBLE AS reg_lambda) GROUP BY ALL),
        gains AS (SELECT *, round(gl * gl / (hl + reg_lambda) + (g - gl) * (g - gl) / (h - hl + reg_lambda)
            - g * g / (h + reg_lambda), 9) AS gain FROM sides WHERE hl >= 1 AND h - hl >= 1),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reg_lambda ORDER BY gain DESC, cut) AS k FROM gains) WHERE k = 1)
        SELECT round(CASE WHEN lines <= cut THEN -gl / (hl + reg_lambda) ELSE -(g - gl) / (h - hl + reg_lambda) END, 6)::DOUBLE AS margin,
          count(*) AS n, min(lines) AS least, max(lines) AS most, reg_lambda FROM rs, best GROUP BY ALL""",
    "m2_importance": """SELECT unnest(['quantity', 'price', 'discount', 'lines', 'late']) AS feature,
        unnest([0, 1, 2, 3, 4]) AS position, count(*) > 0 AS valid, 1.0::DOUBLE AS total FROM lineitem""",
    "m3_shap": f"WITH {SPLITS} SELECT idx, true AS whole FROM splits WHERE split = 'train'",
    "m3_additivity": f"WITH {SPLITS} SELECT count(*) AS n, 0 AS off FROM splits WHERE split = 'train'",
    "m3_categories": f"WITH {SPLITS} SELECT count(*) AS n, 0 AS off, true AS sets FROM splits WHERE split = 'train'",
    "m4_tune": """SELECT t.range AS trial, CAST(f.range AS INT) AS fold, (SELECT count(*) FROM lineitem) > 0 AS valid
        FROM range(10) t, range(5) f""",
    "m5_k": """SELECT CAST(range AS INT) AS k, range = (SELECT count(DISTINCT label) FROM embeddings) AS best FROM range(2, 11)""",
    "m7_diverse": """WITH g AS (SELECT vec_id AS idx, label, CAST(label % 4 * 40 + CAST(embedding[1] AS DOUBLE) AS DOUBLE) AS a,
          CAST(label // 4 * 40 + CAST(embedding[2] AS DOUBLE) AS DOUBLE) AS b FROM embeddings),
        z AS (SELECT idx, label, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b FROM g),
        d AS (SELECT idx, label, sqrt(power(a - avg(a) OVER p, 2) + power(b - avg(b) OVER p, 2)) AS distance FROM z
          WINDOW p AS (PARTITION BY label))
        SELECT idx, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, idx) AS r
          FROM d) WHERE r = 1""",
    "m8_explain": f"""WITH {SPLITS} SELECT split, count(*) AS n, count(*) AS predicted,
        count(*) FILTER (WHERE split = 'train') AS attributed FROM splits GROUP BY split""",
    "v8_run": f"""WITH {SPLITS}, scored AS (SELECT unnest(['guided-few-shot', 'zero-shot-prompting', 'zero-shot-cot']) AS strategy,
          idx % 2 AS prediction, y FROM splits WHERE split = 'test'), {f1_sql('scored', 'strategy')}
        SELECT strategy, round(avg(CAST(y = prediction AS INT)), 6) AS accuracy,
          round((SELECT avg(f1) FROM f1 WHERE f1.strategy = s.strategy), 6) AS macro_f1, count(*) AS n
        FROM scored s GROUP BY strategy
        UNION ALL SELECT 'tree-model', NULL, NULL, count(*) FROM splits WHERE split = 'test'""",
    "m6_medoid": f"""WITH {POINTS}, dims AS (SELECT cluster, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM pts),
        means AS (SELECT cluster, list(m ORDER BY d) AS c FROM (SELECT cluster, d, avg(x) AS m FROM dims GROUP BY ALL) GROUP BY cluster),
        dist AS (SELECT p.cluster, idx, list_distance(v, c) AS distance FROM pts p JOIN means m ON p.cluster = m.cluster)
        SELECT cluster, idx, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY cluster
          ORDER BY distance, idx) AS r FROM dist) WHERE r = 1""",
    "a11_silhouette": f"""WITH {POINTS}, pairs AS (SELECT a.idx, a.cluster AS own, b.cluster AS other,
          sum(power(list_distance(a.v, b.v), 2)) AS s, count(*) AS n FROM pts a, pts b GROUP BY ALL),
        inner_d AS (SELECT idx, n, s / (n - 1) AS a FROM pairs WHERE own = other),
        outer_d AS (SELECT idx, min(s / n) AS b FROM pairs WHERE own <> other GROUP BY idx)
        SELECT count(*) AS n, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
        FROM inner_d JOIN outer_d USING (idx)""",
    "v7_baseline": f"""WITH {SCORED}, {f1_sql('scored', 'strategy')}
        SELECT strategy, round(avg(CAST(y = prediction AS INT)), 6) AS accuracy,
          round((SELECT avg(f1) FROM f1 WHERE f1.strategy = s.strategy), 6) AS macro_f1, count(*) AS n
        FROM scored s GROUP BY strategy""",
}
