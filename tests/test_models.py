"""Attributions against all coalitions, tuning, selection of representatives."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.sql import functions as F

from tessera.operators import attribution, models, representatives

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    u = [F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 1000.0 for s in range(3)]
    df = spark.range(400).select(F.col("id").alias("idx"), *[c.alias(n) for c, n in zip(u, FEATURES)])
    return df.withColumn("y", ((F.col("a") + F.col("b") * F.col("c") > 0.8) | (F.col("a") < 0.1)).cast("int")).cache()


def test_leaf_effects_match_all_coalitions():
    rng = np.random.default_rng(0)
    d, value = 4, 3.0
    share, met = rng.random(d), rng.integers(0, 2, d).astype(bool)

    def pay(coalition):
        return value * np.prod([float(met[i]) if i in coalition else share[i] for i in range(d)])
    for j in range(d):
        rest, total = [i for i in range(d) if i != j], 0.0
        for size in range(d):
            for s in itertools.combinations(rest, size):
                weight = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
                total += weight * (pay({*s, j}) - pay(set(s)))
        got = attribution.leaf_effects(met[None, None, :], share[None, :], np.array([value]))
        assert got[0, 0, j] == pytest.approx(total, abs=1e-12)


@pytest.mark.parametrize("kind, settings", [
    (GBTClassifier, dict(maxIter=4, maxDepth=4, stepSize=0.3, seed=1)),
    (RandomForestClassifier, dict(numTrees=5, maxDepth=4, seed=1)),
    (DecisionTreeClassifier, dict(maxDepth=5)), (GBTClassifier, dict(maxIter=1, maxDepth=9, seed=1))])
def test_attributions_add_up(spark, table, kind, settings):
    model = models.fit(models.make_estimator(kind(**settings)), table, FEATURES, "y")
    leaves = attribution.leaves_of(model, spark)
    got = attribution.attributions(model, table, FEATURES, leaves=leaves)
    total = F.col("a") + F.col("b") + F.col("c") + attribution.base_value(leaves)
    gap = got.join(attribution.margins(model, table, FEATURES), "idx").agg(F.max(F.abs(total - F.col("margin")))).first()[0]
    assert gap < 1e-9 and got.count() == 400
    assert got.columns == ["idx", *FEATURES]


def test_ways_of_attribution_agree(table, spark, monkeypatch):
    model = models.fit(models.make_estimator(GBTClassifier(maxIter=2, maxDepth=5, seed=1)), table, FEATURES, "y")
    leaves = attribution.leaves_of(model, spark)
    x = np.random.default_rng(1).random((50, 3))
    whole = attribution.row_effects(x, attribution.stacked(leaves))
    assert np.allclose(whole, attribution.row_effects(x, attribution.stacked(leaves, 3)))
    monkeypatch.setattr(attribution, "TABLE_FEATURES", 0)
    monkeypatch.setattr(attribution, "CELLS", 10)
    assert np.allclose(whole, attribution.row_effects(x, attribution.stacked(leaves)))


def test_estimators(spark):
    made = models.make_estimator("GBTClassifier", {"n_estimators": 7, "max_depth": 4.0, "learning_rate": 0.2,
                                                   "subsample": 1, "reg_lambda": 3.0, "random_state": 5},
                                 ignore=["reg_lambda"])
    assert (made.getMaxIter(), made.getMaxDepth(), made.getStepSize(), made.getSeed()) == (7, 4, 0.2, 5)
    with pytest.raises(ValueError, match="reg_lambda"):
        models.make_estimator("GBTClassifier", {"reg_lambda": 3.0})
    with pytest.raises(ValueError, match="unsupported"):
        models.make_estimator(LogisticRegression())


def test_importances_and_tuning(spark, table):
    model = models.fit(models.make_estimator("DecisionTreeClassifier", {"max_depth": 3}), table, FEATURES, "y")
    got = models.importances(model, table, FEATURES).collect()
    assert sum(r["importance"] for r in got) == pytest.approx(1) and [r["feature"] for r in got] == FEATURES
    trials = spark.createDataFrame([(0, 1), (1, 4)], "trial long, max_depth int")
    scores = models.tune(table, FEATURES, "y", trials, "DecisionTreeClassifier", folds=3).collect()
    assert {(r["trial"], r["fold"]) for r in scores} == {(t, f) for t in (0, 1) for f in range(3)}
    assert all(0 <= r["macro_f1"] <= 1 for r in scores)


@pytest.fixture(scope="module")
def blobs(spark):
    """Three groups of points, and one point on its own."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(10 * (i % 3), 0.5, 2)], i % 3) for i in range(90)]
    return spark.createDataFrame([*rows, (90, [50.0, 50.0], 3)], "idx long, point array<double>, cluster int").cache()


def brute_silhouette(rows, distance):
    total = 0.0
    for i, p, c in rows:
        means = {}
        for k in {r[2] for r in rows}:
            others = [distance(p, q) for j, q, d in rows if d == k and j != i]
            means[k] = sum(others) / len(others) if others else None
        if means[c] is None:
            continue
        b = min(v for k, v in means.items() if k != c)
        total += (b - means[c]) / max(means[c], b)
    return total / len(rows)


def test_silhouette(blobs):
    rows = [(r["idx"], np.array(r["point"]), r["cluster"]) for r in blobs.collect()]
    assert representatives.silhouette(blobs) == pytest.approx(
        brute_silhouette(rows, lambda a, b: float(((a - b) ** 2).sum())), abs=1e-9)


@pytest.mark.parametrize("rows", [9_999, 10_001])
def test_one_measure_at_every_size(spark, rows, monkeypatch):
    points = spark.range(rows).select(F.col("id").alias("idx"), F.array(
        (F.col("id") % 3 * 10).cast("double") + F.col("id") / rows).alias("point"))
    seen, measure = [], representatives.silhouette
    monkeypatch.setattr(representatives, "silhouette", lambda df: seen.append(measure(df)) or seen[-1])
    scores = {r["k"]: r["silhouette"] for r in representatives.choose_k(points, 4).collect()}
    assert sorted(seen) == sorted(scores.values()) and representatives.best_k(scores) == 3


def test_diverse_examples(spark, blobs):
    wide = blobs.filter("cluster < 3").select("idx", F.col("point")[0].alias("f"), F.col("point")[1].alias("g"))
    got = representatives.diverse_examples(wide).collect()
    assert len(got) == 3
    assert {r["idx"] % 3 for r in got} == {0, 1, 2}
    with pytest.raises(KeyError, match="idx"):
        representatives.diverse_examples(wide.withColumnRenamed("idx", "i"))


def test_rows_alike_are_clustered_once(spark, monkeypatch):
    """Points of weights are grouped and scored as so many rows; a point has its smallest key, a single row no silhouette."""
    places = [(float(x + 30 * g), float(y)) for g in range(3) for x in range(2) for y in range(2)] + [(500.0, 0.0)]
    rows = [(i * 100 + j, a, b) for i, (a, b) in enumerate(places) for j in range(1 if a == 500 else 3 + i)]
    wide = spark.createDataFrame(rows, "idx long, f double, g double")
    points = representatives.as_points(wide, ["f", "g"])
    assert representatives.alike_once(points).columns == ["idx", "point"]
    monkeypatch.setattr(representatives, "LEAST_POINTS", 13)
    seen = []
    plain = representatives.fit_clusters
    monkeypatch.setattr(representatives, "fit_clusters", lambda p, *a: seen.append(p.count()) or plain(p, *a))
    got = representatives.diverse_examples(wide).collect()
    assert set(seen) == {len(places)} and len(seen) > 2 and all(r["idx"] % 100 == 0 for r in got)
    once = representatives.alike_once(points)
    assert sorted((r["idx"], r["weight"]) for r in once.collect()) == [(i * 100, 1.0 if i == 12 else 3.0 + i) for i in range(13)]
    for k in (2, 4):
        clustered = plain(once, k)[0]
        labels = points.join(clustered.select("point", "cluster"), "point")
        assert representatives.silhouette(clustered) == pytest.approx(representatives.silhouette(labels.select("point", "cluster")), abs=1e-9)
    unlike = spark.range(9).select(F.col("id").alias("idx"), F.array((F.col("id") - F.col("id") % 2 * F.col("id") / 9).cast("double")).alias("point"))
    assert representatives.alike_once(unlike).columns == ["idx", "point"]


def test_few_rows_give_two_clusters(spark):
    rows = spark.createDataFrame([(0, 0.0), (1, 0.1), (2, 9.0)], "idx long, f double")
    assert len(representatives.diverse_examples(rows).collect()) == 2


def test_medoid_ties_go_to_the_smallest_key(spark):
    points = spark.createDataFrame([(2, [1.0], 0), (1, [-1.0], 0), (3, [5.0], 1)],
                                   "idx long, point array<double>, cluster int")
    got = representatives.medoids_of(points, [np.array([0.0]), np.array([5.0])]).collect()
    assert [(r["cluster"], r["idx"], r["distance"]) for r in got] == [(0, 1, 1.0), (1, 3, 0.0)]


def test_rows_alike_are_attributed_and_learned_once(table, spark, monkeypatch):
    """A table repeated five times gives the same boosted model and numbers; each kind of row is worked on once."""
    many = table.crossJoin(spark.range(5).select(F.col("id").alias("copy"))).withColumn("idx", F.col("idx") * 5 + F.col("copy")).drop("copy")
    written = {}
    plain = attribution.cut_lineage
    monkeypatch.setattr(attribution, "cut_lineage", lambda df, label: written.setdefault(label, plain(df, label)))
    monkeypatch.setattr(models, "cut_lineage", lambda df, label: written.setdefault(label, plain(df, label)))
    model = models.fit(models.make_estimator("GBTClassifier", {"n_estimators": 2, "max_depth": 2}), many, FEATURES, "y")
    leaves = attribution.leaves_of(model, spark)
    got = attribution.attributions(model, many, FEATURES, leaves=leaves).orderBy("idx").collect()
    assert written["weighted"].agg(F.sum("weight"), F.count("weight")).first()[0] == 2000
    assert written["weighted"].count() <= 400 and written["attributed-kinds"].count() < 400
    rows = many.orderBy("idx").select(*[F.col(c).cast("double") for c in FEATURES]).collect()
    assert np.allclose([r[1:] for r in got], attribution.row_effects(np.array(rows), attribution.stacked(leaves)), atol=1e-12)
    every = models.make_estimator("GBTClassifier", {"n_estimators": 2, "max_depth": 2}).fit(
        models.with_vector(many, FEATURES, "y").select("features", "label"))
    gaps = attribution.margins(model, many, FEATURES).join(attribution.margins(every, many, FEATURES).withColumnRenamed("margin", "m"), "idx")
    assert gaps.agg(F.max(F.abs(F.col("margin") - F.col("m")))).first()[0] < 1e-9
