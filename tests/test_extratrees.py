"""Extremely randomised trees against a plain version of the same definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import attribution, extratrees, models
from tessera.operators.extratrees import ExtraTrees
from tests.test_adaboost import FEATURES, table


def plain(x, y, forest, classes):
    """Mean shares of classes by row, from definitions."""
    total = np.zeros((len(y), classes))

    def grow(tree, node, rows, depth):
        n = np.bincount(y[rows], minlength=classes).astype(float)
        best = (0.0, None)
        if depth < forest.max_depth and (n > 0).sum() > 1:
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            for f, cut in forest.candidates(tree, node, list(low), list(high)):
                assert low[f] <= cut < high[f]
                one, two = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(one), len(two)) < forest.min_child_weight:
                    continue
                sides = sum((np.bincount(y[s]) ** 2).sum() / len(s) for s in (one, two))
                gain = round(sides - (n ** 2).sum() / n.sum(), 9)
                if gain > best[0]:
                    best = (gain, (one, two))
        if best[1] is None:
            total[rows] += n / n.sum()
            return
        for i, side in enumerate(best[1]):
            grow(tree, 2 * node + 1 + i, side, depth + 1)
    for tree in range(forest.n_estimators):
        grow(tree, 0, np.arange(len(y)), 0)
    return total / forest.n_estimators


def scores(model, frame):
    found = model.transform(models.with_vector(frame, FEATURES)).select("idx", "scores", "prediction").collect()
    assert all(r["scores"][int(r["prediction"])] == max(r["scores"]) for r in found)
    return np.array([r["scores"] for r in sorted(found)])


@pytest.mark.parametrize("classes, params", [
    (2, {"n_estimators": 5, "max_depth": 4}), (3, {"n_estimators": 3, "max_depth": 5, "max_features": 3}),
    (2, {"n_estimators": 3, "max_depth": 6, "min_child_weight": 12, "random_state": 7, "max_features": 2})])
def test_equals_plain(spark, monkeypatch, classes, params):
    monkeypatch.setattr(extratrees, "TOGETHER", 2)
    frame, x, y = table(spark, classes)
    forest = models.make_estimator("ExtraTrees", params)
    model = forest.fit(models.with_vector(frame, FEATURES, "y"))
    assert np.allclose(scores(model, frame), plain(x, y, forest, classes), atol=1e-12)


def test_same_on_any_partitioning(spark):
    made = []
    for parts in (1, 7):
        frame, _, _ = table(spark, parts=parts)
        made.append(ExtraTrees(n_estimators=3, max_depth=4).fit(models.with_vector(frame, FEATURES, "y")))
    assert made[0] == made[1]


def test_attributions_and_importances(spark):
    frame, _, y = table(spark)
    model = models.fit(ExtraTrees(n_estimators=4, max_depth=4), frame, FEATURES, "y")
    leaves = attribution.leaves_of(model, spark)
    parts = {r["idx"]: sum(r[c] for c in FEATURES) for r in attribution.attributions(model, frame, FEATURES).collect()}
    for r in attribution.margins(model, frame, FEATURES).collect():
        assert math.isclose(parts[r["idx"]] + attribution.base_value(leaves), r["margin"], abs_tol=1e-9)
    assert math.isclose(attribution.base_value(leaves), y.mean(), abs_tol=1e-9)  # covers are rows
    shares = [r["importance"] for r in models.importances(model, frame, FEATURES).collect()]
    assert math.isclose(sum(shares), 1) and shares[0] == max(shares)


def test_tuning_takes_both(spark):
    frame, _, _ = table(spark, n=150)
    trials = spark.createDataFrame([(0, 2, 1.0), (1, 4, 0.5)], "trial bigint, n_estimators int, reg_lambda double")
    for kind in ("ExtraTrees", "AdaBoost"):
        found = models.tune(frame, FEATURES, "y", trials, kind, folds=2, ignore=["reg_lambda"]).collect()
        assert len(found) == 4 and np.mean([r["accuracy"] for r in found]) > 0.6
        with pytest.raises(ValueError, match="reg_lambda"):
            models.make_estimator(kind, {"reg_lambda": 1.0})


def test_edges(spark):
    rows = [(i, float("nan") if i % 3 == 0 else 1.0, float(i % 2), 5.0, i % 2) for i in range(60)]
    frame = models.with_vector(spark.createDataFrame(rows, "idx long, a double, b double, c double, y int"), FEATURES, "y")
    model = ExtraTrees(n_estimators=4, max_depth=3, max_features=3).fit(frame)
    assert all(r["prediction"] == r["y"] for r in model.transform(frame).collect())
    assert ExtraTrees().fit(frame.limit(0)).trees == []
    root = ExtraTrees(n_estimators=2, max_depth=0).fit(frame.filter("idx < 59"))  # 30 of class 0, 29 of class 1
    assert {tuple(r["scores"]) for r in root.transform(frame).collect()} == {(30 / 59, 29 / 59)}
    half = ExtraTrees(n_estimators=1, max_depth=0).fit(frame.withColumn("label", F.when(F.col("idx") < 30, F.col("label"))))
    assert half.trees[0].rows[0] == 30


def test_rows_alike_are_one(spark, monkeypatch):
    """A table repeated nine times gives the same model, from no more rows than the table has."""
    held = []
    monkeypatch.setattr(extratrees, "cut_lineage", lambda df, label: held.append(df.localCheckpoint()) or held[-1])
    frame, x, y = table(spark)
    often = frame.crossJoin(spark.range(9).select("id")).drop("id")
    made = [models.fit(ExtraTrees(n_estimators=1, max_depth=2), f, FEATURES, "y") for f in (frame, often)]
    assert made[0].shares == made[1].shares and made[0].trees[0].cut == made[1].trees[0].cut
    assert held[1].count() == held[0].count() == len({(*r, v) for r, v in zip(x.tolist(), y.tolist())})
