"""Boosting by reweighted rows against a plain numpy version of the same definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import adaboost, attribution, models
from tessera.operators.adaboost import AdaBoost
from tessera.operators.trees import bin_cuts

FEATURES = ["a", "b", "c"]


def table(spark, classes=2, n=300, parts=4):
    rng = np.random.default_rng(5)
    x = np.c_[rng.normal(size=n).round(2), rng.integers(0, 6, n), rng.random(n).round(3)]
    y = np.clip(np.floor((x[:, 0] + (x[:, 1] > 3) + rng.normal(0, 0.6, n)) * classes / 2 + 0.3), 0, classes - 1).astype(int)
    rows = [(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "idx long, a double, b double, c double, y int").repartition(parts), x, y


def plain(x, y, cuts, boost, classes):
    """Votes and errors of the rounds, and shares of votes by row and class."""
    w, given, votes, errors = np.full(len(y), 1 / len(y)), np.zeros((len(y), classes)), [], []
    for _ in range(boost.n_estimators):
        said = np.zeros(len(y), dtype=int)

        def purity(rows):
            return sum(w[rows][y[rows] == c].sum() ** 2 for c in range(classes)) / w[rows].sum()

        def grow(rows, depth):
            best = (0.0, None)
            for f in range(x.shape[1]) if depth < boost.max_depth else ():
                for cut in cuts[f]:
                    one, two = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if len(one) and len(two):
                        gain = round(purity(one) + purity(two) - purity(rows), 9)
                        if gain > best[0]:
                            best = (gain, (one, two))
            if best[1] is None:
                said[rows] = np.argmax([round(w[rows][y[rows] == c].sum(), 9) for c in range(classes)])
                return
            for side in best[1]:
                grow(side, depth + 1)
        grow(np.arange(len(y)), 0)
        error = w[said != y].sum()
        if error >= 1 - 1 / classes - 1e-9 and votes:
            break
        vote = boost.learning_rate * (math.log((1 - error) / error) + math.log(classes - 1))
        w = w * np.where(said != y, math.exp(vote), 1)
        w /= w.sum()
        given[np.arange(len(y)), said] += vote
        votes.append(vote)
        errors.append(error)
    return votes, errors, given / sum(votes)


@pytest.mark.parametrize("classes, params, every", [
    (2, {"n_estimators": 5}, 2), (3, {"n_estimators": 3, "learning_rate": 0.5}, 8), (3, {"num_boost_round": 2, "max_depth": 3}, 8)])
def test_equals_plain(spark, monkeypatch, classes, params, every):
    monkeypatch.setattr(adaboost, "WRITE_EVERY", every)
    frame, x, y = table(spark, classes)
    boost = models.make_estimator(AdaBoost(max_bins=16), params)
    rows = models.with_vector(frame, FEATURES, "y")
    model = boost.fit(rows)
    votes, errors, shares = plain(x, y, bin_cuts(rows.select(F.array(*FEATURES).alias("x")), 3, 16), boost, classes)
    assert np.allclose(model.votes, votes, atol=1e-8) and np.allclose(model.errors, errors, atol=1e-9)
    found = sorted(model.transform(rows).select("idx", "scores", "prediction").collect())
    assert np.allclose([r["scores"] for r in found], shares, atol=1e-8)
    assert all(r["scores"][int(r["prediction"])] == max(r["scores"]) for r in found)


def test_same_on_any_partitioning(spark):
    made = []
    for parts in (1, 7):
        frame, _, _ = table(spark, parts=parts)
        made.append(models.make_estimator("AdaBoost", {"n_estimators": 10}).fit(models.with_vector(frame, FEATURES, "y")))
    assert np.allclose(made[0].votes, made[1].votes) and [t.feature for t in made[0].trees] == [t.feature for t in made[1].trees]


def test_attributions_and_importances(spark):
    frame, _, _ = table(spark)
    model = models.fit(models.make_estimator("AdaBoost", {"n_estimators": 5, "max_depth": 2}), frame, FEATURES, "y")
    leaves = attribution.leaves_of(model, spark)
    parts = {r["idx"]: sum(r[c] for c in FEATURES) for r in attribution.attributions(model, frame, FEATURES).collect()}
    for r in attribution.margins(model, frame, FEATURES).collect():
        assert math.isclose(parts[r["idx"]] + attribution.base_value(leaves), r["margin"], abs_tol=1e-9)
    shares = [r["importance"] for r in models.importances(model, frame, FEATURES).collect()]
    assert math.isclose(sum(shares), 1) and shares[0] == max(shares)


def test_early_ends(spark):
    rows = [(i, float("nan") if i % 3 == 0 else 1.0, float(i % 2), 5.0, i % 2) for i in range(60)]
    frame = models.with_vector(spark.createDataFrame(rows, "idx long, a double, b double, c double, y int"), FEATURES, "y")
    model = AdaBoost().fit(frame)
    assert model.errors == [0.0] and model.votes == [1.0]
    assert all(r["prediction"] == r["y"] for r in model.transform(frame).collect())
    constant = models.with_vector(frame.drop("features"), ["c"], "y")  # one value, classes of equal size
    guess = AdaBoost().fit(constant)
    assert guess.votes == [1.0] and {r["prediction"] for r in guess.transform(constant).collect()} == {0.0}
    empty = AdaBoost().fit(frame.limit(0))
    assert empty.trees == [] and {r["prediction"] for r in empty.transform(frame).collect()} == {0.0}
    unlabelled = AdaBoost().fit(frame.withColumn("label", F.when(F.col("idx") < 30, F.col("label"))))
    assert unlabelled.errors == [0.0]
    with pytest.raises(ValueError, match="from 0 on"):
        AdaBoost().fit(frame.withColumn("label", F.col("label") - 1))
