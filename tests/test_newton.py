"""Second-order boosted trees against a plain numpy version of the same definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import attribution, models, newton
from tessera.operators.newton import NewtonBoost

FEATURES = ["a", "b", "c"]


def table(spark, n=400, parts=4):
    rng = np.random.default_rng(8)
    x = np.c_[rng.normal(size=n).round(2), rng.integers(0, 6, n), rng.random(n).round(3)]
    y = ((x[:, 0] + (x[:, 1] > 3) + rng.normal(0, 0.5, n)) > 0.5).astype(int)
    rows = [(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))]
    frame = spark.createDataFrame(rows, "idx long, a double, b double, c double, y int").repartition(parts)
    return frame, x, y


def plain(x, y, cuts, boost):
    """Margins of the rows, tree by tree, from definitions; every row takes part in every round."""
    margin = np.zeros(len(y))
    for _ in range(boost.n_estimators):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def grow(rows, depth):
            best = (0.0, None, None)
            total = g[rows].sum() ** 2 / (h[rows].sum() + boost.reg_lambda)
            for f in range(x.shape[1]) if depth < boost.max_depth else ():
                for cut in cuts[f]:
                    left = x[rows, f] <= cut
                    one, two = rows[left], rows[~left]
                    if min(h[one].sum(), h[two].sum()) < boost.min_child_weight or not len(one) or not len(two):
                        continue
                    gain = round(sum(g[s].sum() ** 2 / (h[s].sum() + boost.reg_lambda) for s in (one, two)) - total, 9)
                    if gain > best[0]:
                        best = (gain, f, cut)
            if best[1] is None:
                margin[rows] -= boost.learning_rate * g[rows].sum() / (h[rows].sum() + boost.reg_lambda)
                return
            left = x[rows, best[1]] <= best[2]
            grow(rows[left], depth + 1)
            grow(rows[~left], depth + 1)
        grow(np.arange(len(y)), 0)
    return margin


def margins(model, frame):
    found = model.transform(models.with_vector(frame, FEATURES)).select("idx", "margin", "prediction").collect()
    assert all(r["prediction"] == (r["margin"] >= 0) for r in found)
    return np.array([r["margin"] for r in sorted(found)])


@pytest.mark.parametrize("params", [
    {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3, "reg_lambda": 1.0},
    {"n_estimators": 2, "max_depth": 2, "learning_rate": 1.0, "reg_lambda": 25.0, "min_child_weight": 8}])
def test_equals_plain(spark, params):
    frame, x, y = table(spark)
    boost = NewtonBoost(max_bins=16).with_params(params)
    rows = models.with_vector(frame, FEATURES, "y")
    cuts = boost.cuts(rows.select(F.array(*FEATURES).alias("x")), 3)
    model = boost.fit(rows, key="idx")
    assert np.allclose(margins(model, frame), plain(x, y, cuts, boost), atol=1e-9)


def test_settings_change_the_model(spark):
    frame, _, y = table(spark)
    rows = models.with_vector(frame, FEATURES, "y")

    def fitted(**params):
        return margins(models.make_estimator("NewtonBoost", {"n_estimators": 3, "max_depth": 3} | params).fit(rows, key="idx"), frame)
    base = fitted()
    assert not np.allclose(base, fitted(reg_lambda=30)) and np.abs(fitted(reg_lambda=1e9)).max() < 1e-5
    assert not np.allclose(base, fitted(subsample=0.5)) and not np.allclose(base, fitted(min_child_weight=20))
    assert ((base >= 0) == y).mean() > 0.8


def test_same_on_any_partitioning(spark):
    made = []
    for parts in (1, 7):
        frame, _, _ = table(spark, parts=parts)
        boost = models.make_estimator("NewtonBoost", {"n_estimators": 3, "max_depth": 3, "subsample": 0.6, "num_boost_round": None})
        made.append(margins(boost.fit(models.with_vector(frame, FEATURES, "y"), key="idx"), frame))
    assert np.allclose(*made, atol=1e-9)


def test_attributions_and_importances(spark):
    frame, _, _ = table(spark)
    model = models.fit(models.make_estimator("NewtonBoost", {"n_estimators": 3, "max_depth": 3}), frame, FEATURES, "y")
    leaves = attribution.leaves_of(model, spark)
    parts = {r["idx"]: sum(r[c] for c in FEATURES) for r in attribution.attributions(model, frame, FEATURES).collect()}
    base = attribution.base_value(leaves)
    for r in attribution.margins(model, frame, FEATURES).collect():
        assert math.isclose(parts[r["idx"]] + base, r["margin"], abs_tol=1e-9)
    shares = [r["importance"] for r in models.importances(model, frame, FEATURES).collect()]
    assert math.isclose(sum(shares), 1) and shares[0] == max(shares)


def test_tuning_takes_it(spark):
    frame, _, _ = table(spark, n=150)
    trials = spark.createDataFrame([(0, 2, 1.0), (1, 2, 1e9)], "trial bigint, n_estimators int, reg_lambda double")
    found = models.tune(frame, FEATURES, "y", trials, "NewtonBoost", folds=2).collect()
    mean = {t: np.mean([r["accuracy"] for r in found if r["trial"] == t]) for t in (0, 1)}
    assert len(found) == 4 and mean[0] > 0.6


def test_missing_and_single_values(spark):
    rows = [(i, float("nan") if i % 3 == 0 else 1.0, float(i % 2), 5.0, i % 2) for i in range(60)]
    frame = spark.createDataFrame(rows, "idx long, a double, b double, c double, y int")
    model = NewtonBoost(n_estimators=2, max_depth=2).fit(models.with_vector(frame, FEATURES, "y"))
    assert all((m >= 0) == bool(i % 2) for i, m in enumerate(margins(model, frame)))
    assert NewtonBoost(n_estimators=2).fit(models.with_vector(frame.limit(0), FEATURES, "y")).trees == []


def test_unknown_parameter():
    with pytest.raises(ValueError, match="gamma"):
        models.make_estimator("NewtonBoost", {"gamma": 1})
    assert models.make_estimator("NewtonBoost", {"gamma": 1, "max_depth": 2.0}, ignore=["gamma"]).max_depth == 2


def test_rounds_read_cells(spark, monkeypatch):
    """A round's table has a row for each cell of bins and label, however often rows are repeated."""
    held = []

    def kept(df, label):
        held.append((label, df.localCheckpoint()))
        return held[-1][1]
    monkeypatch.setattr(newton, "cut_lineage", kept)
    frame, _, _ = table(spark)
    often = frame.crossJoin(spark.range(9).select("id")).withColumn("idx", F.col("idx") * 9 + F.col("id")).drop("id")
    NewtonBoost(n_estimators=1, max_depth=1, subsample=0.9).fit(models.with_vector(often, FEATURES, "y"), key="idx")
    sizes = {label: df.count() for label, df in held}
    assert sizes["newton-rows"] == 3600 and sizes["newton-round"] <= 400 and sizes["newton-drawn"] <= 400
