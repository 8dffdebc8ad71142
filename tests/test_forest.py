"""Random forest from cells of rows alike."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import attribution, forest, models
from tessera.operators.forest import RandomForest
from tessera.plans.explain import explain
from tests.test_adaboost import FEATURES, table


def test_forest(spark):
    """Learns, does not depend on how rows lie, and attributions add up."""
    frame, x, y = table(spark)
    made = [models.fit(RandomForest(n_estimators=8, max_depth=4), f, FEATURES, "y") for f in (frame, frame.orderBy("b").coalesce(1))]
    assert made[0].trees == made[1].trees and made[0].shares == made[1].shares
    assert len({tuple(t.cut) for t in made[0].trees}) > 1 and sum(made[0].featureImportances.toArray()) == pytest.approx(1)
    got = models.predict(made[0], frame, FEATURES, ["idx"]).collect()
    assert np.mean([y[r["idx"]] == r["prediction"] for r in got]) > max(np.mean(y), 1 - np.mean(y)) + 0.1
    drawn = [t.rows[0] for t in made[0].trees]
    assert abs(np.mean(drawn) - len(y)) < 4 * (len(y) / 8) ** 0.5 and len(set(drawn)) > 1
    leaves = attribution.leaves_of(made[0], spark)
    parts = attribution.attributions(made[0], frame, FEATURES, leaves=leaves)
    total = sum((F.col(c) for c in FEATURES), F.lit(attribution.base_value(leaves)))
    gaps = parts.join(attribution.margins(made[0], frame, FEATURES), "idx").agg(F.max(F.abs(total - F.col("margin"))), F.count("idx"))
    gap, n = gaps.first()
    assert gap < 1e-9 and n == len(y)


def test_one_tree_of_all_features_is_the_plain_best_cut(spark):
    """Without other features to try and with every row alike in number, the root cuts where Gini falls most."""
    frame, _, _ = table(spark)
    one = frame.select(F.col("b").alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), "y")
    many = one.crossJoin(spark.range(200).select("id")).drop("id")
    model = models.fit(RandomForest(n_estimators=1, max_depth=1), many, FEATURES, "y")
    rows = one.select("a", "y").collect()

    def impurity(cut):
        sides = [[r["y"] for r in rows if (r["a"] <= cut) == s] for s in (True, False)]
        return sum(2 * np.mean(s) * (1 - np.mean(s)) * len(s) for s in sides if s)
    assert model.trees[0].cut[0] == min(sorted({r["a"] for r in rows})[:-1], key=impurity)


def test_tuning_reads_cells(spark, monkeypatch):
    """The folded table has no more cells than rows unlike each other in a fold; all rows are scored."""
    sizes = []
    plain = models.cells_of
    monkeypatch.setattr(models, "cells_of", lambda *a: sizes.append(plain(*a)) or sizes[-1])
    frame, _, _ = table(spark, n=60)
    often = frame.crossJoin(spark.range(20).select("id")).withColumn("idx", F.col("idx") * 20 + F.col("id")).drop("id")
    trials = spark.createDataFrame([(0, 1), (1, 3)], "trial long, n_estimators int")
    got = models.tune(often, FEATURES, "y", trials, "RandomForest", folds=2).collect()
    assert {(r["trial"], r["fold"]) for r in got} == {(t, f) for t in (0, 1) for f in (0, 1)}
    assert all(0.5 < r["accuracy"] <= 1 for r in got) and sizes[0].count() <= 120
    assert sizes[0].agg(F.sum("n")).first()[0] == 1200


def test_folds_grow_together(spark, monkeypatch):
    """Without a fold as from the cells of the others; the fits of all folds draw at once unless their histograms are large."""
    written = []
    plain = forest.cut_lineage
    monkeypatch.setattr(forest, "cut_lineage", lambda df, label: written.append(label) or plain(df, label))
    frame, _, _ = table(spark)
    found = models.folded_cells(frame, FEATURES, "y", "RandomForest", 3)
    assert written == ["forest-cells"]
    for one in (RandomForest(n_estimators=5, max_depth=3, subsample=0.7), RandomForest(n_estimators=34, max_depth=1)):
        alone = [one.grow(found.cells.filter(F.col("fold") != f).groupBy("bins", "y").agg(F.sum("n").alias("n")), found.cuts, 2) for f in range(3)]
        for size, writes in ((forest.HISTOGRAM_BYTES, 1), (1, 3)):
            monkeypatch.setattr(forest, "HISTOGRAM_BYTES", size)
            written.clear()
            got = one.grow_without(found.cells, found.cuts, 2, 3)
            assert len(written) == writes * -(-one.n_estimators // forest.TOGETHER)
            assert [(m.trees, m.shares, m.gains) for m in got] == [(m.trees, m.shares, m.gains) for m in alone]
        monkeypatch.undo()
        monkeypatch.setattr(forest, "cut_lineage", lambda df, label: written.append(label) or plain(df, label))


def test_explain_reads_cells_once(spark, monkeypatch):
    """The fit of the best trial learns what it learns from the rows, and takes the cells that tuning has made."""
    frame, _, _ = table(spark)
    sizes = []
    plain = models.cells_of
    monkeypatch.setattr(models, "cells_of", lambda *a: sizes.append(plain(*a)) or sizes[-1])
    monkeypatch.setattr(forest, "cells_of", lambda *a: sizes.append(plain(*a)) or sizes[-1])
    explain(frame, "y", {"n_estimators": {"values": [2, 3]}, "max_depth": {"value": 2}}, "RandomForest", n_trials=2, folds=2)
    assert len(sizes) == 1
    one = RandomForest(n_estimators=3, max_depth=3)
    given = models.fit(one, frame, FEATURES, "y", cells=models.folded_cells(frame, FEATURES, "y", one))
    read = models.fit(one, frame, FEATURES, "y")
    assert (given.trees, given.shares, given.gains) == (read.trees, read.shares, read.gains)
    none = models.folded_cells(frame.filter("false"), FEATURES, "y", one)
    assert models.fit(one, frame, FEATURES, "y", cells=none).trees == []
