"""Attributions of models that split features by sets of categories."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from tessera.operators import attribution, models

FEATURES = ["a", "b", "c"]
KINDS = {"a": 6, "b": 9}


@pytest.fixture(scope="module")
def table(spark):
    u = [F.pmod(F.xxhash64("id", F.lit(s)), F.lit(720)) for s in range(3)]
    df = spark.range(500).select(F.col("id").alias("idx"), (u[0] % 6).alias("a"), (u[1] % 9).alias("b"), (u[2] / 720).alias("c"))
    y = F.col("a").isin(0, 3, 5) != (F.col("b").isin(1, 2, 7) & (F.col("c") > 0.4))
    return df.withColumn("y", y.cast("int")).cache()


def walked(met, leaf):
    """Shapley values of a leaf's game over all coalitions."""
    d = len(leaf.features)
    out = np.zeros(d)

    def pay(coalition):
        return leaf.value * np.prod([float(met[i]) if i in coalition else leaf.share[i] for i in range(d)])
    for j in range(d):
        rest = [i for i in range(d) if i != j]
        for size in range(d):
            for s in itertools.combinations(rest, size):
                out[j] += math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d) * (pay({*s, j}) - pay(set(s)))
    return out


@pytest.mark.parametrize("kind, settings", [
    (GBTClassifier, dict(maxIter=3, maxDepth=4, seed=1)), (RandomForestClassifier, dict(numTrees=5, maxDepth=6, seed=1)),
    (DecisionTreeClassifier, dict(maxDepth=5))])
def test_add_up(spark, table, kind, settings):
    model = models.fit(models.make_estimator(kind(**settings)), table, FEATURES, "y", KINDS)
    leaves = attribution.leaves_of(model, spark)
    assert any(leaf.sets for leaf in leaves) and all(set(leaf.sets) <= {0, 1} for leaf in leaves)
    got = {r["idx"]: [r[c] for c in FEATURES] for r in attribution.attributions(model, table, FEATURES, leaves=leaves).collect()}
    base = attribution.base_value(leaves)
    for r in attribution.margins(model, table, FEATURES).collect():
        assert math.isclose(sum(got[r["idx"]]) + base, r["margin"], abs_tol=1e-9)
    for r in table.filter("idx < 20").collect():
        want = np.zeros(3)
        for leaf in leaves:
            met = [leaf.sets[f][r[FEATURES[f]]] if f in leaf.sets else low < r[FEATURES[f]] <= high
                   for f, low, high in zip(leaf.features, leaf.low, leaf.high)]
            np.add.at(want, leaf.features, walked(met, leaf))
        assert np.allclose(got[r["idx"]], want, atol=1e-9)


def test_unknown_categories(spark, table):
    """Categories that no tree knows go the same way in the model and in its attributions."""
    model = models.fit(models.make_estimator(RandomForestClassifier(numTrees=4, maxDepth=4, seed=2)), table, FEATURES, "y", KINDS)
    leaves = attribution.leaves_of(model, spark)
    strange = table.filter("idx < 30").withColumn("a", F.lit(40)).withColumn("b", F.lit(2.5))
    total = F.col("a") + F.col("b") + F.col("c") + attribution.base_value(leaves)
    gaps = attribution.attributions(model, strange, FEATURES, leaves=leaves).join(attribution.margins(model, strange, FEATURES), "idx")
    assert gaps.agg(F.max(F.abs(total - F.col("margin")))).first()[0] < 1e-9
