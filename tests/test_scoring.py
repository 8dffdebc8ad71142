"""Scores against plain Python."""

import math

import pytest

from tessera.operators import joins, reports, scoring


def brute_f1(pairs):
    labels = {v for p in pairs for v in p}
    scores = []
    for k in labels:
        tp = sum(y == p == k for y, p in pairs)
        scores.append(2 * tp / (sum(y == k for y, _ in pairs) + sum(p == k for _, p in pairs)))
    return sum(scores) / len(scores)


@pytest.fixture
def pairs():
    return [(i % 2, (i * 7 % 5) % 3 - 1) for i in range(97)] + [(1, 7)]


def test_macro_f1_counts_every_label(spark, pairs):
    cells = scoring.confusion(spark.createDataFrame(pairs, "y long, prediction long"))
    assert scoring.macro_f1(cells).first()["macro_f1"] == pytest.approx(brute_f1(pairs), abs=1e-12)
    right = sum(y == p for y, p in pairs) / len(pairs)
    assert scoring.accuracy(cells).first()["accuracy"] == pytest.approx(right)


def test_evaluate_groups(spark, pairs):
    rows = [("a", *p) for p in pairs] + [("b", 1, 1), ("b", 0, 0)]
    got = {r["strategy"]: r for r in
           scoring.evaluate(spark.createDataFrame(rows, "strategy string, y long, prediction long"), ["strategy"]).collect()}
    assert got["a"]["macro_f1"] == pytest.approx(brute_f1(pairs)) and got["a"]["n"] == len(pairs)
    assert (got["b"]["accuracy"], got["b"]["macro_f1"], got["b"]["n"]) == (1.0, 1.0, 2)


def test_mcnemar(spark):
    # 10 rows only the first has right, 3 only the second
    rows = [(1, 1, 1)] * 5 + [(1, 1, 0)] * 10 + [(1, 0, 1)] * 3 + [(1, 0, 0)] * 2
    got = scoring.mcnemar(spark.createDataFrame(rows, "y long, p1 long, p2 long")).first()
    assert (got["a"], got["b"], got["c"], got["d"]) == (5, 10, 3, 2)
    assert got["statistic"] == pytest.approx(36 / 13)
    assert got["p_value"] == pytest.approx(math.erfc(math.sqrt(36 / 26))) and not got["significant"]
    far = scoring.mcnemar(spark.createDataFrame([(1, 1, 0)] * 20, "y long, p1 long, p2 long")).first()
    assert far["significant"] and far["statistic"] == pytest.approx(19 * 19 / 20)
    none = scoring.mcnemar(spark.createDataFrame([(1, 1, 1)], "y long, p1 long, p2 long")).first()
    assert none["statistic"] is None and none["p_value"] is None


def test_fold_summary_and_best_trial(spark):
    folds = [(0, 0, 0.5, 0.4), (0, 1, 0.7, 0.6), (1, 0, 0.9, 0.5), (1, 1, 0.5, 0.5), (2, 0, 0.1, 0.2)]
    summary = scoring.fold_summary(spark.createDataFrame(folds, "trial long, fold int, accuracy double, macro_f1 double"))
    got = {r["trial"]: r for r in summary.collect()}
    assert got[0]["accuracy"] == pytest.approx(0.6) and got[0]["accuracy_std"] == pytest.approx(0.1)
    # trials 0 and 1 tie on macro-F1
    assert scoring.best_trial(summary).first()["trial"] == 0
    assert scoring.best_trial(summary, goal="minimize").first()["trial"] == 2


def test_judge_means_count_what_is_missing(spark):
    scores = spark.createDataFrame([(1, {"faithfulness": 4.0, "consistency": 3.0}), (2, {"faithfulness": 5.0})],
                                   "idx long, metrics map<string,double>")
    got = {r["metric"]: (r["score"], r["present"], r["missing"]) for r in scoring.judge_means(scores).collect()}
    assert got == {"faithfulness": (4.5, 2, 0), "consistency": (3.0, 1, 1), "coherence": (None, 0, 2)}


def test_key_joins(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "idx long, v string")
    keys = spark.createDataFrame([(3, 0), (1, 1)], "idx long, pos int")
    assert [r["v"] for r in joins.select_rows_ordered(df, keys).collect()] == ["c", "a"]
    assert {r["idx"] for r in joins.select_rows(df, keys).collect()} == {1, 3}
    joins.require_keys(df, keys)
    with pytest.raises(KeyError, match="9"):
        joins.require_keys(df, spark.createDataFrame([(9,)], "idx long"))


def test_reports(spark):
    docs = spark.createDataFrame(
        [("titanic", False, "tree-model", 0.748), ("titanic", False, "zero-shot-prompting", 0.755),
         ("titanic", True, "zero-shot-prompting", 0.577), ("loan", False, "tree-model", 0.973)],
        "dataset string, masked boolean, strategy string, macro_f1 double")
    flat = reports.flat_scores(docs)
    wide = reports.approach_table(flat, ["titanic", "masked_titanic"], ["tree-model", "baseline"])
    assert {tuple(r) for r in wide.collect()} == {("titanic", 0.748, 0.755), ("masked_titanic", None, 0.577)}
    long = {tuple(r) for r in reports.long_table(wide, ["tree-model", "baseline"]).collect()}
    assert long == {("Titanic", "Tree Model", 0.748), ("Titanic", "Baseline", 0.755), ("Masked_Titanic", "Baseline", 0.577)}
    effect = reports.mask_effect(flat).first()
    assert (effect["dataset"], effect["approach"]) == ("titanic", "baseline")
    assert effect["delta"] == pytest.approx(-0.178)
    assert reports.rounded(spark.createDataFrame([(4.625,)], "x double"), ["x"], 2).first()["x"] == 4.62
