"""Accuracy, macro-F1, paired tests, judge summaries and fold statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import ALPHA, JUDGE_METRICS


def confusion(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by..., y, prediction, n``: the only shuffle the label scores need, a few rows wide."""
    return scored.groupBy(*(by or []), "y", "prediction").agg(F.count(F.lit(1)).alias("n"))


def accuracy(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of correct rows and their number."""
    hit = F.sum(F.when(F.col("y") == F.col("prediction"), F.col("n")).otherwise(0))
    return cells.groupBy(*(by or [])).agg((hit / F.sum("n")).alias("accuracy"),
                                          F.sum("n").alias("n"))


def label_f1(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """F1 per label over all labels that occur as truth or as prediction."""
    by = by or []
    right = F.when(F.col("y") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("y").alias("label"), right.alias("tp"), F.col("n").alias("weight")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("tp"),
                 F.col("n").alias("weight")))
    # weight sums to support + predicted, the denominator of F1
    return (cells.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
            .groupBy(*by, "label")
            .agg((2 * F.sum("tp") / F.sum("weight")).alias("f1")))


def macro_f1(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Unweighted mean of the per-label F1."""
    return label_f1(cells, by).groupBy(*(by or [])).agg(F.avg("f1").alias("macro_f1"))


def evaluate(scored: DataFrame, by: list[str]) -> DataFrame:
    """``by..., accuracy, macro_f1, n`` of ``y, prediction`` rows in one job."""
    return evaluate_cells(confusion(scored, by), by)


def evaluate_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """The same from counted cells."""
    right = F.when(F.col("y") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("y").alias("label"), right.alias("tp"), F.col("n").alias("weight"),
                 F.col("n").alias("rows")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("tp"),
                 F.col("n").alias("weight"), F.lit(0).cast("bigint").alias("rows")))
    labels = (cells.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
              .groupBy(*by, "label")
              .agg(F.sum("tp").alias("tp"), F.sum("weight").alias("weight"), F.sum("rows").alias("rows")))
    return labels.groupBy(*by).agg(
        (F.sum("tp") / F.sum("rows")).alias("accuracy"),
        F.avg(2 * F.col("tp") / F.col("weight")).alias("macro_f1"),
        F.sum("rows").alias("n"))


def contingency(pairs: DataFrame) -> DataFrame:
    """Paired correctness of ``y, p1, p2``: both, only first, only second, neither."""
    one, two = F.col("p1") == F.col("y"), F.col("p2") == F.col("y")
    return pairs.agg(F.count_if(one & two).alias("a"), F.count_if(one & ~two).alias("b"),
                     F.count_if(~one & two).alias("c"), F.count_if(~one & ~two).alias("d"))


def mcnemar_statistic(table: DataFrame) -> DataFrame:
    """Add the continuity-corrected chi-square ``statistic``; null without discordant pairs."""
    b, c = F.col("b"), F.col("c")
    gap = F.abs(b - c) - 1
    return table.withColumn("statistic", F.when(b + c > 0, (gap * gap).cast("double") / (b + c)))


def chi2_tail(stat: Column) -> Column:
    """Upper tail of the chi-square distribution with one degree of freedom: ``erfc(sqrt(stat / 2))``.

    Below 4 the power series of the error function, above its tail's continued fraction, both to double
    precision.
    """
    x = F.sqrt(stat / 2)
    # The terms of the series are (2 x^2)^n / (1 * 3 * ... * (2 n + 1)).
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
                         lambda s, n: F.struct((s["term"] * stat / (2 * n + 1)).alias("term"),
                                               (s["total"] + s["term"] * stat / (2 * n + 1)).alias("total")))["total"]
    body = 1 - 2 / math.sqrt(math.pi) * x * F.exp(-stat / 2) * series
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), F.lit(0.0), lambda f, n: (n / 2.0) / (x + f))
    tail = F.exp(-stat / 2) / math.sqrt(math.pi) / (x + fraction)
    return F.when(stat < 4, body).otherwise(tail)


def mcnemar(pairs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """One row: ``a, b, c, d, statistic, p_value, significant``."""
    tested = mcnemar_statistic(contingency(pairs))
    tested = tested.withColumn("p_value", chi2_tail(F.col("statistic")))
    return tested.withColumn("significant", F.col("p_value") < alpha)


def score_rows(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per judge metric of ``metrics`` maps; a metric without a score has none."""
    return scores.select(*(by or []), F.explode("metrics").alias("metric", "score"))


def judge_means(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by..., metric, score, present, missing``: mean over the rows that have the metric."""
    by = by or []
    names = F.array(*[F.lit(m) for m in JUDGE_METRICS])
    rows = scores.select(*by, "metrics", F.explode(names).alias("metric"))
    value = F.try_element_at("metrics", F.col("metric"))
    return rows.groupBy(*by, "metric").agg(
        F.avg(value).alias("score"), F.count(value).alias("present"),
        F.count_if(value.isNull()).alias("missing"))


def fold_summary(folds: DataFrame, by: str = "trial") -> DataFrame:
    """Mean and population deviation of accuracy and macro-F1 over the folds of a trial."""
    return folds.groupBy(by).agg(
        F.avg("accuracy").alias("accuracy"), F.stddev_pop("accuracy").alias("accuracy_std"),
        F.avg("macro_f1").alias("f1_macro"), F.stddev_pop("macro_f1").alias("f1_macro_std"))


def best_trial(summary: DataFrame, metric: str = "f1_macro", goal: str = "maximize") -> DataFrame:
    """The row of the best trial; ties go to the lowest trial number."""
    if goal not in ("maximize", "minimize"):
        raise ValueError("goal must be 'maximize' or 'minimize'")
    value = F.col(metric) if goal == "maximize" else -F.col(metric)
    row = F.struct(*summary.columns)
    best = summary.agg(F.max_by(row, F.struct(value.alias("v"), (-F.col("trial")).alias("t"))).alias("r"))
    return best.select("r.*")
