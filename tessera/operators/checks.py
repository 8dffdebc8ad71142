"""Contracts that input tables and judge scores must meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import JUDGE_METRICS


def dataset_contract(df: DataFrame, target: str, labels: list[int], key: str = "idx") -> DataFrame:
    """One row of counts: rows, distinct keys, null targets, rows of each label and of none."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    if len(set(labels)) != 2:
        raise ValueError("labels must have exactly 2 entries (binary classification)")
    y = F.col(f"`{target}`")
    first, second = sorted(labels)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"),
                  F.count_if(y.isNull()).alias("null_targets"),
                  F.count_if(y == first).alias("first_label"),
                  F.count_if(y == second).alias("second_label"),
                  F.count_if(y.isNotNull() & ~y.isin(first, second)).alias("other_labels"))


def require_dataset(df: DataFrame, target: str, labels: list[int], key: str = "idx") -> None:
    """Raise when keys repeat, or targets are null or outside the labels."""
    found = dataset_contract(df, target, labels, key).first()
    if found["keys"] != found["rows"] or found["null_targets"] or found["other_labels"]:
        raise ValueError(f"dataset contract broken: {found.asDict()}")


def score_contract(scores: DataFrame, low: float = 1.0, high: float = 5.0,
                   step: float = 0.25) -> DataFrame:
    """One row of counts: rows, rows short of a metric, out of range and off the step."""
    values = F.array(*[F.try_element_at("metrics", F.lit(m)) for m in JUDGE_METRICS])
    present = F.filter(values, lambda v: v.isNotNull())
    return scores.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.size(present) < len(JUDGE_METRICS)).alias("incomplete"),
        F.count_if(F.exists(present, lambda v: (v < low) | (v > high))).alias("out_of_range"),
        F.count_if(F.exists(present, lambda v: v / step != F.floor(v / step))).alias("off_step"))
