"""Row selection and lookups by the row key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_rows(df: DataFrame, keys: DataFrame, key: str = "idx") -> DataFrame:
    """Rows whose key occurs in ``keys``, however often."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def select_rows_ordered(df: DataFrame, keys: DataFrame, key: str = "idx",
                        position: str = "pos") -> DataFrame:
    """Rows in the order that ``keys`` (``key``, ``position``) lists them."""
    return df.join(keys.select(key, position), key).orderBy(position)


def missing_keys(df: DataFrame, keys: DataFrame, key: str = "idx") -> DataFrame:
    """Keys that have no row in ``df``, once each."""
    return keys.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")


def require_keys(df: DataFrame, keys: DataFrame, key: str = "idx") -> None:
    """Raise ``KeyError`` when a key has no row."""
    sample = [r[key] for r in missing_keys(df, keys, key).limit(5).collect()]
    if sample:
        raise KeyError(f"{key} without a row: {sample}")


def attach(df: DataFrame, other: DataFrame, key: str = "idx") -> DataFrame:
    """Inner join on the row key: predictions, reasoning or attributions to their rows."""
    return df.join(other, key)


def attach_truth(predictions: DataFrame, table: DataFrame, target: str, key: str = "idx") -> DataFrame:
    """Predictions with their true label as ``y``."""
    truth = table.select(key, F.col(target).cast("bigint").alias("y"))
    return predictions.join(truth, key)


def common_rows(first: DataFrame, second: DataFrame, truth: DataFrame, key: str = "idx") -> DataFrame:
    """Rows that both prediction sets cover, with truth: ``idx, y, p1, p2``."""
    return (first.select(key, F.col("prediction").alias("p1"))
            .join(second.select(key, F.col("prediction").alias("p2")), key)
            .join(truth.select(key, "y"), key).select(key, "y", "p1", "p2"))


def common_keys(first: DataFrame, second: DataFrame, key: str = "idx") -> DataFrame:
    """Keys that occur in both tables, once each."""
    return first.select(key).intersect(second.select(key))


def per_agent(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every row once per agent, with the columns of that agent's block.

    ``blocks`` has one row per ``agent`` 0..n-1. Each row lists the agents and joins on the agent
    number; the agents have equal numbers of rows.
    """
    last = blocks.agg(F.max("agent").alias("last")).first()["last"]
    if last is None:
        listed = F.array().cast("array<bigint>")
    else:
        listed = F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))
    fanned = rows.withColumn("agent", F.explode(listed))
    return fanned.join(blocks, "agent")
