"""Train/test splits, stratified folds and example sets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import FOLDS, SEED, TEST_FRACTION
from tessera.functions.hashing import seeded_md5, uniform
from tessera.operators.ranking import hash_cut, hash_rank


def exact_split(df: DataFrame, key: str = "idx", fraction: float = TEST_FRACTION,
                seed: int = SEED) -> DataFrame:
    """Add ``split``: exactly ``ceil(fraction * n)`` rows are 'test', the rest 'train'.

    The rows of smallest seeded md5 are the test rows. Their cut point is found by counting,
    so the split itself is a filter expression and moves no rows.
    """
    n_test = math.ceil(fraction * df.count())
    if n_test == 0:
        return df.withColumn("split", F.lit("train"))
    md5, last = hash_cut(df, key, seed, n_test)
    own = seeded_md5(seed, F.col(key))
    is_test = (own < md5) | ((own == md5) & (F.col(key) <= F.lit(last)))
    return df.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def hashed_split(df: DataFrame, key: str = "idx", fraction: float = TEST_FRACTION,
                 seed: int = SEED) -> DataFrame:
    """Add ``split`` by comparing each row's uniform hash with ``fraction``; sizes are approximate."""
    is_test = uniform(seed, F.col(key)) < fraction
    return df.withColumn("split", F.when(is_test, F.lit("test")).otherwise(F.lit("train")))


def stratified_folds(df: DataFrame, label: str, key: str = "idx", k: int = FOLDS,
                     seed: int = SEED) -> DataFrame:
    """Add ``fold`` in 0..k-1; fold sizes differ by at most one within each class."""
    ranked = hash_rank(df, key, seed, by=[label], out="_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank"), F.lit(k)).cast("int")).drop("_rank")


def example_sets(examples: DataFrame, per_agent: int, key: str = "idx",
                 seed: int = SEED) -> DataFrame:
    """Shuffle examples and cut them into sets of ``per_agent``: adds ``agent`` and ``pos``."""
    ranked = hash_rank(examples, key, seed, out="_rank")
    return ranked.select(
        *examples.columns,
        F.floor(F.col("_rank") / per_agent).cast("bigint").alias("agent"),
        F.pmod(F.col("_rank"), F.lit(per_agent)).cast("int").alias("pos"))
