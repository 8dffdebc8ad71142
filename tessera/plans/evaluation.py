"""Scoring of label sets and response lines against a prepared table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import ALPHA, check_strategy
from tessera.operators import joins, scoring
from tessera.sources import responses

# Takes parsed candidate responses and returns ``idx, prediction``.
Parser = Callable[[DataFrame], DataFrame]


def score(labels: DataFrame, table: DataFrame, target: str, strategy: str) -> DataFrame:
    """``strategy, accuracy, macro_f1, n`` of ``idx, prediction`` against the table."""
    joined = joins.attach_truth(labels, table, target).withColumn("strategy", F.lit(strategy))
    return scoring.evaluate(joined, ["strategy"])


def score_responses(lines: DataFrame, parser: Parser, table: DataFrame, target: str, strategy: str) -> DataFrame:
    """The same from response lines (``line, seq``) through a label parser."""
    return score(parser(responses.candidates(lines)), table, target, check_strategy(strategy))


def compare(first: DataFrame, second: DataFrame, table: DataFrame, target: str, alpha: float = ALPHA) -> DataFrame:
    """McNemar's test of two label sets on the rows that both cover."""
    truth = table.select("idx", F.col(f"`{target}`").cast("bigint").alias("y"))
    return scoring.mcnemar(joins.common_rows(first, second, truth), alpha)
