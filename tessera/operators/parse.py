"""From response text to labels, reasoning and judge scores.

Inputs have ``key`` and ``text`` (``finish`` too where a response can be cut off) and a
``seq`` column of any orderable type. A key that occurs again overwrites earlier values,
but only a line that parses can do so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import after_last, first_int, second_piece, strict_object, strip

# Markers the prompts ask for and the parsers look for.
STOP = "STOP"
FINAL_MARK = "FINAL PREDICTION:"
THINK_END = "</think>"
REASONING_OPEN = "<REASONING>"
REASONING_CLOSE = "</REASONING>"
EVALUATION_MARK = "EVALUATION:"


def trailing_id(key: Column) -> Column:
    """Row id after the last dash of a request id."""
    return F.split_part(key, F.lit("-"), F.lit(-1)).cast("bigint")


def second_id(key: Column) -> Column:
    """Row id between the first and second dash, up to an underscore."""
    piece = F.split_part(key, F.lit("-"), F.lit(2))
    return F.split_part(piece, F.lit("_"), F.lit(1)).cast("bigint")


def finished(responses: DataFrame) -> DataFrame:
    """Responses that ended on their own."""
    return responses.filter(F.col("finish") == STOP)


def interrupted(responses: DataFrame) -> DataFrame:
    """One row: how many responses were cut off, of how many."""
    return responses.agg(F.count_if(F.col("finish") != STOP).alias("interrupted"),
                         F.count(F.lit(1)).alias("responses"))


def last_per_key(df: DataFrame, key: str, value: str, order: str = "seq") -> DataFrame:
    """The non-null value of highest ``order`` per key; keys without one drop out."""
    place = F.when(F.col(value).isNotNull(), F.col(order))
    return df.groupBy(key).agg(F.max_by(value, place).alias(value)).filter(F.col(value).isNotNull())


def label_of(text: Column) -> Column:
    """Label in plain text: the first number in it."""
    return first_int(text)


def stepwise_label_of(text: Column) -> Column:
    """Label behind the last final-prediction mark, or anywhere without the mark."""
    return first_int(after_last(text, FINAL_MARK))


def plain_labels(responses: DataFrame) -> DataFrame:
    """``idx, prediction`` from plain answers; a finished answer without text is an error."""
    text = F.coalesce(F.col("text"), F.raise_error(F.concat(F.lit("no text in the answer to "), "key")))
    rows = finished(responses).select(trailing_id(F.col("key")).alias("idx"),
                                      label_of(text).alias("prediction"), "seq")
    return last_per_key(rows, "idx", "prediction")


def stepwise_labels(responses: DataFrame) -> DataFrame:
    """``idx, prediction`` from step-by-step answers; those without text are left out."""
    rows = finished(responses).filter(F.col("text").isNotNull()).select(trailing_id(F.col("key")).alias("idx"),
                                      stepwise_label_of(F.col("text")).alias("prediction"), "seq")
    return last_per_key(rows, "idx", "prediction")


def votes(responses: DataFrame) -> DataFrame:
    """``idx, agent, prediction, seq``: one row per finished answer of an agent that has a text."""
    return finished(responses).filter(F.col("text").isNotNull()).select(
        second_id(F.col("key")).alias("idx"), trailing_id(F.col("key")).alias("agent"),
        stepwise_label_of(F.col("text")).alias("prediction"), "seq")


def first_votes(ballots: DataFrame) -> DataFrame:
    """One vote per row and agent: the earliest."""
    return ballots.groupBy("idx", "agent").agg(
        F.min_by("prediction", "seq").alias("prediction"), F.min("seq").alias("seq"))


def majority(counted: DataFrame) -> DataFrame:
    """Most frequent prediction per row from ``idx, prediction, n``; ties go to the smallest."""
    best = F.max_by("prediction", F.struct(F.col("n"), (-F.col("prediction")).alias("p")))
    return counted.groupBy("idx").agg(best.alias("prediction"))


def count_votes(ballots: DataFrame) -> DataFrame:
    """``idx, prediction, n``: partial sums leave one row per label before the shuffle."""
    return ballots.groupBy("idx", "prediction").agg(F.count(F.lit(1)).alias("n"))


def agent_labels(responses: DataFrame, dedupe_agents: bool = False) -> DataFrame:
    """``idx, prediction``: majority over all agents of a row, the smallest label of equals.

    Each task counts a row's labels before the one shuffle, by row id.
    """
    ballots = votes(responses)
    ballots = first_votes(ballots) if dedupe_agents else ballots
    return ballots.groupBy("idx").agg(F.mode("prediction", True).alias("prediction"))


def reasoning_of(text: Column) -> Column:
    """Reasoning paragraph of an answer; null when a mark is missing, may be empty."""
    body = second_piece(second_piece(text, THINK_END), REASONING_OPEN)
    return strip(F.replace(body, F.lit(REASONING_CLOSE), F.lit("")))


def reasoning(responses: DataFrame) -> DataFrame:
    """``idx, reasoning`` of the answers that follow the format."""
    rows = responses.select(second_id(F.col("key")).alias("idx"),
                            reasoning_of(F.col("text")).alias("reasoning"), "seq")
    return last_per_key(rows, "idx", "reasoning")


def metrics_of(text: Column) -> Column:
    """Judge scores as ``map<string,double>``; null unless one JSON object follows the mark."""
    found = strict_object(second_piece(text, EVALUATION_MARK), "struct<metrics: map<string,string>>")
    return F.transform_values(found["metrics"], lambda _, v: v.try_cast("double"))


def judge_scores(responses: DataFrame) -> DataFrame:
    """``idx, metrics`` of the evaluations that follow the format."""
    rows = responses.select(second_id(F.col("key")).alias("idx"),
                            metrics_of(F.col("text")).alias("metrics"), "seq")
    return last_per_key(rows, "idx", "metrics")


def require_reasoning(parsed: DataFrame) -> DataFrame:
    """Return the parsed reasoning, or raise when no answer followed the format."""
    if parsed.isEmpty():
        raise ValueError("no reasoning could be parsed from the responses")
    return parsed


def triage(results: DataFrame) -> DataFrame:
    """``type, n``: batch results by their final state."""
    return results.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def succeeded(results: DataFrame) -> DataFrame:
    """``request_id, evaluation`` (and ``seq``, where there is one) of the results that succeeded."""
    order = [c for c in ("seq",) if c in results.columns]
    return (results.filter(F.col("type") == "succeeded")
            .select(F.col("key").alias("request_id"), F.col("text").alias("evaluation"), *order))
