"""Result tables over datasets and strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column order of the reports, and where each score sits in a metrics document.
APPROACHES = ["tree-model", "guided-few-shot", "zero-shot-cot", "baseline"]
MASK_PREFIX = "masked_"


def flat_scores(docs: DataFrame) -> DataFrame:
    """``dataset, approach, value`` of run results ``dataset, masked, strategy, macro_f1``."""
    name = F.when(F.col("masked"), F.concat(F.lit(MASK_PREFIX), F.col("dataset"))).otherwise(F.col("dataset"))
    approach = F.when(F.col("strategy") == "zero-shot-prompting", F.lit("baseline")).otherwise(F.col("strategy"))
    return docs.select(name.alias("dataset"), approach.alias("approach"), F.col("macro_f1").alias("value"))


def approach_table(scores: DataFrame, datasets: list[str], approaches: list[str] | None = APPROACHES) -> DataFrame:
    """One row per dataset, one column per approach.

    An approach outside the list raises when the table is read; without a list the columns are the approaches
    found, in order of their names.
    """
    mine = scores.filter(F.col("dataset").isin(datasets))
    if approaches is None:
        approaches = sorted(r[0] for r in mine.select("approach").distinct().collect())
    known = F.when(F.col("approach").isin(approaches), F.col("approach")).otherwise(
        F.raise_error(F.concat(F.lit("unknown approach: "), F.coalesce("approach", F.lit("null")))))
    return (mine.withColumn("approach", known).groupBy("dataset").pivot("approach", approaches)
            .agg(F.first("value", ignorenulls=True)))


def title(text: Column) -> Column:
    """Title case in which any character that is no letter starts a new word."""
    marked = F.initcap(F.regexp_replace(F.lower(text), r"([^\p{L}]+)", " $1 "))
    return F.regexp_replace(marked, r" ([^\p{L}]+) ", "$1")


def long_table(wide: DataFrame, approaches: list[str]) -> DataFrame:
    """``dataset, approach, performance`` with display names; missing pairs are left out."""
    long = wide.unpivot(["dataset"], approaches, "approach", "performance")
    return long.filter(F.col("performance").isNotNull()).select(
        title(F.col("dataset")).alias("dataset"),
        title(F.replace(F.col("approach"), F.lit("-"), F.lit(" "))).alias("approach"),
        "performance")


def mask_effect(scores: DataFrame) -> DataFrame:
    """``dataset, approach, unmasked, masked, delta`` where both runs exist."""
    is_masked = F.col("dataset").startswith(MASK_PREFIX)
    masked = scores.filter(is_masked).select(
        F.substring(F.col("dataset"), F.lit(len(MASK_PREFIX) + 1), F.length("dataset")).alias("dataset"),
        "approach", F.col("value").alias("masked"))
    plain = scores.filter(~is_masked).select("dataset", "approach", F.col("value").alias("unmasked"))
    return (plain.join(masked, ["dataset", "approach"])
            .withColumn("delta", F.col("masked") - F.col("unmasked")))


def judge_matrix(means: DataFrame, datasets: list[str]) -> DataFrame:
    """One row per judge metric, one column per dataset."""
    return means.groupBy("metric").pivot("dataset", datasets).agg(F.first("score", ignorenulls=True))


def rounded(df: DataFrame, names: list[str], digits: int) -> DataFrame:
    """Round report columns half-even."""
    return df.withColumns({n: F.bround(n, digits) for n in names})
