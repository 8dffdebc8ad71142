"""Request jobs: from tables to the requests of one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import SEED, FewShot, ModelSpec
from tessera.functions.hashing import seeded_md5
from tessera.functions.rows import dict_text, importance_text, key_value_text
from tessera.operators import prompts, requests
from tessera.operators.clean import first_seen
from tessera.operators.joins import per_agent
from tessera.operators.split import example_sets
from tessera.session import cut_lineage


def label_values(train: DataFrame, target: str, seed: int = SEED) -> list:
    """The two labels in the order in which the shuffled training rows show them."""
    shuffled = train.select(F.col(f"`{target}`").alias("y"), seeded_md5(seed, F.col("idx")).alias("at"))
    found = [r["value"] for r in first_seen(shuffled, "y", "at").limit(3).collect()]
    if len(found) > 2:
        raise ValueError(f"target {target!r} has more than 2 values")
    return found


def zero_shot(test: DataFrame, features: list[str], labels: list, dataset: str, target: str,
              model: ModelSpec, stepwise: bool = False, thinking_budget: int = 1000,
              make: prompts.PromptMaker | None = None) -> DataFrame:
    """``idx, key, request``: one request per test row, without examples."""
    make = make or (prompts.stepwise if stepwise else prompts.zero_shot)
    rows = test.select("idx", key_value_text(test, features).alias("example"))
    prompt = make({"dataset": F.lit(dataset), "target": F.lit(target),
                   "labels": prompts.label_list(labels), "example": F.col("example")})
    key = requests.baseline_id("zero-shot-cot" if stepwise else "zero-shot", F.col("idx"))
    request = requests.contents_envelope(key, prompt, model, thinking_budget if stepwise else 0)
    return rows.select("idx", key.alias("key"), request.alias("request"))


def explained_rows(rows: DataFrame, predictions: DataFrame, attributions: DataFrame,
                   importances: DataFrame, target: str, include_target: bool = True) -> DataFrame:
    """``idx`` and the text slots that the reasoning and judge prompts share."""
    names = [c for c in rows.columns if c not in ("idx",) and (include_target or c != target)]
    attributed = [c for c in attributions.columns if c != "idx"]
    left = rows.select("idx", key_value_text(rows, names).alias("features"),
                       F.col(f"`{target}`").cast("bigint").alias("truth"))
    right = attributions.select("idx", key_value_text(attributions, attributed).alias("attributions"))
    return (left.join(predictions.select("idx", "prediction"), "idx").join(right, "idx")
            .withColumn("importances", importance_text(importances).scalar()))


def _slots(dataset: str, target: str, names: tuple[str, ...]) -> dict:
    return {"dataset": F.lit(dataset), "target": F.lit(target)} | {n: F.col(n) for n in names}


EXPLAINED = ("prediction", "truth", "features", "attributions", "importances")


def reasoning(explained: DataFrame, dataset: str, target: str, model: ModelSpec,
              make: prompts.PromptMaker = prompts.reasoning) -> DataFrame:
    """``idx, key, request``: ask for the reasoning behind each explained row."""
    key = requests.reasoning_id(F.col("idx"))
    prompt = make(_slots(dataset, target, EXPLAINED))
    return explained.select("idx", key.alias("key"),
                            requests.body_envelope(key, prompt, model).alias("request"))


def judge(explained: DataFrame, reasons: DataFrame, dataset: str, target: str, model: ModelSpec,
          make: prompts.PromptMaker = prompts.judge) -> DataFrame:
    """``idx, key, request``: ask for scores of each parsed reasoning."""
    key = requests.judge_id(F.col("idx"))
    prompt = make(_slots(dataset, target, (*EXPLAINED, "reasoning")))
    return explained.join(reasons, "idx").select(
        "idx", key.alias("key"), requests.params_envelope(key, prompt, model).alias("request"))


def example_texts(rows: DataFrame, predictions: DataFrame, attributions: DataFrame,
                  reasons: DataFrame, target: str, include_target: bool = True) -> DataFrame:
    """``idx, features, attributions, prediction, reasoning`` of the rows with a reasoning."""
    names = [c for c in rows.columns if c not in ("idx",) and (include_target or c != target)]
    attributed = [c for c in attributions.columns if c != "idx"]
    return (rows.select("idx", dict_text(names).alias("features"))
            .join(attributions.select("idx", dict_text(attributed).alias("attributions")), "idx")
            .join(predictions.select("idx", "prediction"), "idx")
            .join(reasons, "idx"))


def few_shot(examples: DataFrame, test: DataFrame, features: list[str], importances: DataFrame,
             dataset: str, target: str, labels: dict[int, str], model: ModelSpec,
             settings: FewShot = FewShot(), seed: int = SEED,
             make: prompts.PromptMaker = prompts.few_shot) -> DataFrame:
    """``idx, agent, key, request``: every test row once per agent's example set.

    The example block is built once per agent, not once per request.
    """
    sets = example_sets(cut_lineage(examples, "examples"), settings.examples_per_agent, seed=seed)
    blocks = cut_lineage(prompts.example_blocks(sets), "blocks")
    rows = test.select("idx", key_value_text(test, features).alias("example"))
    pairs = per_agent(rows, blocks).withColumn("importances", importance_text(importances).scalar())
    prompt = make(_slots(dataset, target, ("importances", "examples", "example"))
                  | {"labels": prompts.label_names(labels)})
    key = requests.few_shot_id(F.col("idx"), F.col("agent"))
    request = requests.contents_envelope(key, prompt, model, settings.thinking_budget)
    return pairs.select("idx", "agent", key.alias("key"), request.alias("request"))
