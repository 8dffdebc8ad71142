"""Baselines and the end-to-end run."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass, replace

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import (MASKED_LABELS, MASKED_NAME, SEED, STRATEGIES, TRIALS, Dataset, FewShot,
                            ModelSpec)
from tessera.operators import clean, joins, parse, representatives, scoring
from tessera.plans import requests as jobs
from tessera.plans.evaluation import score, score_responses
from tessera.plans.explain import Explanation, explain
from tessera.session import cut_lineage
from tessera.sources import responses
from tessera.sources.tables import load

# Takes ``key, line`` requests and returns ``key, line`` answers.
Infer = Callable[[DataFrame], DataFrame]
GUIDED, ZERO_SHOT, STEPWISE = STRATEGIES
MODEL = "tree-model"


@dataclass(frozen=True)
class Task:
    """What the prompts say about the table."""

    dataset: str
    target: str
    labels: dict[int, str]


@dataclass(frozen=True)
class Models:
    """The three request settings of a run."""

    reasoning: ModelSpec
    judge: ModelSpec
    classifier: ModelSpec


@dataclass
class RunResult:
    """Scores per strategy, judge means per metric (or None) and the parsed reasoning."""

    scores: DataFrame
    judgement: DataFrame | None
    reasons: DataFrame


def answers(requests: DataFrame, infer: Infer, label: str) -> DataFrame:
    """Send requests and keep the answers as ``line, seq`` in a written table, so that a lost
    executor never sends a request again.

    ``seq`` orders the answers to one key: their attempt, then their place as written. Rows that
    ``infer`` marks as failed carry no answer.
    """
    replies = infer(requests.select("key", F.to_json("request").alias("line")))
    attempt = F.col("attempt") if "attempt" in replies.columns else F.lit(0)
    kept = replies.filter(F.col("line").isNotNull()).select("line", attempt.cast("int").alias("attempt"))
    written = cut_lineage(kept.withColumn("place", F.monotonically_increasing_id()), label)
    return written.select("line", F.struct("attempt", "place").alias("seq"))


def score_model(e: Explanation, target: str, name: str = MODEL) -> DataFrame:
    """The tree model's scores on the test rows."""
    tested = e.predictions.filter(F.col("split") == "test").select("idx", "prediction")
    return score(tested, e.table, target, name)


def baseline(e: Explanation, task: Task, model: ModelSpec, infer: Infer, stepwise: bool = False,
             thinking_budget: int = 1000) -> DataFrame:
    """Request, answer, parse and score one strategy that sees no examples."""
    features = clean.features_of(e.rows("test"), task.target)
    labels = jobs.label_values(e.rows("train"), task.target)
    asked = jobs.zero_shot(e.rows("test"), features, labels, task.dataset, task.target, model,
                           stepwise, thinking_budget)
    parser = parse.stepwise_labels if stepwise else parse.plain_labels
    return score_responses(answers(asked, infer, "baseline"), parser, e.table, task.target,
                           STEPWISE if stepwise else ZERO_SHOT)


def mask(e: Explanation, target: str) -> tuple[Explanation, Task]:
    """The same explanation under neutral names, importances included."""
    names = clean.mask_names([c for c in e.table.columns if c != "split"])
    masked = replace(e, table=clean.mask_columns(e.table, names),
                     importances=clean.mask_importances(e.importances, names),
                     attributions=clean.mask_columns(e.attributions, names))
    return masked, Task(MASKED_NAME, names[target], MASKED_LABELS)


def run(e: Explanation, task: Task, models: Models, infer: Infer, settings: FewShot = FewShot(),
        with_baseline: bool = False, with_judge: bool = False, with_stepwise: bool = False,
        seed: int = SEED) -> RunResult:
    """Reasoning for diverse rows, optional judging, few-shot classification and all scores."""
    parts = [score_model(e, task.target)]
    if with_baseline:
        parts.append(baseline(e, task, models.classifier, infer))
        if with_stepwise:
            parts.append(baseline(e, task, models.classifier, infer, True, settings.thinking_budget))
    train, test = e.rows("train"), e.rows("test")
    # The chosen rows are few: written apart, they make every later join a broadcast of them.
    keys = cut_lineage(representatives.diverse_examples(e.attributions, seed=seed), "chosen")
    chosen, predictions, attributions = (cut_lineage(joins.select_rows(df, keys), "chosen")
                                         for df in (train, e.predictions, e.attributions))
    told = jobs.explained_rows(chosen, predictions, attributions, e.importances, task.target)
    asked = jobs.reasoning(told, task.dataset, task.target, models.reasoning)
    reasons = cut_lineage(parse.reasoning(responses.choices(answers(asked, infer, "reasoning"))), "reasons")
    parse.require_reasoning(reasons)
    judgement = None
    if with_judge:
        asked = jobs.judge(told, reasons, task.dataset, task.target, models.judge)
        got = responses.results(answers(asked, infer, "judge"))
        kept = as_evaluations(parse.succeeded(got))
        judgement = scoring.judge_means(parse.judge_scores(kept))
    examples = jobs.example_texts(chosen, predictions, attributions, reasons, task.target)
    asked = jobs.few_shot(examples, test, clean.features_of(test, task.target), e.importances,
                          task.dataset, task.target, task.labels, models.classifier, settings, seed)
    parts.append(score_responses(answers(asked, infer, "few-shot"), parse.agent_labels, e.table, task.target,
                                 GUIDED))
    scores = parts[0]
    for part in parts[1:]:
        scores = scores.unionByName(part)
    return RunResult(scores, judgement, reasons)


def as_evaluations(rows: DataFrame) -> DataFrame:
    """Succeeded results in the shape the judge parser reads."""
    return rows.select(F.col("request_id").alias("key"), F.col("evaluation").alias("text"), "seq")


def run_dataset(spark: SparkSession, dataset: Dataset, space: dict[str, dict], models: Models, infer: Infer,
                estimator: Estimator | str = "GBTClassifier", masked: bool = False, n_trials: int = TRIALS,
                settings: FewShot = FewShot(), with_baseline: bool = True, with_judge: bool = True,
                with_stepwise: bool = True, seed: int = SEED, ignore: Collection[str] = ()) -> RunResult:
    """From the CSV of a dataset to its scores; ``masked`` hides all names from the prompts.

    ``ignore`` names sweep parameters without a counterpart.
    """
    e = explain(load(spark, dataset), dataset.target, space, estimator, n_trials, seed=seed,
                labels=list(dataset.labels), ignore=ignore)
    task = Task(dataset.name, dataset.target, dataset.labels)
    if masked:
        e, task = mask(e, dataset.target)
    return run(e, task, models, infer, settings, with_baseline, with_judge, with_stepwise, seed)
