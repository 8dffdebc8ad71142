"""Prompt text as column expressions.

A prompt maker takes a dict of named columns and returns the prompt column, so a template
string or any other expression can replace the ones below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fill

PromptMaker = Callable[[dict[str, Column]], Column]

ZERO_SHOT = """\
Classify one row of the tabular dataset '{dataset}'. The label column is '{target}'.

Allowed labels: {labels}

Feature values:
{example}

Which value does '{target}' have for this row? Reply with one allowed label and nothing else."""

STEPWISE = """\
Classify one row of the tabular dataset '{dataset}'. The label column is '{target}'.

Allowed labels: {labels}

Feature values:
{example}

Which value does '{target}' have for this row? Work it out step by step, in at most 500 words.

Close your reply with this line, where the label is a number from the allowed labels and is
followed by no other text; if in doubt, give your best guess:
FINAL PREDICTION: [label]"""

REASONING = """\
You explain the decisions of tree models. Below is one row of the tabular dataset '{dataset}'
with label column '{target}', the model's prediction for it and the SHAP value of each feature.

Predicted label: {prediction}
True label: {truth}

Feature values:
{features}

SHAP values:
{attributions}

Feature importances over all rows:
{importances}

First compare the predicted with the true label. Then explain how the feature values and their
SHAP values lead to the prediction. Write English only, think in at most 500 words, and reply in
exactly this form, with one paragraph of reasoning and nothing after its closing tag:
<think>[your thoughts]</think>
<REASONING>[one paragraph that ends in the prediction]</REASONING>"""

JUDGE = """\
You judge explanations impartially. The tabular dataset is '{dataset}', its label column '{target}'.

Feature values of the row:
{features}

SHAP values of the row, which are the truth about each feature's contribution:
{attributions}

Feature importances over all rows:
{importances}

Predicted label: {prediction}
True label: {truth}

Explanation to judge:
{reasoning}

Give each metric a score from 1.00 to 5.00 in steps of 0.25; 5.00 is best.
- faithfulness: the explanation has the sign and relative size of the SHAP values right;
  contradicting the largest of them scores 1.00.
- consistency: it puts the features of largest absolute SHAP value first.
- coherence: it is well written, well ordered and clear to a lay reader.

Write one paragraph of analysis per metric, at most 800 words in all. Then close your reply with
the mark below and one JSON object, followed by no other text:
EVALUATION:
{"metrics": {"faithfulness": [score], "consistency": [score], "coherence": [score]}}"""

FEW_SHOT = """\
Classify one row of the tabular dataset '{dataset}'. The label column is '{target}'.
Possible labels: {labels}

Worked examples follow, each with feature values, SHAP values, a model's prediction and the
reasoning behind it.

Feature importances over all rows: {importances}

{examples}

Row to classify:
{example}

Which value does '{target}' have for this row? Work it out step by step, in at most 500 words, and
use what the SHAP values did to the predictions in the examples.

Close your reply with this line, the label followed by no other text:
FINAL PREDICTION: [label]"""

EXAMPLE = """\
Example {number}:
- the row: {features}
- what each feature added: {attributions}
- answered by the model: {prediction}
- and why: {reasoning}
"""


def from_template(template: str) -> PromptMaker:
    """A prompt maker that fills the named slots of ``template``."""
    return lambda slots: fill(template, slots)


zero_shot = from_template(ZERO_SHOT)
stepwise = from_template(STEPWISE)
reasoning = from_template(REASONING)
judge = from_template(JUDGE)
few_shot = from_template(FEW_SHOT)
example = from_template(EXAMPLE)


def label_list(values: list) -> Column:
    """Labels as a comma-separated constant."""
    return F.lit(", ".join(str(v) for v in values))


def label_names(labels: dict[int, str]) -> Column:
    """Label codes with their names as a constant."""
    return F.lit(", ".join(f"{k}: {v}" for k, v in labels.items()))


def example_blocks(examples: DataFrame, make: PromptMaker = example) -> DataFrame:
    """``agent, examples``: the worked examples of each agent in order of ``pos``.

    Rows need ``agent, pos, features, attributions, prediction, reasoning``. An agent has at
    most ``examples_per_agent`` of them, which bounds the group.
    """
    names = ("features", "attributions", "prediction", "reasoning")
    slots = {n: F.col(n) for n in names} | {"number": F.col("pos") + 1}
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return (examples.select("agent", "pos", make(slots).alias("text"))
            .groupBy("agent")
            .agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("examples")))
