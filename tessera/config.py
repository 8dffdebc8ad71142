"""Driver-side descriptors and the fixed values the jobs share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

# They decide results and are the same everywhere.
SEED = 42
TEST_FRACTION = 0.2
FOLDS = 5
TRIALS = 10
MAX_CLUSTERS = 10
ALPHA = 0.05
STRATEGIES = ("guided-few-shot", "zero-shot-prompting", "zero-shot-cot")
JUDGE_METRICS = ("faithfulness", "consistency", "coherence")
MASKED_NAME = "unknown"
MASKED_LABELS = {0: "Class0", 1: "Class1"}


@dataclass(frozen=True)
class Dataset:
    """A binary classification table: how to prepare it and what its labels mean.

    ``multiline`` says that cells hold quoted line breaks; such files are read whole, one task each.
    """

    name: str
    target: str
    labels: dict[int, str]
    prepare: Callable[[DataFrame], DataFrame]
    path: str | None = None
    multiline: bool = False

    def __post_init__(self):
        if not callable(self.prepare):
            raise TypeError("prepare must be callable")
        if len(self.labels) != 2:
            raise ValueError("labels must have exactly 2 entries (binary classification)")
        if self.path is not None and not self.path.endswith(".csv"):
            raise ValueError("dataset path must end with '.csv'")


@dataclass(frozen=True)
class ModelSpec:
    """Name and sampling settings that go into every request of one job."""

    name: str
    temperature: float
    max_tokens: int

    def __post_init__(self):
        if self.temperature < 0:
            raise ValueError(f"temperature must be >= 0, got {self.temperature}")
        if self.max_tokens <= 0:
            raise ValueError(f"max_tokens must be > 0, got {self.max_tokens}")


@dataclass(frozen=True)
class FewShot:
    """How many worked examples one agent sees and how long it may think."""

    examples_per_agent: int = 10
    thinking_budget: int = 1000

    def __post_init__(self):
        if self.examples_per_agent <= 0:
            raise ValueError(f"examples_per_agent must be > 0, got {self.examples_per_agent}")
        if self.thinking_budget < 0:
            raise ValueError(f"thinking_budget must be >= 0, got {self.thinking_budget}")


def check_strategy(name: str) -> str:
    """Return ``name`` if it is a known prompting strategy, else raise."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; must be one of {STRATEGIES}")
    return name
