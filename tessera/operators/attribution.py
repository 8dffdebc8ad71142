"""Additive per-row feature attributions of tree models (path-dependent Shapley values).

A leaf pays its value to the rows that satisfy the condition of every feature on its path.
Where a feature is left out of a coalition, the share of training rows that its edges keep
takes the condition's place. The Shapley values of that game have a closed form per leaf and
add up over leaves and trees (Lundberg et al., "Consistent individualized feature attribution
for tree ensembles").
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.clean import col
from tessera.operators.models import with_vector
from tessera.operators.trees import TreeModel, matrix
from tessera.session import cut_lineage, shared_path

# Paths of up to this many features are looked up in a table of all patterns of conditions.
TABLE_FEATURES = 6
# Leaves attributed together, and cells (rows x leaves x features) held at once.
GROUP_LEAVES = 1024
CELLS = 2_000_000


@dataclass
class Leaf:
    """One leaf: the distinct features of its path, their intervals (low, high], the share of
    rows that each feature's edges keep, and the value paid.

    ``sets`` has, for features split by categories, whether each category meets the condition, and last whether an unknown one does.
    """

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float
    sets: dict[int, np.ndarray] = field(default_factory=dict)


def _node_rows(model: Model, spark) -> list[dict]:
    """All nodes of a model, from its saved form; their number depends on its settings only."""
    path = shared_path(spark, "model")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
    else:
        nodes = nodes.withColumn("treeID", F.lit(0))
    rows = nodes.select("treeID", "id", "prediction", "impurityStats", "leftChild", "rightChild",
                        F.col("split.featureIndex").alias("feature"),
                        F.col("split.leftCategoriesOrThreshold").alias("threshold"),
                        F.col("split.numCategories").alias("categories")).collect()
    return [r.asDict() for r in rows]


def _weight(model: Model, node: dict) -> float:
    """The training rows of a node, by weight: of boosted trees the first statistic, else the sum over the classes."""
    return node["impurityStats"][0] if type(model).__name__.startswith("GBT") else sum(node["impurityStats"])


def _leaf_value(model: Model, node: dict, tree: int) -> float:
    """What a leaf adds: log-odds for boosted trees, the share of class 1 otherwise."""
    if type(model).__name__.startswith("GBT"):
        return 2.0 * model.treeWeights[tree] * node["prediction"]
    trees = getattr(model, "getNumTrees", 1)
    return node["impurityStats"][1] / sum(node["impurityStats"]) / trees


def leaves_of(model: Model, spark) -> list[Leaf]:
    """Every leaf of every tree with the conditions of its path, repeated features merged."""
    if isinstance(model, TreeModel):
        return [Leaf(*path) for path in model.paths()]
    trees: dict[int, dict[int, dict]] = {}
    for node in _node_rows(model, spark):
        trees.setdefault(node["treeID"], {})[node["id"]] = node
    leaves = []
    for tree, nodes in sorted(trees.items()):
        pending = [(0, {})]
        while pending:
            at, path = pending.pop()
            node = nodes[at]
            if node["leftChild"] < 0:
                names = sorted(path)
                low, high, share = (np.array([path[f][i] for f in names], dtype=float) for i in range(3))
                sets = {f: path[f][3] for f in names if path[f][3] is not None}
                leaves.append(Leaf(np.array(names, dtype=int), low, high, share,
                                   _leaf_value(model, node, tree), sets))
                continue
            f = node["feature"]
            low, high, share, met = path.get(f, (-np.inf, np.inf, 1.0, None))
            if node["categories"] > -1:
                left = np.zeros(node["categories"] + 1, dtype=bool)
                left[np.array(node["threshold"], dtype=int)] = True
                left[-1] = len(node["threshold"]) > node["categories"] // 2  # the model sends unknown ones to the larger side
                edges = [(low, high, left if met is None else met & left), (low, high, ~left if met is None else met & ~left)]
            else:
                cut = node["threshold"][0]
                edges = [(low, min(high, cut), met), (max(low, cut), high, met)]
            for child, (low, high, met) in zip((node["leftChild"], node["rightChild"]), edges):
                kept = share * _weight(model, nodes[child]) / _weight(model, node)
                pending.append((child, path | {f: (low, high, kept, met)}))
    return leaves


@dataclass
class Stack:
    """Leaves with equally many path features, as arrays (leaves x path features); ``sets`` (x categories) if one has a set."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray
    sets: np.ndarray | None = None

    def met(self, x: np.ndarray) -> np.ndarray:
        """Whether rows meet the conditions (rows x leaves x path features)."""
        values = x[:, self.features]
        met = (values > self.low) & (values <= self.high)
        if self.sets is None:
            return met
        unknown = self.sets.shape[2] - 1
        known = (values >= 0) & (values < unknown) & (values == np.floor(values))
        category = np.where(known, values, unknown).astype(int)
        leaves, d = self.features.shape
        inside = self.sets[np.arange(leaves)[:, None], np.arange(d), category]
        return np.where(self.by_set(), inside, met)

    def by_set(self) -> np.ndarray:
        """Conditions that are sets: they have no bounds."""
        return np.isneginf(self.low) & np.isposinf(self.high)


def _sets(part: list[Leaf], d: int) -> np.ndarray | None:
    """Sets of leaves, filled up to equal length by what holds for unknown categories."""
    most = max((len(s) for leaf in part for s in leaf.sets.values()), default=0)
    if not most:
        return None
    out = np.ones((len(part), d, most), dtype=bool)
    for i, leaf in enumerate(part):
        for j, f in enumerate(leaf.features):
            if f in leaf.sets:
                met = leaf.sets[f]
                out[i, j] = np.concatenate([met, np.repeat(met[-1:], most - len(met))])
    return out


def stacked(leaves: list[Leaf], most: int = GROUP_LEAVES) -> list[Stack]:
    """Leaves by number of path features, in groups of at most ``most``; constant leaves have no effect."""
    found = []
    for d in sorted({len(leaf.features) for leaf in leaves} - {0}):
        same = [leaf for leaf in leaves if len(leaf.features) == d]
        for i in range(0, len(same), most):
            part = same[i:i + most]
            found.append(Stack(*(np.stack([getattr(leaf, n) for leaf in part]) for n in ("features", "low", "high", "share")),
                               np.array([leaf.value for leaf in part]), _sets(part, d)))
    return found


def leaf_effects(met: np.ndarray, share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Shapley value of each path feature, for conditions met or not (rows x leaves x features).

    The polynomial's coefficient s sums the payments of all coalitions of s other features.
    """
    met = met.astype(float)
    d = met.shape[-1]
    weights = np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)])
    out = np.empty(np.broadcast_shapes(met.shape, share.shape))
    for j in range(d):
        poly = np.zeros(out.shape)
        poly[..., 0] = 1.0
        for i in range(d):
            if i != j:
                higher = poly[..., :-1] * met[..., i:i + 1]
                poly *= share[:, i:i + 1]
                poly[..., 1:] += higher
        out[..., j] = (met[..., j] - share[:, j]) * (poly @ weights)
    return out * value[:, None]


def _patterns(d: int) -> np.ndarray:
    """All combinations of d conditions, row number = bit pattern."""
    return (np.arange(2 ** d)[:, None] >> np.arange(d)) & 1


def row_effects(x: np.ndarray, stacks: list[Stack]) -> np.ndarray:
    """Attributions of each row (rows x features), a group of leaves at a time."""
    out = np.zeros_like(x)
    for stack in stacks:
        leaves, d = stack.features.shape
        target = np.zeros((leaves * d, x.shape[1]))
        target[np.arange(leaves * d), stack.features.ravel()] = 1.0
        short = d <= TABLE_FEATURES
        table = leaf_effects(_patterns(d)[:, None, :], stack.share, stack.value) if short else None
        rows = max(1, CELLS // (leaves * d))
        for i in range(0, len(x), rows):
            met = stack.met(x[i:i + rows])
            effects = (table[met @ (1 << np.arange(d)), np.arange(leaves)] if short
                       else leaf_effects(met, stack.share, stack.value))
            out[i:i + rows] += effects.reshape(len(effects), -1) @ target
    return out


def base_value(leaves: list[Leaf]) -> float:
    """Expected margin: the attributions of a row and this add up to its margin."""
    return float(sum(leaf.value * np.prod(leaf.share) for leaf in leaves))


def row_kinds(leaves: list[Leaf], width: int):
    """A column function from rows' values to a name of what decides the conditions of all leaves: for each feature the
    number of its bounds below the value, its category or that it is missing."""
    bounds = [set() for _ in range(width)]
    known = [0] * width
    for leaf in leaves:
        for f, low, high in zip(leaf.features, leaf.low, leaf.high):
            bounds[f] |= {float(b) for b in (low, high) if np.isfinite(b)}
        for f, met in leaf.sets.items():
            known[f] = max(known[f], len(met) - 1)
    bounds = [np.array(sorted(b)) for b in bounds]

    @F.arrow_udf("binary")
    def named(rows: pa.Array) -> pa.Array:
        x = matrix(rows)
        out = np.zeros((len(x), width, 2), dtype="<i4")
        for f in range(width if len(x) else 0):
            v = x[:, f]
            out[:, f, 0] = np.where(np.isnan(v), -1, np.searchsorted(bounds[f], v))
            # No interval holds minus infinity, nor a bounded one infinity: they are not as the values beside them.
            out[:, f, 1] = np.where(np.isinf(v), -2, -1)
            if known[f]:
                inside = (v >= 0) & (v < known[f]) & (v == np.floor(v))
                out[inside, f, 1] = v[inside]
        return pa.array([row.tobytes() for row in out], pa.binary())

    return named


def attributions(model: Model, df: DataFrame, features: list[str], key: str = "idx",
                 leaves: list[Leaf] | None = None) -> DataFrame:
    """``key`` and one attribution per feature for every row of ``df``.

    Rows that meet the same conditions have the same attributions: these are found once for each kind of row and joined
    to the rows.
    """
    spark = df.sparkSession
    found = leaves_of(model, spark) if leaves is None else leaves
    shared = spark.sparkContext.broadcast([astuple(stack) for stack in stacked(found)])  # one model's leaves
    width = len(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = [Stack(*parts) for parts in shared.value]
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()).astype(float) if len(batch) else np.empty((0, width))
            effects = row_effects(x, mine)
            yield pd.DataFrame({"kind": batch["kind"], "v": list(effects)})
    rows = df.select(col(key).alias("k"), F.array(*[col(c).cast("double") for c in features]).alias("x"))
    rows = rows.withColumn("kind", row_kinds(found, width)("x"))
    # A value for each feature: aggregates of numbers are hashed, one of arrays would sort all rows.
    kinds = rows.groupBy("kind").agg(*[F.first(F.get("x", F.lit(i))).alias(f"x{i}") for i in range(width)])
    kinds = kinds.select("kind", F.array(*[F.col(f"x{i}").cast("double") for i in range(width)]).alias("x")).repartition(
        spark.sparkContext.defaultParallelism, "kind")
    values = cut_lineage(kinds.mapInPandas(run, "kind binary, v array<double>"), "attributed-kinds")
    parts = rows.select("k", "kind").join(values, "kind")
    return parts.select(F.col("k").alias(key), *[F.col("v")[i].alias(c) for i, c in enumerate(features)])


def margins(model: Model, df: DataFrame, features: list[str], key: str = "idx") -> DataFrame:
    """``key, margin``: the model output that the attributions explain."""
    rows = model.transform(with_vector(df, features))
    if isinstance(model, TreeModel):
        return rows.select(key, "margin")
    if type(model).__name__.startswith("GBT"):
        margin = 2 * vector_to_array("rawPrediction")[1]
    else:
        margin = vector_to_array("probability")[1]
    return rows.select(key, margin.alias("margin"))
