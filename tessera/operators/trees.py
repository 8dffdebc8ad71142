"""Binary trees as column expressions, shared by the fits whose splits come from Spark's aggregates.

A tree's nodes lie in heap order, so a row's way down is an aggregate over as many steps as the tree is deep and a node's
number is its place in constant arrays. Missing values go left at every split.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gains are compared after rounding to so many digits, as sums differ in their last ones; then the first feature and bin win.
DIGITS = 9


@dataclass
class Tree:
    """Nodes in heap order (children of n: 2n+1, 2n+2): feature (-1: leaf), bin and value of the cut, payment and rows."""

    feature: list[int]
    cut_bin: list[int]
    cut: list[float]
    pays: list[float]
    rows: list[float]

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls([-1] * n, [0] * n, [0.0] * n, [0.0] * n, [0.0] * n)

    def leaves(self) -> list[int]:
        """Leaves that a row can reach, from left to right."""
        out, pending = [], [0]
        while pending:
            at = pending.pop()
            if self.feature[at] < 0:
                out.append(at)
            else:
                pending += [2 * at + 2, 2 * at + 1]
        return out


def constants(values: list) -> Column:
    """An array of numbers, given as one text: a column for each of thousands of nodes would be slow to build."""
    kind = "int" if all(isinstance(v, int) for v in values) else "double"
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def lookup(values: list, at: Column) -> Column:
    return F.element_at(constants(values), at + 1)


def node_of(x: Column, tree: Tree, depth: int, cuts: list) -> Column:
    """The node a row reaches; ``x`` holds its bins or values, ``cuts`` the bound of each node in the same units."""
    def down(node: Column, _: Column) -> Column:
        feature = lookup(tree.feature, node)
        value = F.element_at(x, F.greatest(feature, F.lit(0)) + 1)
        right = F.coalesce(value > lookup(cuts, node), F.lit(False)).cast("int")
        return F.when(feature < 0, node).otherwise(2 * node + 1 + right)
    if depth == 0:
        return F.lit(0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down)


def matrix(x: pa.Array) -> np.ndarray:
    """Rows x values of an array of lists of equal length; a missing value is NaN."""
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(x), -1) if len(flat) else np.empty((len(x), 0))


def walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, steps: int) -> np.ndarray:
    """The node each row (rows x values) reaches in one tree after so many steps."""
    node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    for _ in range(steps):
        f = feature[node]
        right = x[rows, np.maximum(f, 0)] > cut[node]  # a missing value is not greater
        node = np.where(f < 0, node, 2 * node + 1 + right)
    return node


def paid(x: Column, trees: list[Tree], values: np.ndarray, depth: int, by_bin: bool = False) -> Column:
    """Sums over the trees of ``values`` (trees x nodes x numbers) at the nodes that a row's array ``x`` reaches, an
    ``array<double>``; ``x`` holds bins if ``by_bin``."""
    feature = np.array([t.feature for t in trees], dtype=np.int64)
    cut = np.array([t.cut_bin if by_bin else t.cut for t in trees], dtype=float)

    @F.arrow_udf("array<double>")
    def total(rows: pa.Array) -> pa.Array:
        found, out = matrix(rows), np.zeros((len(rows), values.shape[2]))
        for f, c, v in zip(feature, cut, values):
            out += v[walk(found, f, c, depth)]
        ends = np.arange(len(out) + 1, dtype=np.int32) * values.shape[2]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))
    return total(x)


def binned(x: Column, cuts: list[list[float]]) -> Column:
    """The number of bounds below each value of the array ``x``, an ``array<int>``; a missing value lies below all."""
    @F.arrow_udf("array<int>")
    def bins(rows: pa.Array) -> pa.Array:
        found = matrix(rows)
        out = np.zeros((len(found), len(cuts)), dtype=np.int32)
        for i, bounds in enumerate(cuts):
            out[:, i] = np.where(np.isnan(found[:, i]), 0, np.searchsorted(bounds, found[:, i]))
        ends = np.arange(len(out) + 1, dtype=np.int32) * len(cuts)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))
    return bins(x)


def without_nan(x: Column) -> Column:
    return F.transform(x, lambda v: F.when(~F.isnan(v), v))


def bin_cuts(rows: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Rising bounds of each feature's bins, from approximate quantiles of the array ``x``."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.nanvl(F.get("x", F.lit(i)), F.lit(None)), shares, 10_000).alias(f"c{i}")
                       for i in range(width)]).first()
    return [sorted(set(c)) if c else [] for c in found]


def bin_number(value: Column, cuts: list[float]) -> Column:
    """Number of bounds below a value; a missing value lies below all."""
    if not cuts:
        return F.lit(0)
    below = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < value))
    return F.when(value.isNull() | F.isnan(value), 0).otherwise(below)


def paths_of(trees: list[Tree], pay: Callable[[int, int], float]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]]:
    """For each leaf the features of its path, their intervals (low, high], the shares of rows kept, and what the leaf
    pays, ``pay(tree number, node)``."""
    out = []
    for number, tree in enumerate(trees):
        pending = [(0, {})]
        while pending:
            at, path = pending.pop()
            if tree.feature[at] < 0:
                names = sorted(path)
                low, high, share = (np.array([path[f][i] for f in names], dtype=float) for i in range(3))
                out.append((np.array(names, dtype=int), low, high, share, pay(number, at)))
                continue
            f, cut = tree.feature[at], tree.cut[at]
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, edge in ((2 * at + 1, (low, min(high, cut))), (2 * at + 2, (max(low, cut), high))):
                pending.append((child, path | {f: (*edge, share * tree.rows[child] / tree.rows[at])}))
    return out


@dataclass
class TreeModel:
    """Trees of a fit; a subclass says what they add up to."""

    trees: list[Tree]
    depth: int
    gains: list[float] = field(default_factory=list)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the name that tree models of MLlib use
        """Each feature's share of all gains."""
        total = sum(self.gains)
        return Vectors.dense([g / total if total else 0.0 for g in self.gains])


@dataclass
class ClassModel(TreeModel):
    """Trees whose leaves give scores to classes; ``scores`` of a row add up to 1, and the first best class is predicted."""

    classes: int = 2

    def scores(self, x: Column) -> Column:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``scores``, ``prediction`` and, of two classes, ``margin`` for its column ``features``."""
        scored = df.withColumn("scores", self.scores(without_nan(vector_to_array("features"))))
        best = F.array_position("scores", F.array_max("scores")) - 1
        out = scored.withColumn("prediction", best.cast("double"))
        return out.withColumn("margin", self.margin_of(F.col("scores"))) if self.classes == 2 else out

    @staticmethod
    def margin_of(scores: Column) -> Column:
        return F.get(scores, F.lit(1))


def labelled(df: DataFrame, *keep: str) -> DataFrame:
    """``x, y`` of the rows with a label, for a fit by classes, and the columns to ``keep``."""
    y = F.col("label").cast("int").alias("y")
    return df.filter(F.col("label").isNotNull()).select(*keep, without_nan(vector_to_array("features")).alias("x"), y)


def extent(rows: DataFrame) -> tuple[int, int, int]:
    """Rows, features and classes of ``x, y``."""
    n, width, low, high = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), F.min("y"), F.max("y")).first()
    if n and low < 0:
        raise ValueError("labels must be numbers from 0 on")
    return n, width or 0, max(high + 1, 2) if n else 2
