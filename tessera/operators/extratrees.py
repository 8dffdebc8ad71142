"""Extremely randomised trees (Geurts et al.): one random cut for each of a few features of a node, the best of them taken.

A level of several trees takes two hash aggregates and no bins. The first has each node's least and greatest value of every
feature and its rows by class; a seeded hash of tree, node and feature orders the features, and a cut lies that far between
both values. The second counts the classes left of each cut. Both are sums, minima and maxima of rows, so a fit does not
depend on how rows lie, and their size depends on the settings alone. Every tree learns from all rows; rows alike in features and
label are counted once before the fit and stand as one row with their number.

Missing values go left and take no part in minima and maxima. A node is a leaf if it is pure, as deep as ``max_depth`` (trees are kept as
arrays of 2^(depth + 1) nodes), holds fewer rows than two sides need, or has no feature of two values. Rows without a label teach nothing;
without any row everything is class 0.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import SEED
from tessera.operators.trees import DIGITS, ClassModel, Tree, extent, labelled, lookup, node_of, paid, paths_of
from tessera.session import cut_lineage

# Trees that grow in the same jobs; a row is counted once for each of them.
TOGETHER = 16


def draw(seed: int, *names: int) -> float:
    """A number in [0, 1) from a hash of the names."""
    text = ":".join(map(str, (seed, *names))).encode()
    return (int.from_bytes(hashlib.blake2b(text, digest_size=8).digest()) >> 11) / 2 ** 53


def cut_between(low: float, high: float, share: float) -> float:
    """The cut at a share of the way; the least value stays left of it and the greatest right."""
    cut = low + share * (high - low)
    return cut if low <= cut < high else low


def gini_gain(left: np.ndarray, total: np.ndarray) -> float:
    """Fall of the impurity, in rows, from the counts of classes of a node and of its left side."""
    right = total - left
    if not left.sum() or not right.sum():
        return 0.0
    return round(float((left ** 2).sum() / left.sum() + (right ** 2).sum() / right.sum() - (total ** 2).sum() / total.sum()), DIGITS)


@dataclass
class ExtraModel(ClassModel):
    """Trees and the shares of classes at their nodes; ``scores`` are means over the trees, ``margin`` that of class 1."""

    shares: list[list[list[float]]] = field(default_factory=list)

    def scores(self, x: Column) -> Column:
        if not self.trees:
            return F.array(F.lit(1.0), *[F.lit(0.0)] * (self.classes - 1))
        return F.transform(paid(x, self.trees, np.array(self.shares), self.depth), lambda v: v / len(self.trees))

    def paths(self) -> list[tuple]:
        """For each leaf the features of its path, their intervals (low, high], the shares of rows kept, and its part of class 1."""
        if self.classes != 2:
            raise ValueError("attributions need two classes")
        return paths_of(self.trees, lambda number, node: self.shares[number][node][1] / len(self.trees))


@dataclass(frozen=True)
class ExtraTrees:
    """Settings of a fit, under the names of a sweep. ``max_features`` 0 stands for the root of the number of features."""

    n_estimators: int = 100
    max_depth: int = 8
    max_features: int = 0
    min_child_weight: int = 1
    random_state: int = SEED

    def with_params(self, params: dict) -> ExtraTrees:
        """A copy with sweep parameters set; ``None`` leaves a default."""
        return replace(self, **{k: int(v) for k, v in params.items() if v is not None})

    def fit(self, df: DataFrame, key: str | None = None) -> ExtraModel:
        """A model of ``label`` (0, 1, ...) by ``features``; no rows are drawn, so ``key`` has no effect."""
        rows = cut_lineage(labelled(df).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "extra-rows")
        n, width, classes = extent(rows)
        model = ExtraModel([], self.max_depth, [0.0] * width, classes)
        if not n or not width:
            return model
        for first in range(0, self.n_estimators, TOGETHER):
            self._grow(rows, range(first, min(first + TOGETHER, self.n_estimators)), width, model)
        return model

    def candidates(self, tree: int, node: int, low: list, high: list) -> list[tuple[int, float]]:
        """Features that a node tries and their cuts: the first by hash of those with two values."""
        most = self.max_features or max(1, math.isqrt(len(low)))
        varied = [f for f in range(len(low)) if low[f] is not None and low[f] < high[f]]
        varied.sort(key=lambda f: (draw(self.random_state, tree, node, f, 0), f))
        return [(f, cut_between(low[f], high[f], draw(self.random_state, tree, node, f, 1))) for f in varied[:most]]

    def _grow(self, rows: DataFrame, numbers: range, width: int, model: ExtraModel) -> None:
        trees, classes = [Tree.empty(self.max_depth) for _ in numbers], model.classes
        counts: list[dict[int, np.ndarray]] = [{} for _ in numbers]
        by_class = [F.sum(F.when(F.col("y") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(classes)]
        span = [fn(F.get("x", F.lit(f))).alias(f"{name}{f}") for f in range(width) for name, fn in (("low", F.min), ("high", F.max))]
        for level in range(max(self.max_depth, 1)):
            nodes = F.array(*[node_of(F.col("x"), t, level, t.cut) for t in trees])
            here = rows.select("x", "y", "n", F.posexplode(nodes).alias("tree", "node")).filter(F.col("node") >= 2 ** level - 1)
            found = here.groupBy("tree", "node").agg(*by_class, *span).collect()  # at most trees x 2^level rows
            tried: dict[tuple[int, int], list[tuple[int, float]]] = {}
            for r in found:
                n = np.array([r[f"n{c}"] for c in range(classes)], dtype=float)
                counts[r["tree"]].setdefault(r["node"], n)
                if level < self.max_depth and np.count_nonzero(n) > 1 and n.sum() >= 2 * self.min_child_weight:
                    options = self.candidates(numbers[r["tree"]], r["node"], *([r[f"{s}{f}"] for f in range(width)] for s in ("low", "high")))
                    if options:
                        tried[r["tree"], r["node"]] = options
            if not tried:
                break
            for (t, node), (gain, feature, cut, left) in self._best(here, tried, counts, level, len(trees), classes).items():
                tree = trees[t]
                tree.feature[node], tree.cut[node] = feature, cut
                model.gains[feature] += gain
                counts[t][2 * node + 1], counts[t][2 * node + 2] = left, counts[t][node] - left
        for tree, held in zip(trees, counts):
            shares = [[0.0] * classes for _ in tree.feature]
            for node, n in held.items():
                tree.rows[node], shares[node] = float(n.sum()), [float(v) for v in n / n.sum()]
            model.trees.append(tree)
            model.shares.append(shares)

    def _best(self, here: DataFrame, tried: dict, counts: list, level: int, trees: int, classes: int) -> dict:
        """Gain, feature, cut and left counts of each node's best cut; of equal ones the first. Nodes without a gain are left out."""
        first, most = 2 ** level - 1, max(map(len, tried.values()))
        place = F.col("tree") * 2 ** level + F.col("node") - first
        features, cuts = ([[empty] * (trees * 2 ** level) for _ in range(most)] for empty in (-1, 0.0))
        for (t, node), options in tried.items():
            for j, (feature, cut) in enumerate(options):
                features[j][t * 2 ** level + node - first], cuts[j][t * 2 ** level + node - first] = feature, float(cut)
        sides = []
        for j in range(most):
            value = F.get("x", lookup(features[j], F.col("place")))
            sides.append((~F.coalesce(value > lookup(cuts[j], F.col("place")), F.lit(False))).alias(f"left{j}"))
        open_nodes = here.select("tree", "node", "y", "n", "x", place.alias("place")).filter(lookup(features[0], F.col("place")) >= 0)
        left = open_nodes.select("tree", "node", "y", "n", *sides).groupBy("tree", "node").agg(
            *[F.sum(F.when(F.col(f"left{j}") & (F.col("y") == c), F.col("n")).otherwise(0)).alias(f"l{j}_{c}")
              for j in range(most) for c in range(classes)])
        out = {}
        for r in left.collect():
            at, best = (r["tree"], r["node"]), (0.0, -1, 0.0, None)
            total = counts[at[0]][at[1]]
            for j, (feature, cut) in enumerate(tried[at]):
                side = np.array([r[f"l{j}_{c}"] for c in range(classes)], dtype=float)
                gain = gini_gain(side, total)
                if min(side.sum(), (total - side).sum()) >= self.min_child_weight and gain > best[0]:
                    best = (gain, feature, cut, side)
            if best[1] >= 0:
                out[at] = best
        return out
