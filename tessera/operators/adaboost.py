"""Boosting by reweighted rows for any number of classes (Zhu et al., "Multi-class AdaBoost", rule SAMME).

Features are binned once and written with a weight for each row. A level of a round's tree is one hash aggregate, of weight by
node, feature, bin and class, summed in each task before the shuffle; the weights of the leaves, and with them the round's
error and the sum that the new weights are divided by, follow from the same cells, so a round of stumps is one job. Weights are
written every ``WRITE_EVERY`` rounds; between, they are an expression of the trees grown since.

Rounds end early at a tree without error, which votes alone with weight 1 more, or at one that is no better than a guess,
which is left out unless it is the first. Missing values go left. Rows without a label teach nothing; without any row
everything is class 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.trees import (DIGITS, ClassModel, Tree, bin_cuts, bin_number, constants, extent, labelled, lookup,
                                     node_of, paths_of)
from tessera.session import cut_lineage

# Rounds between two writes of the weights.
WRITE_EVERY = 8


def best_cut(cells: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin) of the cut that lowers the weighted Gini impurity most, from weights by feature, bin and class
    that add up to a share of all weight; gain 0: none."""
    left = np.cumsum(cells, axis=1)[:, :-1]
    right = cells.sum(axis=1, keepdims=True) - left
    total = cells[0].sum(axis=0)

    def purity(w: np.ndarray) -> np.ndarray:
        whole = w.sum(axis=-1)
        return np.divide((w ** 2).sum(axis=-1), whole, out=np.zeros_like(whole), where=whole > 0)
    fits = (left.sum(axis=-1) > 0) & (np.round(right.sum(axis=-1), 2 * DIGITS) > 0)
    gain = np.where(fits, np.round(purity(left) + purity(right) - purity(total), DIGITS), 0.0)
    if not gain.size or gain.max() <= 0:
        return 0.0, -1, 0
    feature, at = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[feature, at]), int(feature), int(at)


@dataclass
class AdaModel(ClassModel):
    """Trees (``pays``: a leaf's class), their votes and the errors of their rounds. ``scores`` are shares of the votes,
    ``margin`` those for class 1 less those for class 0."""

    votes: list[float] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)

    def scores(self, x: Column) -> Column:
        none = F.array(F.lit(1.0), *[F.lit(0.0)] * (self.classes - 1))
        if not self.trees:
            return none
        leaves = F.array(*[lookup([int(p) for p in t.pays], node_of(x, t, self.depth, t.cut)) for t in self.trees])
        given = F.zip_with(leaves, constants([v / sum(self.votes) for v in self.votes]), lambda c, v: F.struct(c.alias("c"), v.alias("v")))
        return F.aggregate(given, F.array(*[F.lit(0.0)] * self.classes), lambda sums, g: F.transform(
            sums, lambda s, c: s + F.when(c == g["c"], g["v"]).otherwise(0.0)))

    @staticmethod
    def margin_of(scores: Column) -> Column:
        return F.get(scores, F.lit(1)) - F.get(scores, F.lit(0))

    def paths(self) -> list[tuple]:
        """For each leaf the features of its path, their intervals (low, high], the shares of weight kept, and its vote."""
        if self.classes != 2:
            raise ValueError("attributions need two classes")
        total = sum(self.votes)
        return paths_of(self.trees, lambda number, node: self.votes[number] / total * (1 if self.trees[number].pays[node] else -1))


@dataclass(frozen=True)
class AdaBoost:
    """Settings of a fit, under the names of a sweep."""

    n_estimators: int = 50
    max_depth: int = 1
    learning_rate: float = 1.0
    max_bins: int = 64

    def with_params(self, params: dict) -> AdaBoost:
        """A copy with sweep parameters set; ``None`` leaves a default."""
        return replace(self, **{k: float(v) if k == "learning_rate" else int(v) for k, v in params.items() if v is not None})

    def fit(self, df: DataFrame, key: str | None = None) -> AdaModel:
        """A model of ``label`` (0, 1, ...) by ``features``; nothing is drawn, so ``key`` has no effect."""
        rows = cut_lineage(labelled(df), "ada-rows")
        n, width, classes = extent(rows)
        model = AdaModel([], self.max_depth, [0.0] * width, classes)
        if not n or not width:
            return model
        cuts = bin_cuts(rows, width, self.max_bins)
        binned = F.array(*[bin_number(F.get("x", F.lit(i)), cuts[i]) for i in range(width)])
        rows, pending = cut_lineage(rows.select("y", binned.alias("bins"), F.lit(1 / n).alias("w")), "ada-round"), 0
        for i in range(self.n_estimators):
            tree, gains, error = self._grow(rows, cuts, classes)
            guess = error >= 1 - 1 / classes - 10 ** -DIGITS
            if guess and model.trees:
                break
            perfect = error <= 10 ** -DIGITS
            vote = 1.0 if perfect or guess else self.learning_rate * (math.log((1 - error) / error) + math.log(classes - 1))
            model.trees.append(tree)
            model.votes.append(vote)
            model.errors.append(error)
            if sum(gains):
                model.gains = [g + vote * new / sum(gains) for g, new in zip(model.gains, gains)]
            if perfect or guess:
                break
            whole = (1 - error) + error * math.exp(vote)
            right = F.col("y") == lookup([int(p) for p in tree.pays], node_of(F.col("bins"), tree, self.max_depth, tree.cut_bin))
            rows = rows.withColumn("w", F.col("w") * F.when(right, 1 / whole).otherwise(math.exp(vote) / whole))
            pending += 1
            if pending == WRITE_EVERY and i + 1 < self.n_estimators:
                rows, pending = cut_lineage(rows, "ada-round"), 0
        return model

    def _grow(self, rows: DataFrame, cuts: list[list[float]], classes: int) -> tuple[Tree, list[float], float]:
        """A tree, the gains of its features, and the share of weight that it gets wrong."""
        tree, width, most = Tree.empty(self.max_depth), len(cuts), max(map(len, cuts)) + 1
        held_by, gains = {}, [0.0] * width  # weights of a node's classes
        for level in range(self.max_depth):
            node = node_of(F.col("bins"), tree, level, tree.cut_bin)
            here = rows.select(node.alias("node"), "y", "w", "bins").filter(F.col("node") >= 2 ** level - 1)
            cells = here.select("node", "y", "w", F.posexplode("bins").alias("feature", "bin")).groupBy(
                "node", "feature", "bin", "y").agg(F.sum("w").alias("w")).collect()
            held: dict[int, np.ndarray] = {}
            for r in cells:  # at most 2^level x features x bins x classes
                held.setdefault(r["node"], np.zeros((width, most, classes)))[r["feature"], r["bin"], r["y"]] = r["w"]
            if level == 0:
                held_by[0] = held[0][0].sum(axis=0)
                tree.rows[0] = float(held_by[0].sum())
            for at, part in sorted(held.items()):
                gain, feature, cut = best_cut(part)
                if feature < 0:
                    continue
                tree.feature[at], tree.cut_bin[at], tree.cut[at] = feature, cut, float(cuts[feature][cut])
                gains[feature] += gain
                for child, side in ((2 * at + 1, part[feature, :cut + 1]), (2 * at + 2, part[feature, cut + 1:])):
                    held_by[child] = side.sum(axis=0)
                    tree.rows[child] = float(held_by[child].sum())
            if all(tree.feature[at] < 0 for at in held):
                break
        if not held_by:  # depth 0
            found = {r["y"]: r["w"] for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect()}
            held_by[0] = np.array([found.get(c, 0.0) for c in range(classes)])
        wrong = whole = 0.0
        for at in tree.leaves():
            w = held_by[at]
            tree.pays[at] = float(np.round(w, DIGITS).argmax())
            wrong, whole = wrong + float(w.sum() - w[int(tree.pays[at])]), whole + float(w.sum())
        return tree, gains, wrong / whole
