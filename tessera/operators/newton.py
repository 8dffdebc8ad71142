"""Second-order boosted trees: each split and leaf from sums of gradients and hessians (Chen and Guestrin, "XGBoost: a
scalable tree boosting system").

Features are binned once at approximate quantiles and written. Rows alike in bins and label have the same gradient, so a round
counts the rows it draws in such cells, and a level of a tree is one hash aggregate over the cells, of gradient, hessian
and rows by node, feature and bin, summed in each task before the shuffle; its size depends on the settings alone, so the best
splits are chosen on the driver. A leaf pays ``-G / (H + reg_lambda)`` times the learning rate, a split needs a hessian of
``min_child_weight`` on both sides and a positive gain. Each round's margins of the cells are written, which cuts the lineage.

Rows of a round are drawn by a hash of their key, or of their values if there is none, so a fit does not depend on how rows
lie. Missing values go left at every split. A table without rows gives a model of margin 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import SEED
from tessera.functions.hashing import uniform
from tessera.operators.trees import DIGITS, Tree, TreeModel, bin_cuts, binned, node_of, paid, paths_of
from tessera.session import cut_lineage

def best_split(g: np.ndarray, h: np.ndarray, reg_lambda: float, least: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut of a node's histograms (features x bins); gain 0: none."""
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    total_g, total_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    right_g, right_h = total_g - left_g, total_h - left_h
    fits = (left_h >= least) & (right_h >= least) & (left_h > 0) & (right_h > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left_g ** 2 / (left_h + reg_lambda) + right_g ** 2 / (right_h + reg_lambda)
                - total_g ** 2 / (total_h + reg_lambda))
    gain = np.where(fits, np.round(gain, DIGITS), 0.0)
    if not gain.size or gain.max() <= 0:
        return 0.0, -1, 0
    feature, at = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[feature, at]), int(feature), int(at)


@dataclass
class NewtonModel(TreeModel):
    """``margin`` is the log-odds of class 1."""

    def margin(self, x: Column) -> Column:
        """Log-odds for a row's values, an ``array<double>``."""
        if not self.trees:
            return F.lit(0.0)
        return paid(x, self.trees, np.array([t.pays for t in self.trees])[:, :, None], self.depth)[0]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``margin`` and ``prediction`` (1.0 from margin 0 on) for its column ``features``."""
        return df.withColumn("margin", self.margin(vector_to_array("features"))).withColumn(
            "prediction", (F.col("margin") >= 0).cast("double"))

    def paths(self) -> list[tuple]:
        """For each leaf the features of its path, their intervals (low, high], the shares of rows kept, and the payment."""
        return paths_of(self.trees, lambda number, node: self.trees[number].pays[node])


@dataclass(frozen=True)
class NewtonBoost:
    """Settings of a fit, under the names of a sweep."""

    n_estimators: int = 100
    max_depth: int = 6
    learning_rate: float = 0.3
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    subsample: float = 1.0
    random_state: int = SEED
    max_bins: int = 64

    def with_params(self, params: dict) -> NewtonBoost:
        """A copy with sweep parameters set; ``None`` leaves a default."""
        whole = ("n_estimators", "max_depth", "random_state", "max_bins")
        return replace(self, **{k: int(v) if k in whole else float(v) for k, v in params.items() if v is not None})

    def cuts(self, x: DataFrame, width: int) -> list[list[float]]:
        """Rising bounds of each feature's bins, from its approximate quantiles."""
        return bin_cuts(x, width, self.max_bins)

    def fit(self, df: DataFrame, key: str | None = None) -> NewtonModel:
        """A model of ``label`` (0 or 1) by ``features``; ``key`` names rows for drawing."""
        named = F.struct("features", "label") if key is None else F.struct(key)
        draw = F.xxhash64(F.to_json(named) if key is None else F.col(key).cast("string"))
        rows = cut_lineage(df.select(draw.alias("draw"), vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")),
                           "newton-rows")
        head = rows.select(F.size("x")).first()
        width = head[0] if head else 0
        if not width:
            return NewtonModel([], self.max_depth)
        cuts = self.cuts(rows, width)
        rows = cut_lineage(rows.select("draw", "y", binned(F.col("x"), cuts).alias("bins")), "newton-rows")
        cells = rows.groupBy("bins", "y").agg(F.count(F.lit(1)).alias("n"))
        cells = cut_lineage(cells.withColumn("margin", F.lit(0.0)), "newton-round")
        model = NewtonModel([], self.max_depth, [0.0] * width)
        for i in range(self.n_estimators):
            tree = self._grow(self._drawn(rows, cells, i), cuts, model.gains)
            model.trees.append(tree)
            if i + 1 < self.n_estimators:
                more = paid(F.col("bins"), [tree], np.array([tree.pays])[:, :, None], self.max_depth, by_bin=True)[0]
                cells = cut_lineage(cells.withColumn("margin", F.col("margin") + more), "newton-round")
        return model

    def _drawn(self, rows: DataFrame, cells: DataFrame, number: int) -> DataFrame:
        """The cells with the number of their rows that a round draws."""
        if self.subsample >= 1:
            return cells
        drawn = rows.filter(uniform(self.random_state, F.lit(number), F.col("draw")) < self.subsample)
        counts = drawn.groupBy("bins", "y").agg(F.count(F.lit(1)).alias("n"))
        return cut_lineage(cells.drop("n").join(counts, ["bins", "y"]), "newton-drawn")

    def _grow(self, cells: DataFrame, cuts: list[list[float]], gains: list[float]) -> Tree:
        tree, width = Tree.empty(self.max_depth), len(cuts)
        most = max(map(len, cuts)) + 1
        chance = 1 / (1 + F.exp(-F.col("margin")))
        sums = cells.select("bins", "n", (F.col("n") * (chance - F.col("y"))).alias("g"), (F.col("n") * chance * (1 - chance)).alias("h"))
        for level in range(self.max_depth + 1):
            node = node_of(F.col("bins"), tree, level, tree.cut_bin)
            here = sums.select(node.alias("node"), "bins", "g", "h", "n").filter(F.col("node") >= 2 ** level - 1)
            if level == self.max_depth:  # leaves need no histograms
                found = here.groupBy("node", F.lit(0).alias("feature"), F.lit(0).alias("bin"))
            else:
                found = here.select("node", "g", "h", "n", F.posexplode("bins").alias("feature", "bin")).groupBy("node", "feature", "bin")
            summed = found.agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect()
            held: dict[int, np.ndarray] = {}
            for r in summed:  # at most 2^level x features x bins
                held.setdefault(r["node"], np.zeros((3, width, most)))[:, r["feature"], r["bin"]] = r["g"], r["h"], r["n"]
            for node, (g, h, n) in sorted(held.items()):
                total_g, total_h, tree.rows[node] = math.fsum(g[0]), math.fsum(h[0]), float(n[0].sum())
                if level < self.max_depth:
                    gain, feature, at = best_split(g, h, self.reg_lambda, self.min_child_weight)
                    if feature >= 0:
                        tree.feature[node], tree.cut_bin[node], tree.cut[node] = feature, at, float(cuts[feature][at])
                        gains[feature] += gain
                        continue
                tree.pays[node] = -self.learning_rate * total_g / (total_h + self.reg_lambda) if total_h + self.reg_lambda else 0.0
            if all(tree.feature[node] < 0 for node in held):
                break
        return tree
