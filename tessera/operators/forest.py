"""Random forest from Spark aggregates: bootstrapped rows, a few features tried at each node, histograms of binned features.

Features are binned at approximate quantiles. Rows alike in bins and label form a cell, and a fit reads cells with their
numbers of rows: each tree draws for each row a Poisson number of copies of mean ``subsample``, so for a cell of n rows a
Poisson number of mean n times that, which has the same distribution. Numpy draws for a block of cells at a time; blocks
are made by a hash and ordered by it, so a fit does not depend on how rows lie.

A level of all trees is one pass over the cells: each task sums histograms of node, feature, bin and class in arrays, and
Spark adds them up; the last level needs classes by node only. Fits that each leave out a fold of the cells grow in the same
passes. The histograms' size depends on the settings alone. The best cut by Gini impurity is taken among the features
that a seeded hash of tree, node and feature orders first. Missing values go left. Rows without a label teach nothing;
without any row everything is class 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import SEED
from tessera.operators.extratrees import ExtraModel, draw
from tessera.operators.trees import DIGITS, Tree, bin_cuts, binned, extent, labelled, matrix, paid, walk
from tessera.session import cut_lineage

# Blocks of cells that draw together, trees of a fit that grow in the same jobs, and bytes of histograms up to which fits do.
BLOCKS = 64
TOGETHER = 32
HISTOGRAM_BYTES = 64_000_000


def best_cut(n: np.ndarray, tried: list[int], least: int) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut of a node's counts (features x bins x classes); gain 0: none."""
    best = (0.0, -1, 0)
    for f in tried:
        left = np.cumsum(n[f], axis=0)[:-1]
        total = n[f].sum(axis=0)
        right = total - left
        a, b = left.sum(axis=1), right.sum(axis=1)
        fits = (a >= max(least, 1)) & (b >= max(least, 1))
        if not fits.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (left ** 2).sum(axis=1) / a + (right ** 2).sum(axis=1) / b - (total ** 2).sum() / total.sum()
        gain = np.where(fits, np.round(gain, DIGITS), 0.0)
        if gain.max() > best[0]:
            best = (float(gain.max()), f, int(gain.argmax()))
    return best


class ForestModel(ExtraModel):
    """Trees and the shares of classes at their nodes; ``scores`` are means over the trees, ``margin`` that of class 1."""

    def predict_bins(self, cells: DataFrame) -> DataFrame:
        """``cells`` with ``prediction`` for their bins."""
        if not self.trees:
            return cells.withColumn("prediction", F.lit(0).cast("bigint"))
        scored = cells.withColumn("scores", paid(F.col("bins"), self.trees, np.array(self.shares), self.depth, by_bin=True))
        best = F.array_position("scores", F.array_max("scores")) - 1
        return scored.withColumn("prediction", best.cast("bigint")).drop("scores")


@dataclass(frozen=True)
class RandomForest:
    """Settings of a fit, under the names of a sweep. ``max_features`` 0 stands for the root of the number of features, rounded up."""

    n_estimators: int = 100
    max_depth: int = 5
    max_features: int = 0
    subsample: float = 1.0
    min_child_weight: int = 1
    random_state: int = SEED
    max_bins: int = 32

    def with_params(self, params: dict) -> RandomForest:
        """A copy with sweep parameters set; ``None`` leaves a default."""
        return replace(self, **{k: float(v) if k == "subsample" else int(v) for k, v in params.items() if v is not None})

    def fit(self, df: DataFrame, key: str | None = None) -> ForestModel:
        """A model of ``label`` (0, 1, ...) by ``features``; rows are drawn in cells, so ``key`` has no effect."""
        rows = labelled(df)
        n, width, classes = extent(rows)
        if not n or not width:
            return ForestModel([], self.max_depth, [0.0] * width, classes)
        cuts = bin_cuts(rows, width, self.max_bins)
        return self.grow(cells_of(rows, cuts), cuts, classes)

    def grow(self, cells: DataFrame, cuts: list[list[float]], classes: int) -> ForestModel:
        """A model from cells ``bins, y, n``."""
        return self._grown(cells, ["n"], cuts, classes)[0]

    def grow_without(self, cells: DataFrame, cuts: list[list[float]], classes: int, folds: int) -> list[ForestModel]:
        """For each fold a model from the cells ``fold, bins, y, n`` of the other ones."""
        most, width = max(map(len, cuts)) + 1, len(cuts)
        trees = min(TOGETHER, self.n_estimators)
        step = max(1, HISTOGRAM_BYTES // (8 * trees * 2 ** self.max_depth * width * most * classes))
        found = []
        for first in range(0, folds, step):
            names = {f"n{f}": F.sum(F.when(F.col("fold") != f, F.col("n")).otherwise(0)).alias(f"n{f}")
                     for f in range(first, min(first + step, folds))}
            found += self._grown(cells.groupBy("bins", "y").agg(*names.values()), list(names), cuts, classes)
        return found

    def _grown(self, cells: DataFrame, counts: list[str], cuts: list[list[float]], classes: int) -> list[ForestModel]:
        """A model for each column of numbers of rows in cells ``bins, y, counts...``."""
        models = [ForestModel([], self.max_depth, [0.0] * len(cuts), classes) for _ in counts]
        for first in range(0, self.n_estimators, TOGETHER):
            numbers = range(first, min(first + TOGETHER, self.n_estimators))
            self._grow(cut_lineage(self._drawn(cells, counts, numbers), "forest-drawn"), numbers, cuts, models)
        return models

    def _drawn(self, cells: DataFrame, counts: list[str], numbers: range) -> DataFrame:
        """``bins, y, drawn``: how many rows of a cell each tree draws, the trees of one count after those of another."""
        seed, mean, first, many = self.random_state, self.subsample, numbers[0], len(numbers)

        def draws(block: pa.Table) -> pa.Table:
            block = block.sort_by([("hash", "ascending"), ("y", "ascending")])
            numpy_seed = [seed % 2 ** 32, block.column("block")[0].as_py(), first]
            found = np.zeros((len(block), len(counts) * many), dtype=np.int64)
            for i, name in enumerate(counts):
                n = block.column(name).to_numpy()
                some = n > 0
                found[some, i * many:(i + 1) * many] = np.random.default_rng(numpy_seed).poisson(
                    mean * n[some][:, None], (np.count_nonzero(some), many))
            ends = np.arange(len(block) + 1, dtype=np.int32) * found.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))
            return pa.table({"bins": block.column("bins"), "y": block.column("y"), "drawn": lists})
        named = cells.withColumn("hash", F.xxhash64("bins"))
        named = named.withColumn("block", F.pmod(F.xxhash64("hash", "y"), F.lit(BLOCKS)).cast("int"))
        return named.groupBy("block").applyInArrow(draws, "bins array<int>, y int, drawn array<long>")

    def _grow(self, cells: DataFrame, numbers: range, cuts: list[list[float]], models: list[ForestModel]) -> None:
        many, classes, width = len(numbers), models[0].classes, len(cuts)
        trees = [Tree.empty(self.max_depth) for _ in range(many * len(models))]
        shares = [[[0.0] * classes for _ in t.feature] for t in trees]
        most, tries = max(map(len, cuts)) + 1, self.max_features or math.ceil(math.sqrt(width))
        open_nodes = {(t, 0) for t in range(len(trees))}
        for level in range(self.max_depth + 1):
            last = level == self.max_depth
            held = self._histograms(cells, trees, level, 1 if last else width, 1 if last else most, classes)
            again = set()
            for t, at in sorted(open_nodes):
                n = held[t, at - 2 ** level + 1]
                total, tree = n[0].sum(axis=0), trees[t]
                tree.rows[at] = float(total.sum())
                shares[t][at] = [float(v) for v in (total / total.sum() if total.sum() else np.eye(classes)[0])]
                if last or np.count_nonzero(total) < 2:
                    continue
                varied = [f for f in range(width) if np.count_nonzero(n[f].sum(axis=1)) > 1]
                varied.sort(key=lambda f: (draw(self.random_state, numbers[t % many], at, f, 0), f))
                gain, feature, place = best_cut(n, varied[:tries], self.min_child_weight)
                if feature >= 0:
                    tree.feature[at], tree.cut_bin[at], tree.cut[at] = feature, place, float(cuts[feature][place])
                    models[t // many].gains[feature] += gain
                    again |= {(t, 2 * at + 1), (t, 2 * at + 2)}
            open_nodes = again
            if not open_nodes:
                break
        for i, model in enumerate(models):
            model.trees.extend(trees[i * many:(i + 1) * many])
            model.shares.extend(shares[i * many:(i + 1) * many])

    @staticmethod
    def _histograms(cells: DataFrame, trees: list[Tree], level: int, width: int, most: int, classes: int) -> np.ndarray:
        """Drawn rows by tree, node of the level, feature, bin and class; ``most`` 1 counts all bins as one."""
        feature, cut = np.array([t.feature for t in trees]), np.array([t.cut_bin for t in trees], dtype=float)
        shape = (len(trees), 2 ** level, width, most, classes)
        first = 2 ** level - 1

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(trees), int(np.prod(shape[1:]))))
            for batch in batches:
                bins, y = matrix(batch.column("bins")), batch.column("y").to_numpy().astype(np.int64)
                drawn = np.ascontiguousarray(matrix(batch.column("drawn")).T)
                place = bins[:, :width].astype(np.int64) if most > 1 else np.zeros((len(bins), width), dtype=np.int64)
                place = (np.arange(width) * most + place) * classes + y[:, None]
                for t in range(len(trees)):
                    some = np.flatnonzero(drawn[t])
                    node = walk(bins[some], feature[t], cut[t], level) - first
                    some, node = some[node >= 0], node[node >= 0]
                    at = place[some] + node[:, None] * (width * most * classes)
                    total[t] += np.bincount(at.ravel(), np.repeat(drawn[t, some], width), total.shape[1])
            flat = total.ravel()
            place = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(flat[place])], ["place", "n"])
        found = cells.mapInArrow(sums, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(int(np.prod(shape)))
        out[found.column("place").to_numpy()] = found.column("n").to_numpy()
        return out.reshape(shape)


def cells_of(rows: DataFrame, cuts: list[list[float]], by: list[str] | None = None) -> DataFrame:
    """``by..., bins, y, n``: the numbers of rows ``x, y`` alike in bins and label, written."""
    found = rows.select(*(by or []), binned(F.col("x"), cuts).alias("bins"), "y")
    return cut_lineage(found.groupBy(*(by or []), "bins", "y").agg(F.count(F.lit(1)).alias("n")), "forest-cells")
