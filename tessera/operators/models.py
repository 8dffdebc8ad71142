"""Tree classifiers: fitting, prediction, importances and cross-validated tuning."""

from __future__ import annotations

from collections.abc import Collection
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import FOLDS, SEED
from tessera.operators import scoring
from tessera.operators.adaboost import AdaBoost
from tessera.operators.clean import col
from tessera.operators.extratrees import ExtraTrees
from tessera.operators.forest import ForestModel, RandomForest, cells_of
from tessera.operators.newton import NewtonBoost
from tessera.operators.split import stratified_folds
from tessera.operators.trees import bin_cuts, extent, labelled
from tessera.session import cut_lineage, spread

# Sweep parameter -> estimator parameter.
COMMON = {"max_depth": "maxDepth", "min_child_weight": "minInstancesPerNode", "random_state": "seed"}
PARAMS = {
    "DecisionTreeClassifier": COMMON,
    "RandomForestClassifier": COMMON | {"n_estimators": "numTrees", "subsample": "subsamplingRate"},
    "GBTClassifier": COMMON | {"n_estimators": "maxIter", "subsample": "subsamplingRate",
                               "learning_rate": "stepSize", "num_boost_round": "maxIter"},
}
ESTIMATORS = {"DecisionTreeClassifier": DecisionTreeClassifier,
              "RandomForestClassifier": RandomForestClassifier, "GBTClassifier": GBTClassifier}
# Sweep parameters of the library's own classifiers, and those that are named otherwise there.
OWN = {"NewtonBoost": NewtonBoost, "AdaBoost": AdaBoost, "ExtraTrees": ExtraTrees, "RandomForest": RandomForest}
OWN_PARAMS = {
    "NewtonBoost": {"n_estimators", "max_depth", "learning_rate", "reg_lambda", "min_child_weight", "subsample", "random_state"},
    "AdaBoost": {"n_estimators", "max_depth", "learning_rate"},
    "RandomForest": {"n_estimators", "max_depth", "max_features", "subsample", "min_child_weight", "random_state"},
    "ExtraTrees": {"n_estimators", "max_depth", "max_features", "min_child_weight", "random_state"},
}
OWN_NAMES = {"num_boost_round": "n_estimators"}
OwnEstimator = NewtonBoost | AdaBoost | ExtraTrees | RandomForest


def make_estimator(estimator: Estimator | OwnEstimator | str = "GBTClassifier", params: dict | None = None,
                   ignore: Collection[str] = ()) -> Estimator | OwnEstimator:
    """A copy of a tree classifier with sweep parameters set; ``NewtonBoost`` knows ``reg_lambda`` too.

    A parameter without a counterpart raises unless the caller names it in ``ignore``.
    """
    kind = estimator if isinstance(estimator, str) else type(estimator).__name__
    if kind in OWN:
        base = OWN[kind]() if isinstance(estimator, str) else estimator
        named = {OWN_NAMES.get(k, k): v for k, v in (params or {}).items() if k not in ignore or OWN_NAMES.get(k, k) in OWN_PARAMS[kind]}
        unknown = sorted(set(named) - OWN_PARAMS[kind])
        if unknown:
            raise ValueError(f"{kind} has no parameter for {unknown}; name them in ignore to leave them out")
        return base.with_params(named)
    base = ESTIMATORS[estimator](seed=SEED) if isinstance(estimator, str) else estimator.copy()
    kind = type(base).__name__
    if kind not in PARAMS:
        raise ValueError(f"unsupported estimator {kind}; must be one of {sorted([*PARAMS, *OWN])}")
    unknown = sorted(set(params or {}) - set(PARAMS[kind]) - set(ignore))
    if unknown:
        raise ValueError(f"{kind} has no parameter for {unknown}; name them in ignore to leave them out")
    for name, value in (params or {}).items():
        if name in PARAMS[kind] and value is not None:
            target = PARAMS[kind][name]
            number = float(value) if target in ("stepSize", "subsamplingRate") else int(value)
            base.set(base.getParam(target), number)
    return base.setFeaturesCol("features").setLabelCol("label")


def with_vector(df: DataFrame, features: list[str], target: str | None = None, categories: dict[str, int] | None = None) -> DataFrame:
    """Add ``features`` (vector) and, given a target, ``label``.

    Features named in ``categories`` hold numbers of categories, from 0 to below the given count; MLlib's trees split them by sets.
    """
    vector = array_to_vector(F.array(*[col(c).cast("double") for c in features]))
    if categories:
        nominal = [{"idx": i, "name": c, "vals": [str(v) for v in range(categories[c])]} for i, c in enumerate(features) if c in categories]
        numeric = [{"idx": i, "name": c} for i, c in enumerate(features) if c not in categories]
        attributes = {"attrs": {"nominal": nominal, "numeric": numeric}, "num_attrs": len(features)}
        vector = vector.alias("features", metadata={"ml_attr": attributes})
    out = df.withColumn("features", vector)
    return out if target is None else out.withColumn("label", col(target).cast("double"))


def weighable(estimator: Estimator | OwnEstimator) -> bool:
    """Whether weighted rows stand for repeated ones: a boosted or single tree that neither draws rows nor counts them."""
    if not isinstance(estimator, GBTClassifier | DecisionTreeClassifier) or estimator.isSet("weightCol") or estimator.getMinInstancesPerNode() != 1:
        return False
    return isinstance(estimator, DecisionTreeClassifier) or (estimator.getSubsamplingRate() == 1.0 and not estimator.isSet("validationIndicatorCol"))


@dataclass(frozen=True)
class FoldedCells:
    """What a ``RandomForest`` reads of training rows: cells ``fold, bins, y, n`` (None without rows), bounds of the bins, classes."""

    cells: DataFrame | None
    cuts: list[list[float]]
    classes: int

    def fit(self, forest: RandomForest) -> ForestModel:
        """A model from the rows of all folds."""
        if self.cells is None or not self.cuts:
            return ForestModel([], forest.max_depth, [0.0] * len(self.cuts), self.classes)
        return forest.grow(self.cells.groupBy("bins", "y").agg(F.sum("n").alias("n")), self.cuts, self.classes)


def folded_cells(train: DataFrame, features: list[str], target: str, estimator: Estimator | OwnEstimator | str,
                 folds: int = FOLDS, seed: int = SEED) -> FoldedCells | None:
    """The cells of the training rows in stratified folds, with bounds from all rows; None for estimators that read rows."""
    forest = make_estimator(estimator)
    if not isinstance(forest, RandomForest):
        return None
    rows = labelled(with_vector(train, features, target), "idx", "label")
    n, width, classes = extent(rows)
    if not n:
        return FoldedCells(None, [[] for _ in features], classes)
    cuts = bin_cuts(rows, width, forest.max_bins)
    return FoldedCells(cells_of(stratified_folds(rows, "label", k=folds, seed=seed), cuts, ["fold"]), cuts, classes)


def fit(estimator: Estimator | OwnEstimator, train: DataFrame, features: list[str], target: str,
        categories: dict[str, int] | None = None, cells: FoldedCells | None = None) -> Model:
    """Fit on the named columns only; a ``RandomForest`` reads the ``cells`` of the rows if they are given.

    MLlib's trees that draw no rows read rows alike once, weighted by their number. With a least number of
    rows in a node they read all rows, as MLlib counts that number without weights.
    """
    if cells is not None:
        return cells.fit(estimator)
    if weighable(estimator):
        names = [f"f{i}" for i in range(len(features))]
        kinds = None if categories is None else {n: categories[c] for n, c in zip(names, features) if c in categories}
        rows = train.select(*[col(c).cast("double").alias(n) for n, c in zip(names, features)], col(target).cast("double").alias("y"))
        counted = rows.groupBy(*names, "y").agg(F.count(F.lit(1)).cast("double").alias("weight"))
        written = spread(cut_lineage(counted, "weighted"))
        return estimator.copy().setWeightCol("weight").fit(with_vector(written, names, "y", kinds).select("features", "label", "weight"))
    return estimator.fit(with_vector(train, features, target, categories).select("features", "label"))


def predict(model: Model, df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """``keep..., prediction`` with an integer prediction."""
    rows = model.transform(with_vector(df, features))
    return rows.select(*keep, F.col("prediction").cast("bigint").alias("prediction"))


def importances(model: Model, train: DataFrame, features: list[str]) -> DataFrame:
    """``feature, importance, position``; the importances sum to 1."""
    values = model.featureImportances.toArray()
    rows = [(f, float(v), i) for i, (f, v) in enumerate(zip(features, values))]
    return train.sparkSession.createDataFrame(rows, "feature string, importance double, position int")


def fold_scores(folded: DataFrame, estimator: Estimator, folds: int) -> list[tuple[int, float, float]]:
    """``(fold, accuracy, macro_f1)`` of one estimator; the scores of all folds take one job."""
    parts = None
    for f in range(folds):
        model = estimator.fit(folded.filter(F.col("fold") != f).select("features", "label"))
        held = model.transform(folded.filter(F.col("fold") == f))
        part = held.select("fold", F.col("label").cast("bigint").alias("y"),
                           F.col("prediction").cast("bigint").alias("prediction"))
        parts = part if parts is None else parts.unionByName(part)
    rows = scoring.evaluate(parts, ["fold"]).collect()
    return [(r["fold"], r["accuracy"], r["macro_f1"]) for r in rows]


def cell_scores(cells: DataFrame, cuts: list[list[float]], classes: int, forest: RandomForest,
                folds: int) -> list[tuple[int, float, float]]:
    """``fold_scores`` of a forest from cells ``fold, bins, y, n``."""
    parts = None
    for f, model in enumerate(forest.grow_without(cells, cuts, classes, folds)):
        part = model.predict_bins(cells.filter(F.col("fold") == f))
        part = part.select("fold", F.col("y").cast("bigint").alias("y"), "prediction", "n")
        parts = part if parts is None else parts.unionByName(part)
    rows = scoring.evaluate_cells(parts.groupBy("fold", "y", "prediction").agg(F.sum("n").alias("n")), ["fold"]).collect()
    return [(r["fold"], r["accuracy"], r["macro_f1"]) for r in rows]


def tune(train: DataFrame, features: list[str], target: str, trials: DataFrame,
         estimator: Estimator | str = "GBTClassifier", folds: int = FOLDS, seed: int = SEED,
         parallelism: int = 4, ignore: Collection[str] = (), cells: FoldedCells | None = None) -> DataFrame:
    """``trial, fold, accuracy, macro_f1`` of every trial's parameters on stratified folds.

    Trials are few, so their parameters and scores pass through the driver; each fit is a
    Spark job of its own over the folded table, which is written once. For a ``RandomForest`` that table
    holds cells of rows alike in fold, bins and label, ``folded_cells`` unless given; the bounds of the bins come from all rows.
    """
    wanted = [r.asDict() for r in trials.collect()]
    made = [make_estimator(estimator, {k: v for k, v in p.items() if k != "trial"}, ignore) for p in wanted]
    if made and isinstance(made[0], RandomForest):
        given = cells or folded_cells(train, features, target, estimator, folds, seed)

        def scores(forest: RandomForest) -> list[tuple]:
            return cell_scores(given.cells, given.cuts, given.classes, forest, folds) if given.cells else []
    else:
        rows = stratified_folds(train, target, k=folds, seed=seed)
        vectors = with_vector(rows, features, target).select("fold", "features", "label")
        folded = spread(cut_lineage(vectors, "folds"))

        def scores(one: Estimator) -> list[tuple]:
            return fold_scores(folded, one, folds)

    def run(one: tuple) -> list[tuple]:
        return [(one[0]["trial"], *score) for score in scores(one[1])]
    with ThreadPoolExecutor(parallelism) as pool:
        found = [row for part in pool.map(run, zip(wanted, made)) for row in part]
    return train.sparkSession.createDataFrame(
        found, "trial bigint, fold int, accuracy double, macro_f1 double")
