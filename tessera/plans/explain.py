"""The explain job: split, tune, fit, predict, attribute."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import FOLDS, SEED, TEST_FRACTION, TRIALS
from tessera.operators import attribution, checks, models, scoring, split, trials
from tessera.operators.clean import features_of
from tessera.session import cut_lineage, spread


@dataclass
class Explanation:
    """Tables that later jobs read: all have ``idx`` but the importances."""

    table: DataFrame
    predictions: DataFrame
    importances: DataFrame
    attributions: DataFrame

    def rows(self, part: str) -> DataFrame:
        """Rows of the prepared table that belong to 'train' or 'test'."""
        return self.table.filter(F.col("split") == part).drop("split")


def explain(prepared: DataFrame, target: str, space: dict[str, dict],
            estimator: Estimator | str = "GBTClassifier", n_trials: int = TRIALS,
            folds: int = FOLDS, seed: int = SEED, fraction: float = TEST_FRACTION,
            labels: list[int] | None = None, ignore: Collection[str] = ()) -> Explanation:
    """Tune on the training rows, fit the best trial, predict all rows and attribute the
    training rows. Given ``labels``, the table must meet the dataset contract. ``ignore`` names sweep
    parameters without a counterpart."""
    spark = prepared.sparkSession
    features = features_of(prepared, target)
    written = spread(cut_lineage(prepared, "prepared"))
    if labels is not None:
        checks.require_dataset(written, target, labels)
    table = spread(cut_lineage(split.exact_split(written, fraction=fraction, seed=seed), "split"))
    train = table.filter(F.col("split") == "train")
    drawn = trials.sample_trials(spark.range(n_trials).withColumnRenamed("id", "trial"), space, seed=seed)
    cells = models.folded_cells(train, features, target, estimator, folds, seed)
    scores = models.tune(train, features, target, drawn, estimator, folds, seed, ignore=ignore, cells=cells)
    best = scoring.best_trial(scoring.fold_summary(scores)).first()["trial"]
    params = drawn.filter(F.col("trial") == best).drop("trial").first().asDict()
    model = models.fit(models.make_estimator(estimator, params, ignore), train, features, target, cells=cells)
    return Explanation(
        table=table,
        predictions=cut_lineage(models.predict(model, table, features, ["idx", "split"]), "predictions"),
        importances=models.importances(model, train, features),
        attributions=cut_lineage(attribution.attributions(model, train, features), "attributions"))
