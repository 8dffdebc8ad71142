"""The record of an explain job: splits, predictions and importances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the JSON shape of an explain log.
LOG_SCHEMA = ("dataset_path string, shap_values_path string, feature_importances map<string,double>, "
              "train_data_idx array<bigint>, test_data_idx array<bigint>, "
              "train_predictions array<bigint>, test_predictions array<bigint>")


def write_log(predictions: DataFrame, importances: DataFrame, path: str) -> None:
    """Write ``predictions(idx, split, prediction)`` and ``importances`` as tables below ``path``."""
    predictions.write.partitionBy("split").parquet(f"{path}/predictions")
    importances.write.parquet(f"{path}/importances")


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The two tables that ``write_log`` wrote."""
    return spark.read.parquet(f"{path}/predictions"), spark.read.parquet(f"{path}/importances")


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON explain logs, one document per file."""
    return spark.read.schema(LOG_SCHEMA).option("multiLine", True).json(path)


def log_predictions(logs: DataFrame) -> DataFrame:
    """``idx, split, prediction`` from the parallel arrays of each log."""
    def paired(split: str):
        rows = F.arrays_zip(F.col(f"{split}_data_idx").alias("idx"),
                            F.col(f"{split}_predictions").alias("prediction"))
        return F.transform(rows, lambda r: F.struct(r["idx"].alias("idx"), F.lit(split).alias("split"),
                                                    r["prediction"].alias("prediction")))
    return logs.select(F.explode(F.concat(paired("train"), paired("test"))).alias("r")).select("r.*")


def log_importances(logs: DataFrame) -> DataFrame:
    """``feature, importance, position`` of each log."""
    return logs.select(F.posexplode("feature_importances").alias("position", "feature", "importance"))
