"""CSV tables: reading as text, null tokens and the row key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import Dataset
from tessera.session import cut_lineage

# Cell texts that mean "no value" in a CSV.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
               "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def nulled(value: Column) -> Column:
    """Null for a null token, else the value."""
    return F.when(~value.isin(NULL_TOKENS), value)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
             multiline: bool = False) -> DataFrame:
    """Every column as a string, null tokens as null, with ``idx`` = 0-based record position.

    Without ``columns`` the header of the first file names them. Large files are split. Quoted line
    breaks need ``multiline``, which reads each file in one task.
    """
    if not path.endswith(".csv"):
        raise ValueError("dataset path must end with '.csv'")
    reader = (spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if columns is None:
        columns = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = reader.schema(schema).csv(path)
    return number_records(raw.select("*", "_metadata"), columns)


def load(spark: SparkSession, dataset: Dataset) -> DataFrame:
    """Read a dataset's CSV and apply its recipe; ``idx`` stays the position in the file."""
    if dataset.path is None:
        raise ValueError(f"dataset {dataset.name!r} has no path")
    return read_csv(spark, dataset.path, multiline=dataset.multiline).transform(dataset.prepare)


def number_records(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``idx`` from file path, block and place within the block.

    Only the count of each block is summed up; the records stay where they were read.
    """
    placed = raw.select(
        *[nulled(F.col(f"`{c}`")).alias(c) for c in columns],
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"))
    blocks = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("_file", "_block", "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = placed.join(cut_lineage(starts, "blocks"), ["_file", "_block"])
    return numbered.select(
        (F.col("_start") + F.col("_id") - F.col("_first")).alias("idx"),
        *[F.col(f"`{c}`") for c in columns])


def read_attributions(spark: SparkSession, path: str) -> DataFrame:
    """Attribution table (parquet or CSV): ``idx`` and one double per feature."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", True)
        names = reader.csv(path).columns
        schema = T.StructType([T.StructField(c, T.LongType() if c == "idx" else T.DoubleType())
                               for c in names])
        return require_idx(reader.schema(schema).csv(path))
    return require_idx(spark.read.parquet(path))


def require_idx(df: DataFrame) -> DataFrame:
    """Return ``df``, or raise when the row key is missing."""
    if "idx" not in df.columns:
        raise KeyError("an attribution table must have an 'idx' column")
    return df


def write_attributions(df: DataFrame, path: str) -> None:
    """Write the attribution table as CSV when the path says so, else as parquet."""
    writer = require_idx(df).write.mode("errorifexists")
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
