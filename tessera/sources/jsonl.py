"""JSONL sinks and small JSON documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.requests import as_lines

METRIC_MAP = "map<string, struct<accuracy: double, macro_f1_score: double>>"
# Fixed value: the JSON shape of a run's result document.
RUN_SCHEMA = (f"zero_shot_baseline {METRIC_MAP}, zero_shot_cot_ablation {METRIC_MAP}, cot {METRIC_MAP}, "
              "llm_as_judge map<string, map<string, double>>, reasoning map<string, string>")


def write_requests(requests: DataFrame, path: str) -> None:
    """Write ``request`` structs as JSONL, one file per partition."""
    as_lines(requests).write.text(path)


def write_evaluations(evaluations: DataFrame, path: str) -> None:
    """Write ``request_id, evaluation`` rows as JSONL."""
    evaluations.select("request_id", "evaluation").write.json(path)


def newest_file(spark: SparkSession, path: str, run: str, glob: str = "*predictions.jsonl") -> str:
    """Path of the newest matching file below the folder ``<run>_<epoch seconds>``.

    The folder name must match as a whole, so a run never picks up a file of another run whose
    name starts alike. File contents are not read.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).load(path).select("path", "modificationTime"))
    mine = files.filter(F.col("path").rlike(rf"/\Q{run}\E_\d+/"))
    found = mine.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()["p"]
    if found is None:
        raise ValueError(f"no output file of run {run!r} below {path}")
    return found


# The parts of a result document that hold scores.
PARTS = ("cot", "zero_shot_cot_ablation", "zero_shot_baseline")


def read_runs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Result documents named ``<dataset>_<masked|unmasked>.json`` with ``dataset`` and ``masked``."""
    docs = spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(path).select("*", "_metadata.file_name")
    name = F.regexp_extract("file_name", r"^(.*)_(masked|unmasked)\.json$", 1)
    kind = F.regexp_extract("file_name", r"^(.*)_(masked|unmasked)\.json$", 2)
    return docs.select(name.alias("dataset"), (kind == "masked").alias("masked"),
                       *[c for c in docs.columns if c != "file_name"])


def run_scores(runs: DataFrame, model: str = "tree-model") -> DataFrame:
    """``dataset, masked, strategy, accuracy, macro_f1``: one row per strategy of a run.

    The tree model, named ``model``, can be in every part of a document and counts once, from the
    first part that has it.
    """
    empty = F.create_map().cast("map<string, struct<accuracy: double, macro_f1_score: double>>")
    parts = [F.coalesce(F.col(c), empty) for c in PARTS]
    own = [F.map_filter(p, lambda k, _: k != model) for p in parts]
    tree = F.coalesce(*[F.try_element_at(p, F.lit(model)) for p in parts])
    entry = F.when(tree.isNotNull(), F.array(F.struct(F.lit(model).alias("key"), tree.alias("value")))).otherwise(
        F.array().cast("array<struct<key: string, value: struct<accuracy: double, macro_f1_score: double>>>"))
    every = F.concat(entry, *[F.map_entries(p) for p in own])
    rows = runs.select("dataset", "masked", F.explode(every).alias("e")).select(
        "dataset", "masked", F.col("e.key").alias("strategy"), F.col("e.value").alias("m"))
    return rows.select("dataset", "masked", "strategy", F.col("m.accuracy").alias("accuracy"),
                       F.col("m.macro_f1_score").alias("macro_f1"))


def run_judgements(runs: DataFrame) -> DataFrame:
    """``dataset, idx, metrics`` of the unmasked runs."""
    return (runs.filter(~F.col("masked"))
            .select("dataset", F.explode("llm_as_judge").alias("idx", "metrics")))


def write_scores(scores: DataFrame, path: str) -> None:
    """Write a score table as JSON lines."""
    scores.write.json(path)


def write_run(spark: SparkSession, folder: str, dataset: str, masked: bool, **parts: DataFrame) -> str:
    """Write the result document of a run, which ``read_runs`` reads, and return its path.

    ``parts`` are score tables (``strategy, accuracy, macro_f1``, a row a strategy) under the names of the document's parts. A document
    of the same name is replaced. Judgements, a row for each judged answer, stay in tables and files of their own.
    """
    unknown = sorted(set(parts) - set(PARTS))
    if unknown:
        raise ValueError(f"a result document has no part {unknown}")
    doc = {name: {r["strategy"]: {"accuracy": r["accuracy"], "macro_f1_score": r["macro_f1"]}
                  for r in scores.select("strategy", "accuracy", "macro_f1").orderBy("strategy").collect()}
           for name, scores in parts.items()}
    path = f"{folder.rstrip('/')}/{dataset}_{'masked' if masked else 'unmasked'}.json"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(json.dumps(doc, indent=1), "utf-8"))
    finally:
        out.close()
    return path


def read_sweep(spark: SparkSession, path: str) -> tuple[dict[str, dict], dict]:
    """Sweep space (parameter -> distribution) and its settings from one small JSON document."""
    doc = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    settings = {k: v for k, v in doc.items() if k != "parameters"}
    return doc["parameters"], settings


def sweep_rows(lines: DataFrame) -> DataFrame:
    """``parameter`` and its distribution fields from sweep documents in column ``value``."""
    spec = "struct<distribution: string, min: double, max: double, values: array<double>, value: double>"
    parsed = F.from_json("value", f"struct<parameters: map<string, {spec}>>")
    return lines.select(F.explode(parsed["parameters"]).alias("parameter", "s")).select("parameter", "s.*")
